"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between them of the whole text, hashed into 2^22 buckets, so that telling words rarely
share theirs.  FTRL-proximal keeps a rate for each coordinate and its L1 term leaves most weights at exactly zero, so the model that executors
get is a short list of buckets and weights.

L1 pulls all weights towards zero and with them the scores of the rare class, so the bias is set afterwards, on training rows alone: each of three folds is scored by
a model of the other two, and the threshold that gives the best F1 over these scores becomes the point where the score is 0.5.  The four fits are four tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, discard, parts_of, shipped, stash, texts_of, tidy

BITS = 22
FOLDS = 3
_EDGE = bytes(range(33, 48)) + b":;<=>?@[\\]^_`{|}~"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - BITS)


class _Tokens(dict):
    """Hash of a token's lower-case form without punctuation at its ends; 0 for bare punctuation."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = WordHashes()

    def __missing__(self, token: bytes) -> int:
        if len(self) >= WordHashes.BOUND:
            self.clear()
        word = token.strip(_EDGE)
        value = self[token] = self.hashes[word] if word else 0
        return value


def buckets(text: str | None, tokens: _Tokens) -> np.ndarray:
    """The buckets of a text's features, with repeats."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    h = np.fromiter(map(tokens.__getitem__, words), np.uint64, len(words))
    h = h[h != 0]
    with np.errstate(over="ignore"):
        parts = [h * _M1]
        for gap in (1, 2):
            if len(h) > gap:
                parts.append(((h[:-gap] * _M2) ^ (h[gap:] + np.uint64(gap))) * _M1)
        return np.concatenate([(p ^ (p >> np.uint64(32))) * _M2 >> _SHIFT for p in parts]).astype(np.uint32)


@dataclass
class Linear:
    """Non-zero weights by bucket, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float


Sample = tuple[int, np.ndarray]  # label, distinct buckets


def fit(samples: list[Sample], epochs: int = 6, least: int = 2, alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.5, seed: int = 5) -> Linear:
    """FTRL-proximal over (label, distinct buckets); the same samples in the same order give the same model. Without samples every score is 0.

    Buckets of fewer than `least` samples are left out: they tell nothing about other documents."""
    often = np.zeros(1 << BITS, np.int32)
    for _, i in samples:
        often[i] += 1
    samples = [(label, i[often[i] >= least]) for label, i in samples]
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS
    rng = np.random.default_rng(seed)

    def weights(i: np.ndarray) -> np.ndarray:
        pull = np.where(i == bias, 0.0, l1)
        w = -(z[i] - np.sign(z[i]) * pull) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= pull, 0.0, w)

    for _ in range(epochs):
        for at in rng.permutation(len(samples)):
            label, i = samples[at]
            i = np.append(i, bias)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    seen = np.append(np.flatnonzero(n[:bias]), bias)
    w = weights(seen)
    live = np.flatnonzero(w[:-1])
    return Linear(seen[live], w[live], float(w[-1]) if samples else -35.0)


def logits(model: Linear, samples: list[Sample]) -> np.ndarray:
    table = np.zeros(1 << BITS, np.float32)
    table[model.index] = model.weight
    return np.array([model.bias + float(table[i].sum()) for _, i in samples])


def best_threshold(scores: np.ndarray, truth: np.ndarray) -> float:
    """The middle between the two neighbouring scores that part labels with the best F1, of equal ones the highest; 0 where either label has fewer than 20 rows."""
    if min(int(truth.sum()), int((~truth).sum())) < 20:
        return 0.0
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum(truth[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + truth.sum())
    f1[:-1][s[:-1] == s[1:]] = 0  # equal scores can't be parted
    at = int(f1.argmax())
    return float((s[at] + s[at + 1]) / 2) if at + 1 < len(s) else float(s[at]) - 1.0


def fit_calibrated(spark: SparkSession, samples: list[Sample]) -> Linear:
    """The model of all samples, its bias moved by the folds' best threshold.  Sample k is in fold k mod FOLDS; each fit is a task of its own, which gets the bounded sample as a broadcast."""
    shared = spark.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold in (f for b in batches for f in b.column(0).to_pylist()):
            own = shared.value
            model = fit([x for k, x in enumerate(own) if k % FOLDS != fold])
            left = logits(model, own[fold::FOLDS]) if fold < FOLDS else np.empty(0)
            columns = [pa.array([v], k) for v, k in ((fold, pa.int64()), (model.index.tolist(), pa.list_(pa.int64())), (model.weight.tolist(), pa.list_(pa.float64())), (model.bias, pa.float64()), (left.tolist(), pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["fold", "index", "weight", "bias", "left"])

    fits = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(tidy(run), "fold long, index array<long>, weight array<double>, bias double, left array<double>").collect()
    scores = np.zeros(len(samples))
    for r in fits:
        if r["fold"] < FOLDS:
            scores[r["fold"] :: FOLDS] = r["left"]
    whole = next(r for r in fits if r["fold"] == FOLDS)
    shared.unpersist()
    shift = best_threshold(scores, np.array([bool(y) for y, _ in samples], bool))
    return Linear(np.array(whole["index"], np.int64), np.array(whole["weight"]), whole["bias"] - shift)


def training_samples(docs: DataFrame, marks: DataFrame, most: int = 16_000, most_features: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text") -> list[Sample]:
    """(label, distinct buckets) of at most `most` labelled documents with at most `most_features` features (of four bytes) together, chosen by a hash of their ids: the bounded sample
    that the model is fitted to.

    marks has doc_id and toxic (0 or 1; null rows are skipped, of several labels of a document the largest counts); rows that repeat an id and a text count once."""
    marks = marks.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = marks.count()
    rate = min(1 << 30, int(0.95 * most / n * (1 << 30)) + 1) if n else 0
    place = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30))
    marks = marks.where(place < rate).limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens()
        for batch in batches:
            for at, count in parts_of(batch.column(2)):
                part = batch.slice(at, count)
                found = [np.unique(buckets(t, tokens)) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "toxic", "n", "buckets"])

    rows = shipped(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(marks), "doc_id").select("doc_id", "toxic", "text")  # marks: at most `most` rows of two numbers
    found = stash(rows.mapInArrow(tidy(run), "doc_id long, toxic int, n long, buckets binary").dropDuplicates(["doc_id", "n"]), "samples")
    # of an id that repeats with other texts, texts of as many features count once
    running = F.sum("n").over(Window.orderBy(place, "doc_id", "n").rowsBetween(Window.unboundedPreceding, 0))
    chosen = found.select("doc_id", "n").withColumn("upto", running).where(F.col("upto") <= most_features).select("doc_id", "n")  # some thousand rows of two numbers
    rows = found.join(F.broadcast(chosen.limit(most)), ["doc_id", "n"]).select("doc_id", "toxic", "buckets").collect()
    discard(found)
    return [(r[1], np.frombuffer(r[2], np.uint32)) for r in sorted(rows)]


def score(docs: DataFrame, model: Linear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, hits): the probability of label 1 of every whole text, empty and null ones by the bias alone, and how many weighted features it has.

    Narrow; one row per row, null ids stay null, repeated rows get equal scores, other columns are ignored. The broadcast model has as many weights as L1 leaves of the sample's features, 2^22 at most."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        table = np.zeros(1 << BITS, np.float32)
        table[own.index] = own.weight
        tokens = _Tokens()
        for ids, texts in texts_of(batches):
            scores, hits = [], []
            for text in texts:
                b = buckets(text, tokens)
                live = np.unique(b[table[b] != 0])
                scores.append(float(1 / (1 + np.exp(-np.clip(own.bias + table[live].sum(), -35, 35)))))
                hits.append(len(live))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), pa.array(hits, pa.int64())], names=["id", "score", "hits"])

    out = shipped(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "id long, score double, hits long")
    return out.withColumnRenamed("id", id_col)
