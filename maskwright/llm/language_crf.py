"""Language of words and documents by a linear-chain conditional random field.

The states are the languages; a word's features are its character n-grams with its ends marked (so prefixes and suffixes are among
them) and, for words of a learned lexicon, the word itself; all are hashed into one weight table.  Transition weights
are learned too.  Training sequences splice windows of different documents, as code-switched text does, so the
transitions learn how rarely a language changes.  Labels come from forward-backward: each word gets its marginal distribution, and a
document the mean of its words'.

Forward-backward over a batch of texts runs on whole arrays: texts are cut into blocks of 32 words, each block's transfer matrix
is multiplied out for all blocks at once, the few block boundaries of a text are chained, and the marginals are
filled in block by block, exactly as a single pass would.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, parts_of, shipped, texts_of, tidy

TABLE_BITS, LONGEST, BLOCK = 16, 4, 32
UNKNOWN = "und"
#: The state of words that are of no language; it sorts after all language codes.
OTHER = "~other"
#: Words from which on a text's share is taken at its word.
FEW_WORDS = 10
# First letters of alphabets and how many to take of each, and the rows of a keyboard.
ALPHABETS = {"greek": (0x3B1, 24), "cyrillic": (0x430, 32), "armenian": (0x561, 38), "hebrew": (0x5D0, 27), "arabic": (0x627, 28), "devanagari": (0x905, 50), "thai": (0xE01, 46), "georgian": (0x10D0, 33), "kana": (0x3041, 83), "han": (0x4E00, 5000), "hangul": (0xAC00, 5000)}
KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
#: Texts, and their bytes, that are labelled at once: forward-backward holds some hundred bytes a word.
TEXTS, TEXT_BYTES = 256, 1 << 19
_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~0123456789¡¿«»“”‘’…–—"
_MASK = np.uint64((1 << TABLE_BITS) - 1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # (2^TABLE_BITS, langs) float32; row 0 stays zero
    moves: np.ndarray  # (langs, langs) log weights
    lexicon: frozenset[str]


def word_of(token: str) -> str:
    """The letters a token is judged by; empty if it has none."""
    token = token.strip(_EDGE)
    return token if token.isalpha() or any(map(str.isalpha, token)) else ""


def feature_rows(words: list[str], lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, rows): per byte position of the marked words and n-gram length the weight row, 0 where the n-gram would pass the word's end; each word's positions start at starts.

    The first column's first position, which would be a bare start mark, carries the lexicon feature."""
    marked = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    a = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    left = np.repeat(ends, lengths) - np.arange(len(a))
    rows = np.zeros((len(a), LONGEST), np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(a), np.uint64)
        for n in range(1, LONGEST + 1):
            nth = np.concatenate([a[n - 1 :], np.zeros(n - 1, np.uint64)])
            h = (h ^ (nth + np.uint64(n))) * _M1
            h ^= h >> np.uint64(29)
            rows[:, n - 1] = np.where(left >= n, (((h * _M2) >> np.uint64(20)) & _MASK).astype(np.int64), 0)
        known = np.fromiter((w in lexicon for w in words), bool, len(words))
        sums = np.add.reduceat(a * (np.arange(len(a), dtype=np.uint64) - np.repeat(starts, lengths).astype(np.uint64) + np.uint64(77)) * _M2, starts)
        sums ^= sums >> np.uint64(31)
        rows[starts, 0] = np.where(known, (((sums * _M1) >> np.uint64(17)) & _MASK).astype(np.int64), 0)
    return starts, rows


def word_scores(words: list[str], weights: np.ndarray, lexicon: frozenset[str]) -> np.ndarray:
    starts, rows = feature_rows(words, lexicon)
    total = weights[rows[:, 0]]
    for n in range(1, LONGEST):
        total += weights[rows[:, n]]
    return np.add.reduceat(total, starts, axis=0)


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Marginal label distributions of the words of non-empty texts laid end to end, and, if asked for, the summed expected transitions."""
    k = scores.shape[1]
    e_all = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-12
    a = np.exp(moves - moves.max()).astype(np.float64)
    blocks = (lengths + BLOCK - 1) // BLOCK
    first_block = np.cumsum(blocks) - blocks
    first_word = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(lengths)), blocks)
    nth = np.arange(blocks.sum()) - first_block[of]
    begin = first_word[of] + nth * BLOCK
    size = np.minimum(BLOCK, lengths[of] - nth * BLOCK)
    g = len(of)
    at = np.minimum(begin[:, None] + np.arange(BLOCK)[None, :], len(scores) - 1)
    real = np.arange(BLOCK)[None, :] < size[:, None]
    e = np.where(real[:, :, None], e_all[at], 1.0)
    m = np.broadcast_to(np.eye(k), (g, k, k)).copy()
    for t in range(BLOCK):
        on = real[:, t]
        if not on.any():
            break
        new = (m.reshape(g * k, k) @ a).reshape(g, k, k) * e[:, t][:, None, :]
        m = np.where(on[:, None, None], new / new.sum(axis=(1, 2), keepdims=True), m)
    into, after = np.zeros((g, k)), np.zeros((g, k))
    order = np.argsort(-blocks, kind="stable")
    alive = [int((blocks > n).sum()) for n in range(int(blocks.max()))]
    now = np.full((len(lengths), k), 1.0 / k)
    for n, count in enumerate(alive):
        docs = order[:count]
        into[first_block[docs] + n] = now[docs]
        nxt = np.einsum("dk,dkl->dl", now[docs], m[first_block[docs] + n])
        now[docs] = nxt / nxt.sum(axis=1, keepdims=True)
    now = np.full((len(lengths), k), 1.0)
    for n in range(len(alive) - 1, -1, -1):
        docs = order[: alive[n]]
        after[first_block[docs] + n] = now[docs]
        nxt = np.einsum("dkl,dl->dk", m[first_block[docs] + n], now[docs])
        now[docs] = nxt / nxt.sum(axis=1, keepdims=True)
    alpha = np.empty((g, BLOCK, k))
    now = into
    for t in range(BLOCK):
        new = (now @ a) * e[:, t]
        now = np.where(real[:, t, None], new / new.sum(axis=1, keepdims=True), now)
        alpha[:, t] = now
    out = np.empty_like(e_all)
    expected = np.zeros((k, k))
    beta = after
    for t in range(BLOCK - 1, -1, -1):
        on = real[:, t]
        post = alpha[:, t] * beta
        post /= post.sum(axis=1, keepdims=True)
        out[at[on, t]] = post[on]
        back = e[:, t] * beta
        if pairs:
            before = alpha[:, t - 1] if t else into
            joint = before[:, :, None] * a[None] * back[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            inner = on & ~((t == 0) & (nth == 0))
            expected += joint[inner].sum(axis=0)
        new = back @ a.T
        beta = np.where(on[:, None], new / new.sum(axis=1, keepdims=True), beta)
    return (out, expected) if pairs else out


def _windows(width: int, count: int):
    """Evenly spaced windows over whole texts, as training material."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in texts_of(batches):
            out_l, out_t = [], []
            for lang, text in zip(langs, texts, strict=True):
                words = (text or "").split()
                places = range(0, max(1, len(words) - width + 1), max(1, (len(words) - width) // max(1, count - 1) or 1)) if words else ()
                for at in list(places)[:count]:
                    out_l.append(lang)
                    out_t.append(" ".join(words[at : at + width]))
            yield pa.RecordBatch.from_arrays([pa.array(out_l, pa.string()), pa.array(out_t, pa.string())], names=["lang", "window"])

    return run


def training_windows(labelled: DataFrame, per_lang: int, width: int = 25, windows: int = 10, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """(language, window) of about per_lang labelled documents of each language, chosen by a hash of their ids, and at most
    `windows` windows of `width` words of each: the bounded sample that the model is fitted to."""
    rows = shipped(labelled).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return []
    rate = F.lit(0)
    for lang, n in sorted(counts.items()):
        rate = F.when(F.col(lang_col) == lang, F.lit(min(1 << 30, int(per_lang / n * (1 << 30)) + 1))).otherwise(rate)
    chosen = rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 30)) < rate)
    chosen = chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).limit(2 * per_lang * len(counts))
    return [(r[0], r[1]) for r in chosen.mapInArrow(_windows(width, windows), "lang string, window string").collect()]


def fit(windows: list[tuple[str, str]], epochs: int = 2, rate: float = 0.25, seed: int = 11, lexicon_size: int = 400) -> Crf:
    """Maximum likelihood by AdaGrad on spliced windows; the same sample gives the same model."""
    windows = sorted(windows)
    langs = sorted({w[0] for w in windows})
    k = len(langs)
    by: list[list[list[str]]] = [[] for _ in langs]
    tops = []
    for n, lang in enumerate(langs):
        by[n] = [x for _, text in filter(lambda w, lang=lang: w[0] == lang, windows) if (x := [w for t in text.lower().split() if (w := word_of(t))])]
        tops += [w for w, _ in Counter(w for x in by[n] for w in x).most_common(lexicon_size)]
    model = Crf(langs, np.zeros((1 << TABLE_BITS, k), np.float32), np.zeros((k, k)), frozenset(tops))
    rng = np.random.default_rng(seed)
    w_acc, m_acc = np.full_like(model.weights, 1e-3), np.full((k, k), 1e-3)
    sequences: list[list[tuple[int, list[str]]]] = []
    for _ in range(epochs if k > 1 else 0):
        pool = [(n, x) for n in range(k) for x in by[n]]
        rng.shuffle(pool)
        # by language first, then spliced: four windows of one language, then a change
        queues = [[x for n, x in pool if n == lang] for lang in range(k)]
        while any(queues):
            sequence = []
            for lang in rng.permutation(k)[: 1 + int(rng.integers(2))]:
                sequence += [(int(lang), queues[lang].pop()) for _ in range(min(len(queues[lang]), 1 + int(rng.integers(4))))]
            if sequence:
                sequences.append(sequence)
    for lo in range(0, len(sequences), 48):
        batch = sequences[lo : lo + 48]
        gold = np.array([n for s in batch for n, x in s for _ in x])
        flat = [w for s in batch for _, x in s for w in x]
        lengths = np.array([sum(len(x) for _, x in s) for s in batch])
        index = {w: n for n, w in enumerate(dict.fromkeys(flat))}
        which = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
        vocabulary = list(index)
        starts, rows = feature_rows(vocabulary, model.lexicon)
        total = model.weights[rows[:, 0]]
        for n in range(1, LONGEST):
            total += model.weights[rows[:, n]]
        scores = np.add.reduceat(total, starts, axis=0)[which].astype(np.float64)
        post, moved = marginals(scores, lengths, model.moves, pairs=True)
        post[np.arange(len(gold)), gold] -= 1
        last = np.cumsum(lengths) - 1
        inner = np.ones(len(gold), bool)
        inner[last] = False
        stays = np.flatnonzero(inner)
        seen = np.zeros((k, k))
        np.add.at(seen, (gold[stays], gold[stays + 1]), 1)
        grad_m = (moved - seen) / len(gold) + 1e-4 * model.moves
        m_acc += grad_m**2
        model.moves -= rate * grad_m / np.sqrt(m_acc)
        lengths_b = np.diff(np.append(starts, len(rows)))
        grad = np.zeros_like(model.weights)
        for n in range(k):
            per_word = np.bincount(which, weights=post[:, n], minlength=len(vocabulary))
            spread = np.repeat(per_word, lengths_b)
            grad[:, n] = sum(np.bincount(rows[:, c], weights=spread, minlength=1 << TABLE_BITS) for c in range(LONGEST))
        grad = (grad / len(gold)).astype(np.float32)
        grad[0] = 0
        w_acc += grad**2
        model.weights -= np.float32(rate) * grad / np.sqrt(w_acc)
    return model


def with_other(windows: list[tuple[str, str]], seed: int = 17) -> list[tuple[str, str]]:
    """windows, and as many of no language (OTHER) as a language has on average, made of theirs by a fixed rule: their words with shuffled letters, or as long words of hexadecimal digits, of random letters, of one
    keyboard row, or of an alphabet that none of the languages uses (one letter in a thousand at most)."""
    if not windows:
        return []
    windows = sorted(windows)
    rng = np.random.default_rng(seed)
    letters = Counter(ord(c) for _, text in windows for c in text)
    total = sum(letters.values())
    foreign = [(first, n) for first, n in ALPHABETS.values() if sum(k for c, k in letters.items() if first <= c < first + n) * 1000 <= total]
    of = lambda letters, n: "".join(letters[k] for k in rng.integers(0, len(letters), n))

    def other(word: str, kind: int, alphabet: tuple[int, int] | None, row: str) -> str:
        n = len(word)
        if kind == 0:
            return "".join(rng.permutation(list(word)))
        if kind == 1:
            return of("0123456789abcdef", n + int(rng.integers(3, 24)))
        if kind == 2 or (kind == 4 and alphabet is None):
            return of("abcdefghijklmnopqrstuvwxyz", n)
        if kind == 3:
            return of(row, n)
        return "".join(chr(alphabet[0] + k) for k in rng.integers(0, alphabet[1], max(1, n - 1)))

    out = list(windows)
    for i in range(len(windows) // max(1, len({lang for lang, _ in windows}))):
        words = windows[int(rng.integers(len(windows)))][1].split()
        alphabet = foreign[int(rng.integers(len(foreign)))] if foreign else None
        row = KEYBOARD[int(rng.integers(len(KEYBOARD)))]
        kind = 0 if i % 2 else 1 + i // 2 % 4  # shuffled letters are the hardest to tell
        out.append((OTHER, " ".join(other(w, kind, alphabet, row) for w in words)))
    return out


class Labeller:
    """Labels words; remembers the scores of up to `bound` distinct tokens."""

    def __init__(self, model: Crf, bound: int = 100_000):
        self.model, self.bound = model, bound
        self.other = model.langs.index(OTHER) if OTHER in model.langs else None
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.empty((0, len(self.model.langs)), np.float32)
        self.worded = np.empty(0, bool)

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]], float]]:
        """For each text its language, the mean marginal of that language, the runs of words of one language (first, last, counted over tokens that hold a letter), and what tells that it is of some
        language: the mean marginals of all languages together, in a model without OTHER that of the best."""
        if len(self.index) > self.bound:
            self._reset()
        tokens = [(t or "").lower().split() for t in texts]
        fresh = list(dict.fromkeys(t for ts in tokens for t in ts if t not in self.index))
        if fresh:
            self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh)), strict=True))
            words = [word_of(t) for t in fresh]
            self.scores = np.concatenate([self.scores, word_scores(words, self.model.weights, self.model.lexicon)])
            self.worded = np.concatenate([self.worded, np.array([bool(w) for w in words])])
        get = self.index.__getitem__
        which = [np.fromiter(map(get, ts), np.int64, len(ts)) for ts in tokens]
        which = [w[self.worded[w]] for w in which]
        lengths = np.array([len(w) for w in which])
        full = np.flatnonzero(lengths)
        out: list[tuple[str, float, list[tuple[int, int, str]], float]] = [(UNKNOWN, 0.0, [], 0.0)] * len(texts)
        if not len(full) or not self.model.langs:
            return out
        post = marginals(self.scores[np.concatenate([which[n] for n in full])].astype(np.float64), lengths[full], self.model.moves)
        starts = np.cumsum(lengths[full]) - lengths[full]
        mean = np.add.reduceat(post, starts, axis=0) / lengths[full][:, None]
        best, word = mean.argmax(axis=1), post.argmax(axis=1)
        for n, at, lo in zip(full.tolist(), range(len(full)), starts.tolist(), strict=True):
            own = word[lo : lo + lengths[n]]
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            runs = [(a, b - 1, self.model.langs[own[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]
            score = float(min(1.0, mean[at, best[at]]))
            out[n] = (self.model.langs[best[at]], score, runs, score if self.other is None else 1 - float(mean[at, self.other]))
        return out


RUNS = "array<struct<first: int, last: int, lang: string>>"


def identify(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows as (id, lang_pred, score, runs); whole texts, one row per row.

    A text that is null, empty or without a letter is `und` with score 0 and no runs, and so is every text of a model without
    languages.  Ties go to the first language by name.  Null ids stay null, repeated rows get equal results, other columns are ignored.  The model's size is
    fixed by its table (2^16 rows of one number per language), which bounds what is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(shared.value)
        for ids, texts in texts_of(batches, TEXTS, TEXT_BYTES):
            found = label(texts)
            runs = pa.array([[{"first": a, "last": b, "lang": x} for a, b, x in f[2]] for f in found], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), runs], names=["id", "lang_pred", "score", "runs"])

    out = shipped(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"id long, lang_pred string, score double, runs {RUNS}")
    return out.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Crf, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whatever their names, whose words are of some language: with a share of at least `least` of all languages together (so code-switched texts stay), in a model without
    OTHER of the best one.  Of texts with fewer than FEW_WORDS words a part of that is enough, as a few words tell less.

    Only the texts go to Python and only a flag comes back.  Null, empty and letterless texts go, repeated rows stay or go together; an empty table gives an empty result."""
    shared = shipped(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        label = Labeller(shared.value)
        for texts in batches:
            found = (f for at, count in parts_of(texts, TEXTS, TEXT_BYTES) for f in label(texts.slice(at, count).to_pylist()))
            yield pa.array([f[0] != UNKNOWN and f[3] >= least * min(1, (f[2][-1][1] + 1) / FEW_WORDS) for f in found], pa.bool_())

    told = free_name(docs.columns, "told")
    return docs.withColumn(told, F.arrow_udf(tidy(run), "boolean")(F.col(f"`{text_col}`"))).where(F.col(told)).drop(told)
