"""Chroma fingerprints of audio columns, and the alignment of recordings by them.

A recording (16-bit little-endian mono PCM) becomes frames of 12 pitch-class energies.  Sixteen filters, differences of
rectangles over (frames, pitch classes) read from an integral image in four look-ups each, are quantised to two bits with a Gray
code, so each frame gives one packed 32-bit integer.  Recordings are aligned by votes: equal integers vote for an offset, and
every offset with enough votes is checked by the bit errors over the frames that then overlap.

The search is a join over an inverted index: its keys are pairs of a recording's integers that stand STRIDE frames apart, which unrelated recordings hardly ever
share, so candidates grow with the matches and not with queries times recordings.  A bitmap filter over the queries' keys drops most others before they are shuffled.
Pauses and held notes are no keys in recordings that are mostly something else.  Each candidate pair is then aligned on its whole prints, over all offsets that its integers vote for; votes and bit
errors are counted by runs of equal integers, so memory grows with the frames of a pair and not with their product.  Keys that would still join more than FREQUENT pairs are left out of the join;
recordings that hold one are compared with the queries that hold one block by block, so no pair is lost to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, discard, shipped, stash, tidy

RATE, FRAME, HOP = 2000, 256, 64
WINDOW = 8  # frames that one packed integer looks at
STRIDE, FREQUENT = 4, 1_000_000
QUERY_BLOCK, SLICE_ROWS, CHUNK_FRAMES = 256, 4096, 1 << 20


def _filters() -> list[tuple[int, int, int, int, int]]:
    """(kind, first frame, frames, first class, classes): shapes and places by rule, sixteen in all."""
    out = []
    for k in range(16):
        frames, classes = (2, 4, 8)[k % 3], (2, 3, 4, 6)[k % 4]
        out.append((k % 4, (k * 3) % (WINDOW - frames + 1), frames, (k * 5) % (12 - classes + 1), classes))
    return out


FILTERS = _filters()
#: Quantiser steps in thousandths of a window's energy.  None is 0: that is where differences lie that are none (a held note, silence), and the smallest rounding or noise would turn them over.
STEPS = (-40, 20, 60)
#: Energies are whole numbers of 2^-32, so that all sums are exact in 64 bits (of up to 2^22 frames, over a day at the default hop) and no print depends on the order of additions.
SCALE = 1 << 32


@lru_cache(2)
def _classes(rate: int) -> np.ndarray:
    """(bins, 12) weights from spectrum bins to pitch classes; bins under 100 Hz are left out."""
    freq = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(freq), 12))
    live = np.flatnonzero(freq >= 100)
    out[live, np.round(12 * np.log2(freq[live] / 440.0)).astype(int) % 12] = 1
    return out


def chroma(pcm: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames of pitch-class energies; a recording shorter than one frame has none."""
    if len(pcm) < FRAME:
        return np.empty((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(pcm.astype(np.float64), FRAME)[::HOP] * np.hanning(FRAME)
    return (np.abs(np.fft.rfft(frames, axis=1)) ** 2) @ _classes(rate)


def fingerprint(pcm: np.ndarray, rate: int = RATE) -> np.ndarray:
    """One packed unsigned 32-bit integer per window of frames."""
    c = chroma(pcm, rate)
    n = len(c) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    c = np.rint(np.sqrt(c / np.maximum(c.sum(axis=1, keepdims=True), 1e-9)) * SCALE).astype(np.int64)
    image = np.zeros((len(c) + 1, 13), np.int64)
    image[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(t0: int, frames: int, c0: int, classes: int) -> np.ndarray:
        a, b, lo, hi = t + t0, t + t0 + frames, c0, c0 + classes
        return image[b, hi] - image[a, hi] - image[b, lo] + image[a, lo]

    out = np.zeros(n, np.uint32)
    energy = area(0, WINDOW, 0, 12)
    for kind, t0, frames, c0, classes in FILTERS:
        whole = area(t0, frames, c0, classes)
        if kind == 0:
            value = 2 * area(t0, frames, c0, (classes + 1) // 2) - whole
        elif kind == 1:
            value = 2 * area(t0, frames // 2, c0, classes) - whole
        elif kind == 2:
            value = whole - area(t0, frames, (c0 + 6) % (13 - classes), classes)
        else:
            value = 2 * (area(t0, frames // 2, c0, classes // 2) + area(t0 + frames // 2, frames - frames // 2, c0 + classes // 2, classes - classes // 2)) - whole
        level = sum((1000 * value > step * energy for step in STEPS), np.zeros(n, np.uint32)).astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def melody(vector: np.ndarray, rate: int = RATE) -> np.ndarray:
    """A recording made of a vector, for tables without audio: each pair of numbers is a note whose pitch is the first one's level and whose overtone the second one's."""
    v = np.nan_to_num(np.asarray(vector, np.float64))
    if not len(v):
        return np.empty(0, np.int16)
    level = np.clip(np.floor((v / (np.sqrt((v * v).mean()) or 1.0) + 2) * 3), 0, 11)
    t = np.arange(2 * HOP) / rate
    notes = [0.6 * np.sin(2 * np.pi * 220 * 2 ** (a / 12) * t) + 0.3 * np.sin(2 * np.pi * 440 * 2 ** (b / 12) * t) for a, b in zip(level, np.roll(level, -1), strict=True)]
    return (np.concatenate(notes) * 30000).astype("<i2")


def take(pcm: np.ndarray, number: int) -> np.ndarray:
    """Another take of a recording, by rule: it begins 3 + number % 29 frames later, is a fifth less loud and has white noise of 500 steps (one sixtieth of full scale), seeded by the number."""
    noise = np.random.default_rng(number & 0xFFFFFFFF)
    left = pcm[HOP * (3 + number % 29) :] * 0.8
    return (left + noise.normal(0, 500, len(left))).clip(-32768, 32767).astype("<i2")


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """(share of unequal bits, overlapping frames) with a[i] against b[i + offset]."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi <= lo:
        return 1.0, 0
    return float(np.bitwise_count(a[lo:hi] ^ b[lo + offset : hi + offset]).sum()) / (32 * (hi - lo)), hi - lo


def _runs(print_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, starts, lengths) of the runs of equal integers."""
    starts = np.flatnonzero(np.r_[True, print_[1:] != print_[:-1]]) if len(print_) else np.empty(0, np.int64)
    return print_[starts], starts, np.diff(np.r_[starts, len(print_)])


def _add_boxes(out: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray | int = 1) -> None:
    """Adds to second differences what pairs of runs of lengths a and b give to the offsets from `at` on: a trapezoid, the convolution of two boxes."""
    for shift, sign in ((0, 1), (a, -1), (b, -1), (a + b, 1)):
        np.add.at(out, at + shift, sign * weight)


class QueryIndex:
    """An inverted index from packed integers to the places of a block of queries.  Equal integers in a row are one run, so a held note is one entry, and a pair of runs votes for all its offsets at once."""

    def __init__(self, ids: list[int], prints: list[np.ndarray]):
        self.ids, self.prints = ids, prints
        self.flat = np.concatenate(prints) if prints else np.empty(0, np.uint32)
        self.sizes = np.fromiter(map(len, prints), np.int64, len(prints))
        self.starts = np.cumsum(self.sizes) - self.sizes
        runs = [_runs(p) for p in prints]
        owner = np.repeat(np.arange(len(prints)), [len(r[0]) for r in runs])
        values, first, length = (np.concatenate([r[k] for r in runs]) if runs else np.empty(0, np.int64) for k in range(3))
        order = np.argsort(values, kind="stable")
        self.values, self.owner, self.first, self.length = values[order], owner[order], first[order], length[order]

    def align(self, own: np.ndarray, least_votes: int, most_error: float) -> list[tuple[int, int, int, int, float]]:
        """(query, offset, votes, overlap, bit error) of the queries that align with a recording, at the best of all their offsets that have the votes and overlap by half
        of the shorter one: least bit error, then most votes, then smallest offset.  Memory: a number for each offset of each query that shares an integer, and CHUNK_FRAMES more."""
        values, first, length = _runs(own)
        lo, hi = np.searchsorted(self.values, values, "left"), np.searchsorted(self.values, values, "right")
        hits = hi - lo
        if not hits.sum():
            return []
        met = np.unique(np.concatenate([self.owner[a:b] for a, b in zip(lo[hits > 0], hi[hits > 0], strict=True)]))
        span = self.sizes[met] + len(own) + 2  # offsets of a query, from minus its length on, and room for the last differences
        base = np.zeros(len(self.sizes), np.int64)
        base[met] = np.cumsum(span) - span + self.sizes[met]
        votes = np.zeros(int(span.sum()), np.int64)
        ends = np.cumsum(hits)
        done = 0
        while done < len(hits):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + CHUNK_FRAMES, "right")))
            n = hits[done:upto]
            mine = np.repeat(np.arange(done, upto), n)
            theirs = np.repeat(lo[done:upto] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            at = base[self.owner[theirs]] + first[mine] - self.first[theirs] - self.length[theirs] + 1
            _add_boxes(votes, at, length[mine], self.length[theirs])
            done = upto
        votes = votes.cumsum().cumsum()
        place = np.flatnonzero(votes >= least_votes)
        q = met[np.searchsorted(np.cumsum(span), place, "right")]
        offset, votes = place - base[q], votes[place]
        before = np.maximum(0, -offset)
        overlap = np.minimum(self.sizes[q], len(own) - offset) - before
        live = overlap >= np.maximum(1, np.minimum(self.sizes[q], len(own)) // 2)
        q, offset, votes, before, overlap = q[live], offset[live], votes[live], before[live], overlap[live]
        if not len(q):
            return []
        error = np.empty(len(q))
        cuts = [0, *(np.flatnonzero(np.diff(q)) + 1).tolist(), len(q)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            error[a:b] = self._errors(int(q[a]), own, (values, first, length), offset[a:b], before[a:b], overlap[a:b])
        good = np.flatnonzero(error <= most_error)
        good = good[np.lexsort((offset[good], -votes[good], error[good], q[good]))]
        good = good[np.flatnonzero(np.diff(q[good], prepend=-1))]
        return [(self.ids[a], b, c, d, e) for a, b, c, d, e in zip(*(x[good].tolist() for x in (q, offset, votes, overlap, error)), strict=True)]

    def _errors(self, q: int, own: np.ndarray, runs: tuple, offset: np.ndarray, before: np.ndarray, overlap: np.ndarray) -> np.ndarray:
        """Shares of unequal bits at some offsets of one query: frame by frame, or run by run where those are fewer."""
        print_ = self.prints[q]
        value, first, length = _runs(print_)
        if len(value) * len(runs[0]) < overlap.sum():
            unequal = np.zeros(len(print_) + len(own) + 2, np.int64)
            each = max(1, CHUNK_FRAMES // len(value))
            for lo in range(0, len(runs[0]), each):
                v, at, n = (r[lo : lo + each] for r in runs)
                weight = np.bitwise_count(v[:, None] ^ value[None, :]).astype(np.int64).ravel()
                places = (at[:, None] - first[None, :] - length[None, :] + 1 + len(print_)).ravel()
                _add_boxes(unequal, places, np.repeat(n, len(value)), np.tile(length, len(v)), weight)
            return unequal.cumsum().cumsum()[offset + len(print_)] / (32 * overlap)
        out = np.empty(len(offset))
        ends = np.cumsum(overlap)
        cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(CHUNK_FRAMES, ends[-1], CHUNK_FRAMES), "right"), len(overlap)])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            n = overlap[lo:hi]
            starts = np.cumsum(n) - n
            step = np.arange(n.sum())
            unequal = np.bitwise_count(print_[step + np.repeat(before[lo:hi] - starts, n)] ^ own[step + np.repeat(before[lo:hi] + offset[lo:hi] - starts, n)])
            out[lo:hi] = np.add.reduceat(unequal, starts, dtype=np.int64) / (32 * n)
        return out


def index_keys(print_: np.ndarray) -> np.ndarray:
    """The distinct keys of a print: its integers with those STRIDE frames later; one of the whole print if it is shorter.

    Two equal integers (silence, a held note) are no key unless half of the print is such windows: else every recording with a pause would meet every other one."""
    if len(print_) <= STRIDE:
        return np.array([xxhash.xxh3_64_intdigest(print_.tobytes())], np.uint64).view(np.int64) if len(print_) else np.empty(0, np.int64)
    x = print_.astype(np.uint64)
    a, b = x[:-STRIDE], x[STRIDE:]
    changes = a != b
    if 2 * changes.sum() > len(a):
        a, b = a[changes], b[changes]
    return np.unique((a << np.uint64(32)) | b).view(np.int64)


def fingerprints(recordings: DataFrame, rate: int = RATE, id_col: str = "id", pcm_col: str = "pcm") -> DataFrame:
    """(id, print binary): the packed integers, little-endian, of each recording; null, empty and too short ones have none. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            found = [fingerprint(np.frombuffer(x, "<i2"), rate).astype("<u4").tobytes() if x and len(x) % 2 == 0 else b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "print"])

    return shipped(recordings).select(F.col(id_col).cast("long").alias("id"), F.col(pcm_col).alias("pcm")).mapInArrow(tidy(run), "id long, print binary")


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, few at a time: recordings are large."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield batch.slice(at, 64)


def recordings_of(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, pcm): a media column made of a column of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            found = [melody(np.array([x or 0.0 for x in v])).tobytes() if v else None for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "pcm"])

    return shipped(vectors).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(tidy(run), "id long, pcm binary")


def takes_of(recordings: DataFrame, id_col: str = "id", pcm_col: str = "pcm") -> DataFrame:
    """(id, pcm): take() of each recording with an id and samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            found = [take(np.frombuffer(x, "<i2"), n).tobytes() for n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "pcm"])

    rows = shipped(recordings).select(F.col(id_col).cast("long").alias("id"), F.col(pcm_col).alias("pcm"))
    return rows.where("id is not null and length(pcm) > 0 and length(pcm) % 2 = 0").mapInArrow(tidy(run), "id long, pcm binary")


def print_class():
    """The class of a print: equal prints, and only they, share it."""
    return F.sha2("print", 256)


FOUND = "class string, query_class string, offset_frames long, votes long, overlap long, bit_error double"


def _keys(prints: DataFrame) -> DataFrame:
    """(class, print) -> (class, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            found = [index_keys(np.frombuffer(x, "<u4")) for x in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(batch.num_rows), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.concatenate([np.empty(0, np.int64), *found]))], names=["class", "key"])

    return prints.select("class", "print").mapInArrow(tidy(run), "class string, key long")


def _table(rows: list[tuple]) -> dict[str, pa.Array]:
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 3, pa.float64()]
    return {c.split()[0]: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(zip(FOUND.split(", "), kinds, strict=True))}


def _check_pairs(pairs: DataFrame, own: DataFrame, queries: DataFrame, least_votes: int, most_error: float) -> DataFrame:
    """FOUND of the candidate pairs (class, query_class) that align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            out = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                out += [(a, b, *f[1:]) for f in QueryIndex([0], [np.frombuffer(y, "<u4")]).align(np.frombuffer(x, "<u4"), least_votes, most_error)]
            yield pa.RecordBatch.from_pydict(_table(out))

    both = pairs.join(own.select("class", "print"), "class").join(queries.select(F.col("class").alias("query_class"), F.col("print").alias("query")), "query_class")
    return both.select("class", "query_class", "print", "query").mapInArrow(tidy(run), FOUND)


def _check_blocks(own: DataFrame, queries: DataFrame, least_votes: int, most_error: float) -> DataFrame:
    """FOUND of all pairs of own and queries that align.  Both sides are dealt out by (block of queries, slice of own)."""
    slices, blocks = (max(1, ceil(x.count() / most)) for x, most in ((own, SLICE_ROWS), (queries, QUERY_BLOCK)))
    q = queries.select("class", "print", F.pmod(F.xxhash64("class"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    r = own.select("class", "print", F.pmod(F.xxhash64("class"), F.lit(slices)).cast("int").alias("slice"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"))

    def run(own: pa.Table, block: pa.Table) -> pa.Table:
        index = QueryIndex(block.column("class").to_pylist(), [np.frombuffer(x, "<u4") for x in block.column("print").to_pylist()])
        return pa.table(_table([(a, *f) for a, x in zip(own.column("class").to_pylist(), own.column("print").to_pylist(), strict=True) for f in index.align(np.frombuffer(x, "<u4"), least_votes, most_error)]))

    return r.groupBy("block", "slice").cogroup(q.groupBy("block", "slice")).applyInArrow(run, FOUND)


def _search(own: DataFrame, queries: DataFrame, least_votes: int, most_error: float, frequent: int) -> DataFrame:
    """FOUND of the pairs of own and queries, both (class, print) of distinct prints, that share a key and align."""
    asked = stash(_keys(queries), "asked")
    wanted = stash(asked.groupBy("key").agg(F.count("*").alias("n")), "wanted")
    some = KeyFilter(wanted, "key")
    held = stash(some.only(_keys(own), F.col("key")), "held")
    often = stash(held.groupBy("key").agg(F.count("*").alias("m")).join(wanted, "key").where(F.col("n") * F.col("m") > frequent).select("key"), "often")
    discard(wanted)
    some.discard()
    rare = lambda keys: keys.join(often, "key", "left_anti")
    pairs = stash(rare(held).join(rare(asked).withColumnRenamed("class", "query_class"), "key").select("class", "query_class").distinct(), "pairs")
    out = stash(_check_pairs(pairs, own, queries, least_votes, most_error), "found")
    if not often.isEmpty():
        common = lambda prints, keys: stash(prints.join(keys.join(often, "key", "left_semi").select("class").distinct(), "class", "left_semi"), "common")
        blocks = _check_blocks(common(own, held), common(queries, asked), least_votes, most_error)
        out = stash(out.union(blocks).dropDuplicates(["class", "query_class"]), "found")
    discard(asked, held, often, pairs)
    return out


def align(prints: DataFrame, queries: DataFrame, least_votes: int = 3, most_error: float = 0.2, best: bool = False, same_id: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """All alignments of the recordings of prints with queries: id, n_frames, print_class, query_id, query_class, offset_frames, votes, overlap, bit_error.

    Equal prints are compared once: print_class is shared by the recordings of equal prints, and there is one row per pair of a print_class and a query_class that align, for
    one recording (its least id, where that is not the query itself) and one query of the classes.  It stands for all their members: every recording of print_class aligns
    with every query of query_class but itself, so no link is lost and no copies are multiplied.  With same_id a recording and a query of one id are different recordings (queries are other
    takes, say) and align too.  A query's class is print_class() of its print.  Recordings without such a row
    have one with nulls, so every row of prints occurs.  offset_frames is the recording's frame at the query's first one; of offsets of equal error and votes the smallest counts.  Rows without an id or
    without frames have no class and align with nothing; rows that repeat an id and a print have equal rows.  Other columns are ignored; an empty table gives an empty result.

    With best, there is one row per row of prints, with the query that aligns best with it: least bit error, then most votes, then smallest id.

    A pair is found if it shares a key of the index (see index_keys); it then needs least_votes equal integers at one offset, an overlap of half the shorter print and a bit error of at most most_error there."""
    prints = stash(prints.select("id", "print").withColumn("row", F.monotonically_increasing_id()), "prints")
    live = F.col("id").isNotNull() & (F.length("print") > 0)
    ends = F.min("id").alias("lo"), F.max("id").alias("hi")
    classes = lambda rows: rows.groupBy("print").agg(*ends).select(print_class().alias("class"), "lo", "hi", "print")
    own, asked = stash(classes(prints.where(live)), "classes"), stash(classes(queries.where(live).select("id", "print")), "queries")
    found = _search(own, asked, least_votes, most_error, frequent)
    asked_ends = asked.select(F.col("class").alias("query_class"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"))
    found = found.withColumnRenamed("class", "print_class").join(asked_ends, "query_class")
    named = prints.select("row", "id", F.coalesce(F.expr("length(print) div 4"), F.lit(0)).alias("n_frames"), F.when(live, print_class()).alias("print_class"))
    columns = ["id", "n_frames", "print_class", "query_id", "query_class", "offset_frames", "votes", "overlap", "bit_error"]
    if best:
        other = F.col("q_lo") if same_id else F.when(F.col("q_lo") != F.col("id"), F.col("q_lo")).when(F.col("q_hi") != F.col("id"), F.col("q_hi"))
        pairs = named.join(found, "print_class").withColumn("query_id", other).where("query_id is not null")
        first = F.min(F.struct("bit_error", (-F.col("votes")).alias("v"), "query_id", "query_class", "offset_frames", "overlap"))
        out = named.join(pairs.groupBy("row").agg(first.alias("b")), "row", "left")
        return out.select("id", "n_frames", "print_class", "b.query_id", "b.query_class", "b.offset_frames", (-F.col("b.v")).alias("votes"), "b.overlap", "b.bit_error")
    pair = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("query_id"))
    differ = [F.when(F.col(a) != F.col(b), pair(a, b)) for a, b in (("lo", "q_lo"), ("lo", "q_hi"), ("hi", "q_lo"))]
    found = found.join(own.select(F.col("class").alias("print_class"), "lo", "hi"), "print_class").withColumn("ids", pair("lo", "q_lo") if same_id else F.coalesce(*differ))
    found = found.where("ids is not null").select("print_class", "ids.*", "query_class", "offset_frames", "votes", "overlap", "bit_error")
    return named.join(found, ["print_class", "id"], "left").select(*columns)
