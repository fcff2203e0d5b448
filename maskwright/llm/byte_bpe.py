"""Byte-level BPE by corpus-level merge replay.

Ranks are fixed and pieces independent, so a corpus is replayed in parts, one group of texts after another in each task, with the same ids as in one go: what a task has
replayed it remembers, and nothing is shuffled.  Replaying the corpus's distinct pieces once would take a shuffle of all pieces and a join back of every occurrence,
several times the corpus, to save the replay of pieces that several tasks meet.

The distinct pieces of some thousand texts are laid end to end as linked token positions.  An inverted index holds, for
each mergeable pair, the positions where it stands; it is keyed by the rank of the merged token, as two pairs
that make the same token compete for the same merge.  Ranks leave a heap in order; each applies to all its positions
at once, as one array operation, and only the two neighbours of a merged position get new index entries.  Where occurrences
overlap the left one wins, and if a merge would make a pair of a lower rank (possible, as a token can be built in several
ways), only each word's first occurrence is merged and the others wait until the lower rank has been replayed: the ids are
those of encoding each piece alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PART_ROWS, row_groups, shipped, tidy


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PairRanks:
    """Rank of the token that two tokens make, -1 if none: an open-addressing table of all splits of all tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(a, b, r) for token, r in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
        table = np.array(pairs, np.int64).reshape(-1, 3)
        key, rank = (table[:, 0] << 32) | table[:, 1], table[:, 2].astype(np.int32)
        self.bits = max(4, int(4 * len(key)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):  # each free slot takes one of the keys that want it, the others go on to the next slot
            free = self.keys[slot[left]] < 0
            taken, first = np.unique(slot[left[free]], return_index=True)
            winners = left[free][first]
            self.keys[taken], self.ranks[taken] = key[winners], rank[winners]
            left = np.setdiff1d(left, winners, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        out = np.full(len(key), -1, np.int32)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        slot = self._slot(key[at])
        while len(at):
            found = self.keys[slot]
            hit = found == key[at]
            out[at[hit]] = self.ranks[slot[hit]]
            on = ~hit & (found >= 0)
            at, slot = at[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out


class ByteBpe:
    """encode() and decode() of one vocabulary; remembers the ids of up to about `bound` pieces and those of the current group of texts."""

    def __init__(self, path: str, pattern: str, bound: int = 200_000):
        self.ranks = read_ranks(path)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairRanks(self.ranks)
        self.find = regex.compile(pattern).findall
        self.bound = bound
        tokens = sorted((rank, token) for token, rank in self.ranks.items())
        lengths = np.zeros(tokens[-1][0] + 1, np.int64)
        lengths[[r for r, _ in tokens]] = [len(t) for _, t in tokens]
        self.token_ends = np.cumsum(lengths)
        self.token_bytes = np.frombuffer(b"".join(t for _, t in tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces end to end, how many each non-empty piece has)."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
        stops = np.cumsum(lengths + 1) - 1
        tok = self.single[raw]
        tok[stops] = -1
        n = len(tok)
        word = np.repeat(np.arange(len(pieces)), lengths + 1)
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        pair = np.append(self.pairs(tok[:-1], tok[1:]), np.int32(-1))  # of each position with its right neighbour
        index: dict[int, list[np.ndarray]] = {}

        def add(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                r = int(ranks[lo])
                if r in index:
                    index[r].append(places[lo:hi])
                else:
                    index[r] = [places[lo:hi]]
                    heappush(heap, r)

        heap: list[int] = []
        start = np.flatnonzero(pair >= 0)
        if len(start):
            add(start, pair[start])
        heapify(heap)
        while heap:
            rank = heappop(heap)
            found = index.pop(rank, None)
            if found is None:
                continue
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = at[pair[at] == rank]
            if not len(at):
                continue
            after = right[at]
            if (pair[after] == rank).any():  # overlapping occurrences: leftmost first
                chosen, gone = [], set()
                for p in np.sort(at).tolist():
                    if p not in gone:
                        chosen.append(p)
                        gone.add(int(right[p]))
                at = np.array(chosen)
                after = right[at]
            new = np.full(len(at), rank, np.int32)
            ahead = np.concatenate([self.pairs(tok[left[at]], new), self.pairs(new, tok[right[after]]), self.pairs(new[:1], new[:1])])
            if ((ahead >= 0) & (ahead < rank)).any():
                at = np.sort(at)
                first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
                wait, at = at[~first], at[first]
                after = right[at]
                if len(wait):
                    index[rank] = [wait]
                    heappush(heap, rank)
            beyond = right[after]
            tok[at] = rank
            tok[after] = -2
            pair[after] = -1
            right[at] = beyond
            left[beyond] = at
            before = left[at]
            before = before[(before >= 0) & (tok[before] >= 0)]
            touched = np.concatenate([at, before])
            if (tok[before] == rank).any():
                touched = np.unique(touched)
            ranks = self.pairs(tok[touched], tok[right[touched]])
            pair[touched] = ranks
            live = ranks >= 0
            if live.any():
                add(touched[live], ranks[live])
        alive = tok >= 0
        return tok[alive], np.bincount(word[alive], minlength=len(pieces))

    def _learn(self, pieces: list[str]) -> None:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        whole = np.fromiter((self.ranks.get(r, -1) for r in raw), np.int32, len(raw))
        rest = np.flatnonzero(whole < 0)
        counts = np.ones(len(raw), np.int64)
        if len(rest):
            ids, counts[rest] = self.replay([raw[n] for n in rest])
        merged = np.repeat(whole, counts)
        if len(rest):
            merged[merged < 0] = ids
        self.index.update(zip(pieces, range(len(self.index), len(self.index) + len(pieces)), strict=True))
        self.ids = np.concatenate([self.ids, merged])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each text ends, with a 0 in front); null counts as empty."""
        if len(self.index) > self.bound:
            self.forget()
        index, fresh, which = self.index, {}, []
        for text in texts:
            found = self.find(text) if text else []
            which.append(np.fromiter((index[p] if p in index else ~fresh.setdefault(p, len(fresh)) for p in found), np.int64, len(found)))
        known = len(index)
        if fresh:
            self._learn(list(fresh))
        sizes = np.fromiter(map(len, which), np.int64, len(which))
        flat = np.concatenate(which) if which else np.empty(0, np.int64)
        flat = np.where(flat < 0, known + ~flat, flat)
        ids, ends = gather(self.ids, self.ends, flat)
        return ids, ends[np.concatenate([[0], np.cumsum(sizes)])]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        return gather(self.token_bytes, np.concatenate([[0], self.token_ends]), ids)[0].tobytes()


def gather(values: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs `which` of values, where run k is values[ends[k] : ends[k + 1]], end to end, and where each ends, with a 0 in front."""
    starts, sizes = ends[which], ends[which + 1] - ends[which]
    out_ends = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.repeat(starts - out_ends[:-1], sizes) + np.arange(out_ends[-1])], out_ends


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> ByteBpe:
    """One per worker process, without what a task has remembered."""
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>), one row per row of docs, repeated rows and null ids included; a null or empty text has no ids.

    Narrow: no shuffle; a worker holds one vocabulary, a bounded memory of pieces and some hundred texts. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for ids, texts in row_groups(batches):
            flat, ends = bpe.encode_batch(texts)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            whole = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], names=["id", "ids"])
            for at in range(0, len(ids), PART_ROWS):
                yield whole.slice(at, PART_ROWS)
        bpe.forget()

    out = shipped(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "id long, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """tokens with a column `decoded` (binary): the bytes of the ids; null ids give empty bytes."""
    names = shipped(tokens).columns
    schema = ", ".join(f"`{c}` {t}" for c, t in tokens.dtypes) + ", decoded binary"
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        token_ends = np.concatenate([[0], bpe.token_ends])
        for batch in batches:
            lists = batch.column(at)
            raw, ends = gather(bpe.token_bytes, token_ends, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = ends[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
            decoded = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*names, "decoded"])

    return tokens.mapInArrow(tidy(run), schema)
