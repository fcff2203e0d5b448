"""Packing by power-of-two decomposition.

A document of L tokens is cut into pieces whose lengths are the binary digits of L, longest first, with as many full
pieces of the sequence length as fit.  Each piece is a sequence of its own and sequences of one length form a bucket, so no
sequence crosses documents and, lengths being powers of two, none is padded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import gather
from .common import GROUP_CHARS, GROUP_ROWS, PART_ROWS, parts_of, shipped, stash, tidy


class _Numbers(dict):
    """Numbers texts in the order in which they are first asked for, and lists the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, text: str) -> int:
        self.fresh.append(text)
        number = self[text] = len(self)
        return number


class WordTokens:
    """Ids of whole texts by a tokenizer that never joins characters across ASCII white space.

    Texts are cut at white space and their distinct words numbered outside Python.  A word of Latin letters and marks of punctuation behind
    them is the ids of its lower-case letters and those of its marks, which the tokenizer always parts; any other word is taken whole.  Each such piece is
    encoded once by the tokenizers library.  Up to about `word_bound` words and `piece_bound` pieces are remembered, for a task at most: a worker serves other stages too.

    With special_as_text the strings of special tokens are ordinary text, else they are their tokens, as by the library's default."""

    MARKS = ".,;:!?"
    LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch

    def __init__(self, path: str, word_bound: int = 200_000, piece_bound: int = 300_000, special_as_text: bool = True):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.word_bound, self.piece_bound = word_bound, piece_bound
        # the one character that stands for each byte in the model's alphabet, as its own byte-level step gives them
        self.byte_letters = {b: letter for c in map(chr, [*range(97, 123), *range(0xC0, 0x100)]) for b, letter in zip(c.encode(), ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0], strict=True)}
        self.forget()

    def forget(self) -> None:
        """Drops all words and pieces."""
        self._forget_words()
        self._forget_pieces()

    def _forget_words(self) -> None:
        self.words: dict[str, int] = {}
        self.word_ids, self.word_ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _forget_pieces(self) -> None:
        self.pieces = _Numbers()
        self.piece_ids, self.piece_ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _encode_pieces(self, pieces: list[str]) -> None:
        """Letters and marks go straight to the tokenizer's model, byte by byte in its own alphabet, as its normalizer and its splitter leave them as they are."""
        tokenize = self.tokenizer.model.tokenize
        each: list[list[int] | None] = []
        for p in pieces:
            if p.isascii():
                each.append([t.id for t in tokenize(p)] if p.islower() and p.isalpha() or not p.strip(self.MARKS) else None)
            else:
                each.append([t.id for t in tokenize("".join(map(self.byte_letters.__getitem__, p.encode())))] if self.LATIN(p) else None)
        rest = [p for p, ids in zip(pieces, each, strict=True) if ids is None]
        found: list[list[int]] = []
        for lo in range(0, len(rest), 2000):
            part = rest[lo : lo + 2000]
            found += [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        others = iter(found)
        each = [next(others) if ids is None else ids for ids in each]
        self.piece_ids = np.concatenate([self.piece_ids, np.fromiter(chain.from_iterable(each), np.uint32)])
        self.piece_ends = np.concatenate([self.piece_ends, self.piece_ends[-1] + np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))])

    def _learn(self, words: list[str]) -> None:
        bodies = [w.rstrip(self.MARKS) for w in words]
        plain = [b.isalpha() and (b.isascii() or self.LATIN(b) is not None) for b in bodies]
        letters = [b.lower() if p else w for w, b, p in zip(words, bodies, plain, strict=True)]
        marks = [w[len(b) :] if p else "" for w, b, p in zip(words, bodies, plain, strict=True)]
        parts = np.empty(2 * len(words), np.int64)
        number = self.pieces.__getitem__
        parts[0::2] = np.fromiter(map(number, letters), np.int64, len(words))
        parts[1::2] = np.fromiter(map(number, marks), np.int64, len(words))
        if self.pieces.fresh:
            self._encode_pieces(self.pieces.fresh)
            self.pieces.fresh = []
        ids, ends = gather(self.piece_ids, self.piece_ends, parts)
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words)), strict=True))
        self.word_ids = np.concatenate([self.word_ids, ids])
        self.word_ends = np.concatenate([self.word_ends, self.word_ends[-1] + ends[2::2]])

    def encode_batch(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; null counts as empty."""
        if len(self.words) > self.word_bound:
            self._forget_words()
        if len(self.pieces) > self.piece_bound:
            self._forget_pieces()
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        first = len(self.words)
        number = np.fromiter(map(self.words.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        if len(new):
            self._learn([distinct[n] for n in new.tolist()])
            number[new] = np.arange(first, first + len(new))
        ids, ends = gather(self.word_ids, self.word_ends, number[coded.indices.to_numpy()] if len(distinct) else np.empty(0, np.int64))
        sizes = split.value_lengths().to_numpy()
        ends = 4 * ends[np.concatenate([[0], np.cumsum(sizes)])]
        raw = ids.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@lru_cache(2)
def word_tokens(path: str, special_as_text: bool = True) -> WordTokens:
    """One per worker process, without what a task has remembered."""
    return WordTokens(path, special_as_text=special_as_text)


def decompose(length: int, limit: int) -> list[int]:
    """Piece lengths of a document: full pieces of `limit` (a power of two), then the binary digits of the rest, longest first."""
    rest = length % limit
    return [limit] * (length // limit) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _groups(batches: Iterator[pa.RecordBatch], done: Callable[[], None]) -> Iterator[pa.RecordBatch]:
    """The rows in groups of bounded size; done() after the last one."""
    for batch in batches:
        for at, count in parts_of(batch.column(1), GROUP_ROWS, GROUP_CHARS):
            yield batch.slice(at, count)
    done()


PIECES = "part int, local long, doc_id long, start long, length long, doc_tokens long, ids binary"


def pieces(docs: DataFrame, path: str, end_id: int, limit: int, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = True) -> DataFrame:
    """One row per piece, with its ids (little-endian unsigned 32-bit) and its number among its task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens, part, seen = word_tokens(path, special_as_text), TaskContext.get().partitionId(), {}
        end = int(end_id).to_bytes(4, "little")
        for group in _groups(batches, tokens.forget):
            ids, texts = group.column(0).to_pylist(), group.column(1)
            out: list[list] = [[] for _ in range(7)]
            for doc_id, raw in zip(ids, tokens.encode_batch(texts), strict=True):
                raw += end
                n = len(raw) // 4
                start = 0
                for length in decompose(n, limit):
                    local = seen.get(length, 0)
                    seen[length] = local + 1
                    for column, value in zip(out, (part, local, doc_id, start, length, n, raw[4 * start : 4 * (start + length)]), strict=True):
                        column.append(value)
                    start += length
            kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary()]
            whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])
            for at in range(0, whole.num_rows, PART_ROWS):
                yield whole.slice(at, PART_ROWS)

    return shipped(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), PIECES)


def pack(docs: DataFrame, path: str, end_id: int, limit: int = 2048, payload: Column | None = None, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset (0: a piece is its sequence) and the payload,
    by default the piece's ids.

    Sequence ids are gapless from 0; longer sequences come first, within a length they follow the input's partitions.  A null or empty text is the
    end id alone, one sequence of length 1.  Strings of special tokens in a text are text, or with special_as_text=False their tokens.  Repeated rows are packed each, null ids stay null, other columns are ignored.

    Tasks number their own pieces; only the counts by task and length (at most 12 rows a task) are gathered to shift those numbers, so pieces are never shuffled to be counted."""
    payload = F.col("ids") if payload is None else payload
    cut = stash(pieces(docs, path, end_id, limit, id_col, text_col, special_as_text).select("part", "local", "doc_id", "start", "length", "doc_tokens", payload), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.desc("length"), "part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    out = cut.join(shifts, ["part", "length"])
    return out.select("doc_id", "start", "length", "doc_tokens", (F.col("local") + F.col("shift")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), cut.columns[-1])
