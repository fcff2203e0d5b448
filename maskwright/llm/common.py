"""Helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.session import clear_stashes, discard, free_name, shared_folder, ship, shuffle_width, stash, width_for  # noqa: F401

#: The white space of the contracts: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


#: Rows of a batch between the JVM and Python, and Spark's own number.  Whole texts are large, and both sides hold a batch several times over.
BATCH_ROWS, SPARKS_ROWS = 512, "10000"
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shipped(df: DataFrame) -> DataFrame:
    """df, once the executors have this package.

    Lazy results read the batch size when they run, so it is set for the session, and only where that has Spark's own number: another one that the session was given stays."""
    ship(df.sparkSession)
    if df.sparkSession.conf.get(_BATCH_KEY) == SPARKS_ROWS:
        df.sparkSession.conf.set(_BATCH_KEY, str(BATCH_ROWS))
    return df


def restore_batches(spark: SparkSession) -> None:
    """Gives the session Spark's own batch size back, once the results of this folder's operators have been used."""
    if spark.conf.get(_BATCH_KEY) == str(BATCH_ROWS):
        spark.conf.unset(_BATCH_KEY)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def is_held_out(id_col: str = "doc_id"):
    """crc32(doc_id as text) mod 5 is 0; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def ascii_words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text that is not null, as an array."""
    bare = F.btrim(text, F.lit(ASCII_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t\n\x0B\f\r]+"))


class WordHashes(dict):
    """64-bit hashes of byte strings, remembered up to a bound."""

    BOUND = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


#: Rows and bytes of texts that are Python objects at once.
PART_ROWS, PART_BYTES = 512, 1 << 20


def parts_of(texts: pa.Array, rows: int = PART_ROWS, size: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """(first, count) of the runs that an array of texts is worked through in: at most `rows` rows and `size` bytes, or one longer text."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(texts):
        limit = size + (int(ends[lo - 1]) if lo else 0)
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(ends, limit, "right"))))
        yield lo, hi - lo
        lo = hi


def texts_of(batches: Iterator[pa.RecordBatch], rows: int = PART_ROWS, size: int = PART_BYTES) -> Iterator[tuple[list, list]]:
    """(ids, texts) of a two-column stream, few texts at a time."""
    for batch in batches:
        for at, count in parts_of(batch.column(1), rows, size):
            part = batch.slice(at, count)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


#: Rows and characters at which a group of rows is large enough.
GROUP_ROWS, GROUP_CHARS = 4096, 12_000_000


def row_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(ids, texts) of enough rows at once that a replay is worth its steps, of bounded size."""
    ids, texts, chars = [], [], 0
    for own, new in texts_of(batches):
        ids += own
        texts += new
        chars += sum(len(t) for t in new if t)
        if len(ids) >= GROUP_ROWS or chars >= GROUP_CHARS:
            yield ids, texts
            ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, giving the memory that it has freed back to the system at its end: a Python worker serves other stages afterwards, and an executor's limit holds for all its workers."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not this C library
                pass

    return tidied


#: Bits of a key filter at most.  It is broadcast as 64-bit words with their numbers: 2^21 rows of two numbers.
FILTER_BITS = 1 << 27


class KeyFilter:
    """A bitmap over hashes of keys, for dropping rows before a shuffle: a row whose key is among the keys always passes, another one in about one of sixteen cases while
    there is room for 16 bits a key, and more often beyond.  With more keys than FILTER_BITS it would not tell rows apart: then every row passes and nothing is broadcast."""

    def __init__(self, keys: DataFrame, *key: str, most_bits: int = FILTER_BITS):
        n = keys.count()
        self.words = max(16, min(most_bits, 16 * n) // 64)
        self.table = None
        if n <= most_bits:
            slot = self._slot(*map(F.col, key))
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
            self.table = stash(keys.select(F.floor(slot / 64).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), "filter")

    def _slot(self, *key: Column) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(64 * self.words))

    def mark(self, df: DataFrame, name: str, *key: Column) -> DataFrame:
        """df with a boolean column: whether the row can be one of the keys."""
        if self.table is None:
            return df.withColumn(name, F.lit(True))
        slot, word, bits = (free_name([*df.columns, name], x) for x in ("slot", "word", "bits"))
        table = F.broadcast(self.table.withColumnsRenamed({"word": word, "bits": bits}))
        hit = F.coalesce(F.getbit(F.col(bits), (F.col(slot) % 64).cast("int")) == 1, F.lit(False))
        return df.withColumn(slot, self._slot(*key)).join(table, F.floor(F.col(slot) / 64) == F.col(word), "left").select(*[f"`{c}`" for c in df.columns], hit.alias(name))

    def only(self, df: DataFrame, *key: Column) -> DataFrame:
        """The rows of df that can be one of the keys."""
        name = free_name(df.columns, "hit")
        return self.mark(df, name, *key).where(F.col(name)).drop(name) if self.table is not None else df

    def discard(self) -> None:
        discard(self.table)
