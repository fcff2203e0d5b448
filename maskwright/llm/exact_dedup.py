"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Senders (partitions of the input) sort the fingerprints of their rows, which Spark does and spills, cut them by owner and send each owner one Golomb-Rice coded
stream; the more owners there are, the more rows a sender takes, so that streams don't get shorter as the input grows.  Owners decode the streams, find fingerprints that came more than once and return two bitmaps per stream: which of its values
another stream holds too, and which are so frequent that their copies fill many tasks.  Senders decode their own streams again by these
bitmaps, which gives the suspect fingerprints.

A bitmap filter over the suspects goes to all tasks and drops the other texts where they are read: only suspects (and the filter's few
false hits) are shuffled, to be compared byte by byte.  Copies collapse to one row per task before that shuffle, and those of frequent texts are dealt
out over SALTS reducers first, so no task gets all copies of a text.

A fingerprint has log2(rows) + 16 bits, so about one row in 65,536 is a false suspect; a text decides in
the end, never a fingerprint.  Equal fingerprints of one sender are sent once: a key that holds a third of all
rows reaches its owner once per sender.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, KeyFilter, discard, shipped, shuffle_width, stash, tidy

#: Rows of an owner, which holds their fingerprints at once (about 200 MB), and rows of a stream where there are many rows.
OWNER_ROWS, STREAM_ROWS = 4_000_000, 4_096
#: Streams that hold a fingerprint of which the copies are dealt out, and the reducers they are dealt to first.
FREQUENT, SALTS = 32, 16


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned integers: [k: 1 byte][n: 4][bytes of quotients: 4][first value: 8], then the gaps
    as a Golomb-Rice code, quotients in unary and remainders of k bits in two streams, so that both decode as whole arrays."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values.astype(np.uint64))
    mean = float(gaps.mean()) if n > 1 else 1.0
    k = max(0, min(57, int(log2(max(1.0, mean * 0.6931)))))
    unary = np.zeros(int((gaps >> np.uint64(k)).sum()) + n - 1, np.uint8)
    if n > 1:
        unary[np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8).ravel()
    packed = np.packbits(unary)
    return bytes([k]) + n.to_bytes(4, "big") + len(packed).to_bytes(4, "big") + int(values[0]).to_bytes(8, "big") + packed.tobytes() + np.packbits(low).tobytes()


def golomb_decode(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    k, n, size = blob[0], int.from_bytes(blob[1:5], "big"), int.from_bytes(blob[5:9], "big")
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, 17)))
    quotients = (np.diff(ones, prepend=-1) - 1).astype(np.uint64)
    low = np.unpackbits(np.frombuffer(blob, np.uint8, offset=17 + size), count=(n - 1) * k).reshape(n - 1, k).astype(np.uint64)
    gaps = (quotients << np.uint64(k)) + (low << np.arange(k, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
    return np.cumsum(np.concatenate([[np.uint64(int.from_bytes(blob[9:17], "big"))], gaps]), dtype=np.uint64)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


STREAMS = "chunk long, owner long, code binary, again binary"


def exchange_width(rows: int, width: int) -> tuple[int, int]:
    """(owners, senders at most) for so many rows in a session of so many shuffle partitions.

    Owners get about OWNER_ROWS rows each.  Senders are no more than give each stream STREAM_ROWS rows, the session's width at least.  So streams are linear in the rows: at most rows / STREAM_ROWS,
    or the width's square where that is more, for widths up to OWNER_ROWS / STREAM_ROWS; their heads stay small beside their codes."""
    owners = max(width, -(-rows // OWNER_ROWS))
    return owners, max(width, rows // (owners * STREAM_ROWS))


def _sender(bits: int, owners: int):
    """(print) in ascending order -> per owner: the code of the task's distinct fingerprints, and a bitmap of those that the task itself repeats.

    Holds one stream at a time, of at most about OWNER_ROWS distinct fingerprints and a batch; longer ones go as several, whose chunks have numbers of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, current, waiting = TaskContext.get().partitionId(), 0, None, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, waiting
            values, at = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
            count = np.bincount(at, np.concatenate([c for _, c in held]))
            row = {"chunk": [(part << 24) + number], "owner": [current], "code": [golomb_encode(values)], "again": [_bits(count > 1)]}
            number, waiting = number + 1, 0
            held.clear()
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("chunk", pa.int64()), ("owner", pa.int64()), ("code", pa.binary()), ("again", pa.binary())]))

        for batch in batches:
            values, count = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True)
            owner = (((values >> np.uint64(bits - 24)) * np.uint64(owners)) >> np.uint64(24)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(owner)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(values)], strict=True):
                if hi > lo:
                    if held and (owner[lo] != current or waiting >= OWNER_ROWS):
                        yield flush()
                    current, waiting = int(owner[lo]), waiting + hi - lo
                    held.append((values[lo:hi], count[lo:hi]))
        if held:
            yield flush()

    return tidy(run)


def _owner(table: pa.Table) -> pa.Table:
    """All streams of one owner -> for each stream the bitmap of values that another stream holds too, and that of frequent ones."""
    streams = [golomb_decode(x) for x in table.column("code").to_pylist()]
    _, inverse, count = np.unique(np.concatenate(streams), return_inverse=True, return_counts=True)
    count = count[inverse]
    ends = np.cumsum([len(s) for s in streams])
    own = [count[end - len(s) : end] for s, end in zip(streams, ends, strict=True)]
    return pa.table({"chunk": table.column("chunk"), "owner": table.column("owner"), "twice": pa.array([_bits(c > 1) for c in own], pa.binary()), "often": pa.array([_bits(c >= FREQUENT) for c in own], pa.binary())})


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, again, twice, often) of a stream -> its suspect fingerprints, and whether they are frequent."""
    for batch in batches:
        for row in range(batch.num_rows):
            code, *maps = (batch.column(c)[row].as_py() for c in range(4))
            values = golomb_decode(code)
            again, twice, often = (np.unpackbits(np.frombuffer(x, np.uint8), count=len(values)).astype(bool) for x in maps)
            found = again | twice
            yield pa.RecordBatch.from_arrays([pa.array(values[found].view(np.int64)), pa.array(often[found])], names=["print", "often"])


def suspect_prints(prints: DataFrame, bits: int, owners: int, senders: int) -> DataFrame:
    """(print, often): the fingerprints of so many bits that occur more than once in the column `print`."""
    sent = stash(prints.coalesce(senders).sortWithinPartitions("print").mapInArrow(_sender(bits, owners), STREAMS), "streams")
    back = sent.select("chunk", "owner", "code").groupBy("owner").applyInArrow(_owner, "chunk long, owner long, twice binary, often binary")
    marked = sent.join(back, ["chunk", "owner"]).select("code", "again", "twice", "often").mapInArrow(_suspects, "print long, often boolean")
    out = stash(marked.groupBy("print").agg(F.max("often").alias("often")), "suspects")
    discard(sent)
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after deleting ASCII white space; null counts as empty.  The row with the most code
    points in its original text stays, ties go to the smallest doc_id.  Null ids lose every tie; rows that
    repeat the kept doc_id with as many code points are all marked kept, since nothing tells them apart.  Other columns are ignored.  An empty table gives an empty result."""
    spark = docs.sparkSession
    docs = shipped(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    norm, points = F.translate("text", ASCII_SPACE, ""), F.char_length("text").alias("points")
    rows = stash(docs.select("doc_id", F.xxhash64(norm).alias("head"), F.unhex(F.sha2(norm, 256)).alias("digest"), points), "digests")
    total = rows.count()
    bits = min(63, max(24, ceil(log2(total + 2)) + 16))  # 63 at most: their order is that of signed numbers too
    mark = F.call_function("shiftrightunsigned", F.col("head"), F.lit(64 - bits))
    suspects = suspect_prints(rows.select(mark.alias("print")), bits, *exchange_width(total, shuffle_width(spark)))
    is_suspect, is_frequent = KeyFilter(suspects, "print"), KeyFilter(suspects.where("often"), "print")

    # byte verification: suspects group by the normalised bytes themselves, copies collapse before the shuffle
    texts = is_suspect.only(docs.select(norm.alias("norm"), F.xxhash64(norm).alias("head"), F.struct(points, (-F.col("doc_id")).alias("d")).alias("rank")), mark)
    texts = is_frequent.mark(texts, "often", mark).withColumn("salt", F.when(F.col("often"), F.spark_partition_id() % SALTS).otherwise(0))
    first = texts.groupBy("norm", "salt").agg(F.max("rank").alias("best"), F.count("*").alias("size"), F.max("often").alias("often")).where("often or size > 1")
    first = stash(first.select(F.unhex(F.sha2("norm", 256)).alias("digest"), F.when(F.col("often"), F.col("norm")).alias("norm"), "best", "size", "often"), "groups")
    again = first.where("often").groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("size").alias("size")).where("size > 1")
    found = first.where("not often").select("digest", "best", "size").union(again.select("digest", "best", "size"))
    groups = stash(found.select(F.col("digest").alias("of"), F.col("best.points").alias("best_points"), (-F.col("best.d")).alias("keep"), "size"), "keepers")
    discard(first, suspects)
    is_frequent.discard()

    # only rows with a suspect fingerprint can be in a group
    marked = is_suspect.mark(rows, "hit", mark)
    out = marked.where("hit").join(groups, F.col("digest") == F.col("of"), "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    kept = F.col("size").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep")) & (F.col("points") == F.col("best_points")))
    out = out.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "digest")
    alone = marked.where("not hit").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return out.union(alone).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
