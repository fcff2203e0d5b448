"""Contiguous shards of near-equal bytes from a global prefix sum, in DataFrame operations only.

Rows are range-partitioned by id once and written down with their partition number.  Each partition sums its own sizes (an
aggregate of one row per partition), a running sum over those few totals gives every partition its offset, and a
window inside each partition adds the local prefix.  Shard boundaries are cuts of the total at equal targets, so shards are
contiguous in id order and differ from the target by at most the two rows at their ends.  No step sorts or collects the table in one task.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, stash

PART_ROWS = 2_000_000


def shard_by_bytes(docs: DataFrame, shards: int, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 in its shard).

    size is the text's UTF-8 bytes plus `overhead`; null counts as no bytes.  Rows go by id, nulls first; rows of one id by checksum, then in
    read order.  A row goes to the shard that holds its middle byte; a text longer than a shard's target can leave the next shard empty.
    The law is about bytes, so equal texts are not kept together."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # the row number of the read breaks ties, so that repeats of one row spread over partitions too
    rows = stash(rows.withColumn("at", F.monotonically_increasing_id()), "sizes")
    parts = max(shuffle_width(spark), ceil(rows.count() / PART_ROWS))
    order = ["doc_id", "text_crc32", "at"]
    dealt = stash(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    inside = Window.partitionBy("part").orderBy(*order)
    placed = dealt.withColumns({"upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "rank": F.row_number().over(inside)}).join(F.broadcast(offsets), "part")  # a row per partition
    middle = F.col("bytes_before") + F.col("upto") - F.expr("(size + 1) div 2")
    shard = F.least(F.lit(shards - 1), F.expr(f"({shards} * middle) div all_bytes"))
    placed = placed.withColumn("middle", middle).select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("rows_before") + F.col("rank") - 1).alias("rank"))
    starts = placed.groupBy("shard").agg(F.min("rank").alias("start"))  # a row per shard
    return placed.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("start")).cast("long").alias("slot"))
