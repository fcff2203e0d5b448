"""Redaction of streams.  Every mode but sequential aliases is a narrow projection, so a stream needs no state, watermark or trigger of its own.
An alias goes by first appearance over all rows, which a stream never has seen: there, aliases come from kept dictionaries, which every batch extends."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.alias_dictionary import AliasDictionary
from ..operators.redact import changed, redact, redact_column
from ..plans.plan import RedactionPlan


def redact_stream(stream: DataFrame, plan: RedactionPlan, salt: str) -> DataFrame:
    """The stream with the plan applied; the salt is required, as a restart has to give the same hashes."""
    if any(p.mode == "hash" and p.options.hash_style == "sequential" for p in plan):
        raise ValueError("sequential aliases need all rows; use the sha256 style on streams, or write the stream by alias_writer()")
    return redact(stream, plan, salt)


def alias_writer(stream: DataFrame, plan: RedactionPlan, salt: str, path: str, order_col: str, dictionaries: dict[str, AliasDictionary]) -> DataStreamWriter:
    """A writer of the stream, redacted with aliases of kept dictionaries, into Parquet below `path`, a folder `batch=N` for each batch; start it with a checkpoint and a trigger.

    A batch first gives its new keys numbers (in order_col's order within it), then writes its rows.  A batch that is run again after a failure finds its keys in the dictionary and overwrites its own folder:
    rows come once and their aliases don't change.  Late rows get the alias that their key has, or the next number: numbers follow the batches, not event time.
    All sequential columns of the plan need a dictionary; their tables are the stream's only state and grow with the distinct keys."""
    lacking = [p.header for p in plan if p.mode == "hash" and p.options.hash_style == "sequential" and stream.columns[p.index] not in dictionaries]
    if lacking:
        raise ValueError(f"sequential aliases on streams need a dictionary for {', '.join(lacking)}")

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist(StorageLevel.DISK_ONLY)  # read for its keys and for its rows
        try:
            redact(held, plan, salt, order_col, dictionaries=dictionaries).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(write)


def change_counts_by_window(stream: DataFrame, plan: RedactionPlan, salt: str, time_col: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Changed cells of each active column per time window; windows close when the watermark passes them."""
    names, types = stream.columns, [f.dataType for f in stream.schema.fields]
    sums = [F.count_if(changed(F.col(f"`{names[p.index]}`"), redact_column(F.col(f"`{names[p.index]}`"), types[p.index], p, salt), types[p.index])).alias(f"c{p.index}") for p in plan.active]
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))  # watermarks need an instant
    return timed.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w")).agg(*sums).select("w.start", "w.end", *[f"c{p.index}" for p in plan.active])
