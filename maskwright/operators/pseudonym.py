"""Deterministic pseudonyms: salted digests (narrow expressions) and sequential aliases (one shuffle on the values)."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.session import discard, stash, width_for

from ..functions.fake import fake, fake_currency, fnv_seed


def random_salt() -> str:
    return secrets.token_hex(16)


def digest(text: Column, salt: str, length: int = 12) -> Column:
    """The first `length` hex characters, 4 to 64, of SHA-256 over salt and text. No lookup, no shuffle."""
    return F.substring(F.sha2(F.concat(F.lit(salt), text), 256), 1, min(64, max(4, length)))


def consistent_fake(text: Column, semantic: str, locale: str, salt: str, length: int = 12, original: Column | None = None) -> Column:
    """The synthetic value that belongs to a text under a salt, null for null; with original, amounts keep its magnitude."""
    seed = fnv_seed(digest(text, salt, length))
    if semantic == "currency" and original is not None:
        return fake_currency(seed, original).cast("decimal(38,0)").cast("string")
    return F.when(text.isNotNull(), fake(semantic, locale, seed))  # a seed is never null inside


def fresh_fake(semantic: str, locale: str, original: Column | None = None) -> Column:
    """Another synthetic value for every cell and run."""
    seed = F.floor(F.rand() * F.lit(4294967296.0)).cast("bigint")
    return fake_currency(seed, original) if semantic == "currency" else fake(semantic, locale, seed)


def global_rank(df: DataFrame, *order: str, name: str = "rank", rows_each: int = 2_000_000) -> DataFrame:
    """df with its 1-based position in a total order.

    Rows are written down and counted, range-partitioned by that count (never more than about rows_each to a partition), sorted, written down again, and numbered inside
    their partition; only the partitions' counts are summed up in one place.  A window without partitions would put all rows into one task.  The result is a stashed table: discard() it when it is used up."""
    known = stash(df, "unranked")
    parts = width_for(df.sparkSession, known.count(), rows_each)
    placed = known.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = stash(placed.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ranked")
    discard(known)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    ranked = placed.join(F.broadcast(shifts), "_part")  # a row per partition
    out = stash(ranked.withColumn(name, F.col("_at") + F.col("_shift") + 1).drop("_part", "_at", "_shift"), "numbered")
    discard(placed)
    return out


def first_seen(df: DataFrame, key: Column, order_col: str) -> DataFrame:
    """(key, first): the distinct keys that are neither null nor empty, with their least place in order_col."""
    return df.select(key.alias("key"), F.col(order_col).alias("at")).where("key is not null and key <> ''").groupBy("key").agg(F.min("at").alias("first"))


def alias_table(df: DataFrame, key: Column, order_col: str, prefix: str = "ID") -> DataFrame:
    """(key, alias): PREFIX_0001, PREFIX_0002, ... by first appearance in order_col; the number has as many digits as the largest one needs, four at least.

    Null and empty keys have no alias.  Keys that first appear at one place of the order follow each other by value."""
    ranked = global_rank(first_seen(df, key, order_col), "first", "key")
    width = max(4, len(str(ranked.count())))
    return ranked.select("key", F.concat(F.lit(f"{prefix}_"), F.lpad(F.col("rank").cast("string"), width, "0")).alias("alias"))
