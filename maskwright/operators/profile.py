"""Column profiles: what a table's columns seem to hold, from their headers, counts over all rows and the first values of each.

Everything but the exact distinct counts is a sketch that one pass over the table makes: a row for each column with its filled cells, a HyperLogLog sketch of its values and its first 200 filled
cells, which the aggregate holds in a sorted buffer of that size, so nothing is sorted and no text but the sampled ones is moved.  Sketches can be kept as a table and merged, so appended data is
profiled without reading the old again.  Exact distinct counts are a second aggregate over (column, value), values longer than 32 characters by their 128-bit digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.internal import InternalFunction

from maskwright.session import stash

from ..functions.cells import NOT_WS, is_date_type, is_number, text_of, units
from ..functions.validators import VALUE_TESTS, find_embedded, is_currency, is_date, value_tests
from ..plans.lexicon import MODE_FOR_TYPE, score_header
from ..plans.plan import LOW_CARDINALITY

SAMPLE_SIZE = 200


def _kind(dtype: T.DataType) -> str:
    return "d" if is_date_type(dtype) else "n" if is_number(dtype) else "s"


def cells(df: DataFrame, columns: list[str], order_col: str, count_rows: bool = False) -> DataFrame:
    """(idx, row, text, kind, num, day) for every filled cell of the columns; with count_rows, one of idx -1 for every row too."""
    types = {f.name: f.dataType for f in df.schema.fields}
    made = []
    for i, c in enumerate(columns):
        kind = _kind(types[c])
        made.append(F.struct(F.lit(i).alias("idx"), text_of(df[c], types[c]).alias("text"), F.lit(kind).alias("kind"), (df[c].cast("double") if kind == "n" else F.lit(None).cast("double")).alias("num"), (F.date_format(df[c].cast("timestamp_ntz"), "yyyy-MM-dd") if kind == "d" else F.lit(None).cast("string")).alias("day")))
    if count_rows:
        made.append(F.struct(F.lit(ROWS).alias("idx"), F.lit("-").alias("text"), F.lit("s").alias("kind"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("day")))
    tall = df.select(F.col(f"`{order_col}`").alias("row"), F.explode(F.array(*made)).alias("c")).select("row", "c.*")
    return tall.where(F.col("text").isNotNull() & ((F.col("kind") != "s") | F.col("text").rlike(NOT_WS)))  # anything but white space: found at once, where trimming reads the whole text


def votes(sample: DataFrame, strict_names: bool = False) -> DataFrame:
    """Hits of every value test, embedded kinds and long texts of the sampled cells, by column."""
    text = F.col("text")
    by_kind = {kind: value_tests(F.col("num") if kind == "n" else text, text, {"n": T.DoubleType(), "d": T.TimestampNTZType(), "s": T.StringType()}[kind]) for kind in "nds"}
    types = [kind for kind, _, _ in VALUE_TESTS]
    hit = {t: F.when(F.col("kind") == "n", by_kind["n"][t]).when(F.col("kind") == "d", by_kind["d"][t]).otherwise(by_kind["s"][t]) for t in types}
    marked = sample.select("idx", "rn", "text", "day", *[hit[t].alias(f"is_{t}") for t in types], find_embedded(text, strict_names).alias("found"), (units(text) > 40).alias("long"))
    shown = F.coalesce(F.col("day"), F.col("text"))
    short = F.when(units(shown) > 18, F.concat(F.substring(shown, 1, 15), F.lit("…"))).otherwise(shown)
    kinds = ("email", "phone", "nik", "name")
    return marked.groupBy("idx").agg(
        F.count("*").alias("sampled"),
        *[F.count_if(F.col(f"is_{t}")).alias(f"hits_{t}") for t in types],
        *[F.count_if(F.array_contains("found", k)).alias(f"in_{k}") for k in kinds],
        # ties between embedded kinds go to the one that shows up first
        *[F.min(F.when(F.array_contains("found", k), F.col("rn") * 8 + F.array_position("found", k))).alias(f"at_{k}") for k in kinds],
        F.max("long").alias("any_long"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", short.alias("s"))))), lambda x: x["s"]).alias("samples"),
    )


def _percent(ratio):
    return F.floor(ratio * 100 + 0.5).cast("int").cast("string")


def _first_cells(cell, most: int):
    """The least `most` cells of a group, in order: an aggregate with a bounded buffer, merged from the tasks' own."""
    return F.sort_array(InternalFunction.collect_top_k(cell, most, True))


#: The pseudo-column that counts a table's rows.
ROWS = -1


def sketch(df: DataFrame, order_col: str, columns: list[str] | None = None) -> DataFrame:
    """(idx, column, filled, distinct_sketch, first): what one pass over df tells of its columns, and its number of rows as filled of idx -1.

    first are the first 200 filled cells by (order_col, text).  A column without filled cells has no row."""
    columns = columns or [c for c in df.columns if c != order_col]
    tall = cells(df, columns, order_col, count_rows=True)
    cell = F.when(F.col("idx") >= 0, F.struct("row", "text", "kind", "num", "day"))
    made = tall.groupBy("idx").agg(F.count("*").alias("filled"), F.hll_sketch_agg("text", F.lit(14)).alias("distinct_sketch"), _first_cells(cell, SAMPLE_SIZE).alias("first"))
    names = F.array(*map(F.lit, columns)) if columns else F.array(F.lit(""))
    return made.select("idx", F.when(F.col("idx") >= 0, F.get(names, F.col("idx"))).alias("column"), "filled", "distinct_sketch", "first")


def merge(*sketches: DataFrame) -> DataFrame:
    """One sketch of the rows of several, of tables of the same columns: counts add up, the first cells are the first of all."""
    union = reduce(DataFrame.unionByName, sketches)
    ends = union.groupBy("idx", "column").agg(F.sum("filled").alias("filled"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"))
    first = union.select("idx", F.explode("first").alias("cell")).groupBy("idx").agg(_first_cells(F.col("cell"), SAMPLE_SIZE).alias("first"))
    return ends.join(first, "idx", "left").select("idx", "column", "filled", "distinct_sketch", F.coalesce("first", F.array().cast(union.schema["first"].dataType)).alias("first"))


def profile_of(made: DataFrame, columns: list[str], headers: list[str] | None = None, strict_names: bool = False, distinct: DataFrame | None = None) -> DataFrame:
    """The profile of a sketch, see profile().  made is read several times: a table, that is.  Distinct counts are those of `distinct` (idx, distinct), by default estimates of the sketch (within 2 %)."""
    spark = made.sparkSession
    headers = headers or columns
    rows = made.where(F.col("idx") == ROWS).select("filled").first()
    heads = spark.createDataFrame([(i, h, *score_header(h)) for i, h in enumerate(headers)], "idx int, header string, h_type string, h_score double")
    live = made.where(F.col("idx") != ROWS)
    counts = live.select("idx", "filled", F.hll_sketch_estimate("distinct_sketch").alias("distinct"))
    counts = counts.drop("distinct").join(distinct, "idx", "left") if distinct is not None else counts
    sample = live.select("idx", F.posexplode("first").alias("at", "cell")).select("idx", "cell.*", (F.col("at") + 1).alias("rn"))
    joined = heads.join(counts, "idx", "left").join(votes(sample, strict_names), "idx", "left").fillna(0, ["filled", "distinct", "sampled"])
    return judge(joined, rows[0] if rows else 0)


def profile(df: DataFrame, order_col: str, columns: list[str] | None = None, headers: list[str] | None = None, approximate: bool = False, strict_names: bool = False) -> DataFrame:
    """One row per column: index, header, semantic, score, reason, distinct_count, filled_count, samples, suggested_mode, low_cardinality.

    order_col orders the rows (the sample is the first 200 filled cells); it is not profiled unless columns names it.  headers are the texts to judge, by default the
    columns' names.  Distinct counts are exact, by a second pass, unless approximate is set; strict_names asks for capitals in names inside texts.  A column without filled cells has counts of 0 and no
    samples; a table without rows gives its columns all the same."""
    columns = columns or [c for c in df.columns if c != order_col]
    made = stash(sketch(df, order_col, columns), "profile")
    distinct = None
    if not approximate:
        value = F.when(F.char_length("text") <= 32, F.col("text")).otherwise(F.concat(F.lit("\x01"), F.md5("text")))
        distinct = cells(df, columns, order_col).select("idx", value.alias("value")).distinct().groupBy("idx").agg(F.count("*").alias("distinct"))
    return profile_of(made, columns, headers, strict_names, distinct)


def judge(v: DataFrame, rows: int) -> DataFrame:
    """The fusion of header score, value votes and embedded data."""
    ratio = lambda c: F.when(F.col("sampled") > 0, F.col(c) / F.col("sampled")).otherwise(F.lit(0.0))
    options = [F.struct(F.when((ratio(f"hits_{t}") >= 0.7) & (F.lit(not needs) | (F.col("h_type") == t)), ratio(f"hits_{t}")).otherwise(F.lit(0.0)).alias("r"), F.lit(-n).alias("o"), F.lit(t).alias("t")) for n, (t, _, needs) in enumerate(VALUE_TESTS)]
    v = v.withColumn("best", F.array_max(F.array(*options))).withColumns({"v_score": F.col("best.r"), "v_type": F.col("best.t")})
    head, value = (F.col("h_score") >= 0.6) & (F.col("h_type") != "unknown"), F.col("v_score") >= 0.7
    agree = head & value & (F.col("h_type") == F.col("v_type"))
    base = (
        F.when(agree, F.struct(F.col("v_type").alias("t"), F.least(F.lit(1.0), (F.col("h_score") + F.col("v_score")) / 2 + 0.25).alias("s"), F.concat(F.lit("Header and values both look like "), "v_type").alias("w")))
        .when(value, F.struct(F.col("v_type").alias("t"), F.col("v_score").alias("s"), F.concat(_percent(F.col("v_score")), F.lit("% of sampled values match "), "v_type").alias("w")))
        .when(head, F.struct(F.col("h_type").alias("t"), (F.col("h_score") * 0.8).alias("s"), F.concat(F.lit("Header name suggests "), "h_type").alias("w")))
        .when(F.col("h_score") > 0, F.struct(F.col("h_type").alias("t"), (F.col("h_score") * 0.5).alias("s"), F.concat(F.lit("Weak header match for "), "h_type").alias("w")))
        .otherwise(F.struct(F.lit("unknown").alias("t"), F.lit(0.0).alias("s"), F.lit("No signal").alias("w")))
    )
    kinds = [F.struct(F.coalesce(F.col(f"in_{k}"), F.lit(0)).alias("n"), (-F.coalesce(F.col(f"at_{k}"), F.lit(1 << 40))).alias("o"), F.lit(k).alias("k")) for k in ("email", "phone", "nik", "name")]
    v = v.withColumn("base", base).withColumn("top", F.array_max(F.array(*kinds)))
    share = F.when(F.col("sampled") > 0, F.col("top.n") / F.col("sampled")).otherwise(F.lit(0.0))
    doubtful = (F.col("base.t") == "unknown") | (F.col("base.s") < 0.5)
    inside = doubtful & (F.col("top.n") > 0) & (share >= 0.33)
    long = doubtful & (F.col("base.t") == "unknown") & F.coalesce(F.col("any_long"), F.lit(False))
    semantic = F.when(inside | long, F.lit("text")).otherwise(F.col("base.t"))
    score = F.when(inside, F.greatest(F.col("base.s"), F.least(F.lit(0.75), share * 0.4 + 0.4))).when(long, F.greatest(F.col("base.s"), F.lit(0.3))).otherwise(F.col("base.s"))
    reason = F.when(inside, F.concat(F.lit("Contains "), F.col("top.k"), F.lit(" inside free text ("), _percent(share), F.lit("% of sampled rows)"))).when(long, F.lit("Long free text — may contain personal data")).otherwise(F.col("base.w"))
    mode = F.create_map(*[F.lit(x) for pair in MODE_FOR_TYPE.items() for x in pair])
    return v.select(
        F.col("idx").alias("index"), "header", semantic.alias("semantic"), (F.floor(score * 100 + 0.5) / 100).alias("score"), reason.alias("reason"),
        F.col("distinct").alias("distinct_count"), F.col("filled").alias("filled_count"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
        mode[semantic].alias("suggested_mode"), (F.lit(rows >= 2 * LOW_CARDINALITY) & (F.col("distinct") < LOW_CARDINALITY)).alias("low_cardinality"),
    )


__all__ = ["SAMPLE_SIZE", "cells", "judge", "merge", "profile", "profile_of", "sketch", "votes", "is_currency", "is_date"]
