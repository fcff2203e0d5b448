"""Which row of a sheet holds the headers; at most eleven rows are looked at.

A sheet is (row_idx int, cells array<struct<t, s, n, b, d>>): t is s, n, b, d or null for an empty cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import text_of, trim
from ..plans.lexicon import column_label

SCAN, FLOOR = 10, 0.55

CELL = T.StructType([T.StructField("t", T.StringType()), T.StructField("s", T.StringType()), T.StructField("n", T.DoubleType()), T.StructField("b", T.BooleanType()), T.StructField("d", T.TimestampNTZType())])
SHEET = T.StructType([T.StructField("row_idx", T.IntegerType()), T.StructField("cells", T.ArrayType(CELL))])


def cell_text(c: Column) -> Column:
    return F.when(c["t"] == "s", c["s"]).when(c["t"] == "n", text_of(c["n"], T.DoubleType())).when(c["t"] == "b", c["b"].cast("string")).when(c["t"] == "d", text_of(c["d"], T.TimestampNTZType()))


def _blank(c: Column) -> Column:
    return c.isNull() | c["t"].isNull() | ((c["t"] == "s") & (trim(c["s"]) == ""))


def _label(c: Column) -> Column:
    """A text that is no plain number."""
    return ~_blank(c) & (c["t"] == "s") & ~trim(c["s"]).rlike(r"^[0-9]+([.,][0-9]+)?\z")


def header_scores(sheet: DataFrame) -> DataFrame:
    """(row_idx, score, preview) of the first ten rows: 0.2 density, 0.3 labels, 0.2 uniqueness, 0.3 difference from the next row; rows with fewer than two filled cells score 0."""
    top = sheet.where(F.col("row_idx") <= SCAN).select("row_idx", F.coalesce("cells", F.array().cast(T.ArrayType(CELL))).alias("cells"))
    below = F.lead("cells").over(Window.orderBy("row_idx"))
    r = top.withColumn("below", below).withColumn("filled", F.filter("cells", lambda c: ~_blank(c)))
    n = F.size("filled").cast("double")
    density = n / F.greatest(F.size("cells"), F.lit(1))
    labels = F.size(F.filter("filled", _label)) / n
    unique = F.size(F.array_distinct(F.transform("filled", lambda c: F.lower(trim(cell_text(c)))))) / n
    pairs = F.filter(F.zip_with("cells", "below", lambda a, b: F.struct((~_blank(a) & ~_blank(b)).alias("both"), (_label(a) != _label(b)).alias("differ"))), lambda p: p["both"])
    differ = F.when(F.col("below").isNull() | (F.size(pairs) == 0), F.lit(0.0)).otherwise(F.size(F.filter(pairs, lambda p: p["differ"])) / F.size(pairs))
    score = F.when(n < 2, F.lit(0.0)).otherwise(density * 0.2 + labels * 0.3 + unique * 0.2 + differ * 0.3)
    preview = F.transform(F.slice("cells", 1, 6), lambda c: F.when(_blank(c), F.lit("")).otherwise(cell_text(c)))
    return r.where(F.col("row_idx") < SCAN).select("row_idx", score.alias("score"), preview.alias("preview"))


def detect_header_row(sheet: DataFrame) -> DataFrame:
    """One row: header_index (null if in doubt), confidence and the candidates in order.

    The best score wins, the earlier row on ties; a lead of 0.1 or less cuts the confidence to three quarters, and below 0.55 there is no answer.  An empty sheet gives null, 0 and no candidates."""
    s = header_scores(sheet)
    ranked = s.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "row_idx"))).alias("r"), F.sort_array(F.collect_list(F.struct("row_idx", "score", "preview"))).alias("candidates"))
    best, second = F.coalesce(-F.get("r", 0)["neg"], F.lit(0.0)), F.coalesce(-F.get("r", 1)["neg"], F.lit(0.0))
    sure = F.least(F.lit(1.0), best * F.when(best - second > 0.1, 1.0).otherwise(0.75))
    confidence = F.when(best < FLOOR, best).otherwise(sure)
    return ranked.select(F.when((best >= FLOOR) & (sure >= FLOOR), F.get("r", 0)["row_idx"]).alias("header_index"), confidence.alias("confidence"), "candidates")


def headers_of(sheet: DataFrame, header_index: int) -> list[str]:
    """The labels of all columns: trimmed header texts, `Column B` for blank ones; as many as the widest row has cells."""
    width = sheet.agg(F.max(F.size("cells"))).first()[0] or 0
    row = sheet.where(F.col("row_idx") == header_index).select(F.transform("cells", lambda c: F.when(_blank(c), F.lit("")).otherwise(trim(cell_text(c)))).alias("h")).first()
    found = (row[0] if row else None) or []
    return [found[i] if i < len(found) and found[i] else f"Column {column_label(i)}" for i in range(width)]


def to_table(sheet: DataFrame, header_index: int, headers: list[str] | None = None) -> DataFrame:
    """The rows below the header as a flat table: row_idx and one text column per header, repeated headers told apart by position (`Name`, `Name_2`)."""
    headers = headers or headers_of(sheet, header_index)
    names: list[str] = []
    for h in headers:
        k = sum(x == h for x in headers[: len(names)])
        names.append(h if not k else f"{h}_{k + 1}")
    return sheet.where(F.col("row_idx") > header_index).select("row_idx", *[cell_text(F.get("cells", F.lit(i))).alias(n) for i, n in enumerate(names)])
