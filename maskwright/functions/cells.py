"""Cell semantics of spreadsheet tools in Catalyst expressions: text form, blanks, trimming and lengths.

Cells come from an engine that writes 5000000.0 as 5000000, counts text in UTF-16 units and treats every Unicode space as white
space; each function here says where that differs from Spark's own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space, for Java's regular expressions, where \s alone is ASCII.
SPACES = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{SPACES}]"
NOT_WS = f"[^{SPACES}]"

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC)


def is_date_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, DATES)


def text_of(col: Column, dtype: T.DataType) -> Column:
    """The text of a cell: numbers without a trailing .0 or an exponent, dates as ISO 8601 in UTC with milliseconds.

    Doubles keep up to 12 decimals and are written plainly below 1e21 in size; other types are cast."""
    if isinstance(dtype, T.StringType) or isinstance(dtype, INTEGRAL):
        return col.cast("string")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        d = col.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < F.lit(1e21))
        # through the shortest text of the double, not its binary value
        part = F.regexp_replace(F.regexp_replace(d.cast("string").try_cast("decimal(38,12)").cast("string"), "0+$", ""), r"\.$", "")
        return F.when(whole, d.try_cast("decimal(38,0)").cast("string")).otherwise(F.coalesce(part, d.cast("string")))
    if isinstance(dtype, T.DecimalType):
        plain = col.cast("string")
        return F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain)
    if is_date_type(dtype):
        return F.date_format(col.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return col.cast("string")


def display_of(col: Column, dtype: T.DataType) -> Column:
    """The text shown in previews: dates without time, null as an empty string."""
    shown = F.date_format(col.cast("timestamp_ntz"), "yyyy-MM-dd") if is_date_type(dtype) else text_of(col, dtype)
    return F.coalesce(shown, F.lit(""))


def trim(text: Column) -> Column:
    """Both ends without any Unicode white space; Spark's own trim takes U+0020 alone."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def units(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def is_empty(col: Column, dtype: T.DataType) -> Column:
    """No data: null or the empty string; what redaction leaves alone."""
    return (col.isNull() | (col == "")) if isinstance(dtype, T.StringType) else col.isNull()


def is_blank(col: Column, dtype: T.DataType) -> Column:
    """No data for profiling: null, or nothing but white space."""
    return (col.isNull() | (trim(col) == "")) if isinstance(dtype, T.StringType) else col.isNull()


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")
