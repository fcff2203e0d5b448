"""Value-shape predicates: does a whole cell look like an email, a phone number, an identity number and so on.

Every function takes the cell's text (see cells.text_of) and gives a boolean Column, null for null.  Word boundaries are ASCII ones, `\\z` is
the very end, and digits sliced out of a text are cast leniently, as ANSI mode would raise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cells import NOT_WS, SPACES, WS, digits, is_date_type, is_number, trim, units

_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

# Which words mark an address, which words come before a name in running text, and months.
ADDRESS_WORDS = r"jl\.?|jalan|gang|gg\.?|blok|rt|rw|no\.?|street|st\.?|avenue|ave\.?|road|rd\.?|drive|dr\.?|lane|ln\.?|blvd"
NAME_LEADS = r"by|oleh|dari|kepada|a\.?n\.?|atas nama|pic|contact|hubungi|penanggung jawab"
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


def _int(text: Column) -> Column:
    return text.try_cast("int")


def is_email(text: Column) -> Column:
    return trim(text).rlike(rf"^[^{SPACES}@]+@[^{SPACES}@.]+\.[^{SPACES}@]{{2,}}\z")


def is_phone(text: Column) -> Column:
    s = trim(text)
    n = F.length(digits(s))
    bare = F.regexp_replace(s, rf"[{SPACES}().-]", "")
    return s.rlike(rf"^\+?[0-9{SPACES}().-]{{8,20}}\z") & n.between(8, 15) & (bare.rlike(r"^(0|62|\+62)8") | (s.startswith("+") & (n >= 10)))


def is_nik(text: Column) -> Column:
    d = digits(text)
    day, month, province = (_int(F.substring(d, a, 2)) for a in (7, 9, 1))
    day = F.when(day > 40, day - 40).otherwise(day)
    good = (F.length(d) == 16) & ~d.startswith("0") & day.between(1, 31) & month.between(1, 12) & province.between(11, 96)
    return F.when(text.isNotNull(), F.coalesce(good, F.lit(False)))


def is_npwp(text: Column) -> Column:
    return F.length(digits(text)).isin(15, 16)


def luhn(number: Column) -> Column:
    """Checksum of a text of digits; other characters make it false."""
    return F.call_function("luhn_check", number)


def is_card(text: Column) -> Column:
    d = F.regexp_replace(text, rf"[{SPACES}-]", "")
    return d.rlike(r"^[0-9]{13,19}\z") & luhn(d)


def is_date_text(text: Column) -> Column:
    s = trim(text)
    iso = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\z"
    short = r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})\z"
    part = lambda pattern, n: _int(F.nullif(F.regexp_extract(s, pattern, n), F.lit("")))
    y_m_d = part(iso, 2).between(1, 12) & part(iso, 3).between(1, 31)
    a, b = part(short, 1), part(short, 2)
    either = (a.between(1, 31) & b.between(1, 12)) | (b.between(1, 31) & a.between(1, 12))
    named = s.rlike(rf"(?i)^(0?[1-9]|[12][0-9]|3[01]){WS}+({MONTHS})[a-z]{{0,6}}{WS}+[0-9]{{4}}\z")
    return F.when(s.rlike(iso), F.coalesce(y_m_d, F.lit(False))).when(s.rlike(short), F.coalesce(either, F.lit(False))).otherwise(named)


def is_date(col: Column, text: Column, dtype: T.DataType) -> Column:
    """Dates by type, whole numbers that are plausible spreadsheet day counts, or texts that look like dates."""
    if is_date_type(dtype):
        return col.isNotNull()
    if is_number(dtype):
        return (col >= 10000) & (col < 60000) & (col == F.floor(col))
    return is_date_text(text)


def is_currency(col: Column, text: Column, dtype: T.DataType) -> Column:
    if is_number(dtype):
        d = col.cast("double")
        return col.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
    s = trim(text)
    return s.rlike(rf"(?i)^(Rp|IDR|USD|\$|€|£)?{WS}?-?[0-9.,]+({WS}?(Rp|IDR|USD))?\z") & s.rlike("[0-9]")


def looks_like_name(text: Column) -> Column:
    """Two to four capitalised words without digits."""
    return trim(text).rlike(rf"^[A-ZÀ-ɏ][a-zÀ-ɏ.'-]*({WS}+[A-ZÀ-ɏ][a-zÀ-ɏ.'-]*){{1,3}}\z")


def looks_like_address(text: Column) -> Column:
    s = trim(text)
    return (units(s) >= 10) & s.rlike(f"(?i){_B}({ADDRESS_WORDS})" + r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")


#: (type, predicate over (cell, text, dtype), whether the header has to agree), most specific first; ties go to the earlier type.  plans.registry adds to it.
VALUE_TESTS: list[tuple[str, Callable[[Column, Column, T.DataType], Column], bool]] = [
    ("email", lambda c, t, d: is_email(t), False),
    ("nik", lambda c, t, d: is_nik(t), False),
    ("card", lambda c, t, d: is_card(t), False),
    ("npwp", lambda c, t, d: is_npwp(t), False),
    ("phone", lambda c, t, d: is_phone(t), False),
    ("date", is_date, False),
    ("address", lambda c, t, d: looks_like_address(t), False),
    ("name", lambda c, t, d: looks_like_name(t), False),
    ("currency", is_currency, True),
]


def value_tests(col: Column, text: Column, dtype: T.DataType) -> dict[str, Column]:
    """type -> whether the cell matches.  Cells that are dates by type are tested as dates alone: their digits would pass for a tax number."""
    only_date = is_date_type(dtype)
    return {kind: (F.coalesce(test(col, text, dtype), F.lit(False)) if kind == "date" or not only_date else F.lit(False)) for kind, test, _ in VALUE_TESTS}


# Patterns of personal data inside running text, in the order in which ties are settled within one cell.
EMBEDDED: list[tuple[str, str]] = [
    ("email", rf"(?i)[^{SPACES}@]+@[^{SPACES}@.]+\.[a-z]{{2,}}"),
    ("phone", rf"(?:\+?62|0)8[0-9]{{2}}[{SPACES}.-]?[0-9]{{3,4}}[{SPACES}.-]?[0-9]{{3,5}}"),
    ("nik", rf"{_B}[0-9]{{16}}{_E}"),
    ("name", rf"(?i){_B}(?:{NAME_LEADS})(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))[:{SPACES}]+[A-Z][a-z]+{WS}+[A-Z][a-z]+"),
]

#: A name after a leading word in any case, with two capitalised words.
STRICT_NAME = dict(EMBEDDED)["name"].replace("(?i)", "").replace(f"(?:{NAME_LEADS})", f"(?i:{NAME_LEADS})")


def find_embedded(text: Column, strict_names: bool = False) -> Column:
    """The kinds of personal data inside a text of 12 or more units, as an array; empty for null.  With strict_names both words of a name must be capitalised."""
    # an address needs an @, and looking for one is much cheaper than the pattern
    patterns = {**dict(EMBEDDED), **({"name": STRICT_NAME} if strict_names else {})}
    hits = {kind: text.contains("@") & text.rlike(pattern) if kind == "email" else text.rlike(pattern) for kind, pattern in patterns.items()}
    found = F.array_compact(F.array(*[F.when(hit, F.lit(kind)) for kind, hit in hits.items()]))
    return F.when(text.isNull() | (units(text) < 12), F.array().cast("array<string>")).otherwise(found)


__all__ = [n for n in dir() if n.startswith(("is_", "looks_")) or n in ("luhn", "find_embedded", "VALUE_TESTS", "EMBEDDED", "value_tests", "NOT_WS")]
