"""The library's functions by name in SQL text: `register_sql(spark)` makes them temporary SQL functions of a session.

    spark.sql("SELECT mw_digest(c_name, 'salt') AS id, mw_mask_email(email) AS email FROM customer WHERE mw_is_email(email)")

Each is a CREATE TEMPORARY FUNCTION ... RETURN, so Catalyst puts its body into the query's own plan: no UDF call, no Python.  Bodies are built of each other, from the same fixed values as the
Column functions, and give the same results (tests hold every one against its Column).  Arguments with defaults can be left out; a null text gives null, as everywhere.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .cells import NOT_WS, SPACES, WS
from .fake import FNV_PRIME, FNV_START, MASK
from .validators import ADDRESS_WORDS, EMBEDDED, MONTHS
from .wordlists import CARRIERS, CITIES, FIRST_NAMES, LAST_NAMES, REGION_CODES, STREETS

PREFIX = "mw_"


@dataclass(frozen=True)
class SqlFunction:
    """A function of one expression: its name without the prefix, parameters, type and body, in which {mw} stands for the prefix."""

    name: str
    parameters: str
    returns: str
    body: str

    def statement(self, prefix: str) -> str:
        return f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{self.name}({self.parameters}) RETURNS {self.returns} RETURN {self.body.replace('{mw}', prefix)}"


def _words(words: list[str]) -> str:
    return "array(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _by_locale(lists: dict[str, list[str]]) -> str:
    return f"IF(locale = 'en', {_words(lists['en'])}, {_words(lists['id'])})"


def _edge(pattern: str) -> str:
    """A word boundary of ASCII words, after a pattern that can end in a dot."""
    return pattern + r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


_T, _M = "t STRING", "t STRING, mark STRING DEFAULT '*'"
_ISO, _SHORT = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\z", r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})\z"


def _part(pattern: str, n: int) -> str:
    return f"try_cast(nullif(regexp_extract({{mw}}trim(t), r'{pattern}', {n}), '') AS INT)"


def _cells() -> list[SqlFunction]:
    return [
        SqlFunction("trim", _T, "STRING", rf"regexp_replace(t, r'^{WS}+|{WS}+\z', '')"),
        SqlFunction("units", _T, "INT", "CAST(octet_length(encode(t, 'UTF-16BE')) / 2 AS INT)"),
        SqlFunction("digits", _T, "STRING", "regexp_replace(t, '[^0-9]', '')"),
        SqlFunction("times", "mark STRING, n INT", "STRING", "repeat(mark, greatest(n, 0))"),
    ]


def _validators() -> list[SqlFunction]:
    day = "try_cast(substring({mw}digits(t), 7, 2) AS INT)"
    nik = rf"length({{mw}}digits(t)) = 16 AND NOT startswith({{mw}}digits(t), '0') AND IF({day} > 40, {day} - 40, {day}) BETWEEN 1 AND 31 AND try_cast(substring({{mw}}digits(t), 9, 2) AS INT) BETWEEN 1 AND 12 AND try_cast(substring({{mw}}digits(t), 1, 2) AS INT) BETWEEN 11 AND 96"
    a, b = _part(_SHORT, 1), _part(_SHORT, 2)
    named = rf"(?i)^(0?[1-9]|[12][0-9]|3[01]){WS}+({MONTHS})[a-z]{{0,6}}{WS}+[0-9]{{4}}\z"
    looked_for = {"email": "contains(t, '@') AND "}  # cheaper than the pattern
    kinds = ", ".join(f"IF({looked_for.get(kind, '')}rlike(t, r'{pattern}'), '{kind}', NULL)" for kind, pattern in EMBEDDED)
    return [
        SqlFunction("is_email", _T, "BOOLEAN", rf"rlike({{mw}}trim(t), r'^[^{SPACES}@]+@[^{SPACES}@.]+\.[^{SPACES}@]{{2,}}\z')"),
        SqlFunction(
            "is_phone", _T, "BOOLEAN",
            rf"rlike({{mw}}trim(t), r'^\+?[0-9{SPACES}().-]{{8,20}}\z') AND length({{mw}}digits(t)) BETWEEN 8 AND 15 AND (rlike(regexp_replace({{mw}}trim(t), r'[{SPACES}().-]', ''), r'^(0|62|\+62)8') OR (startswith({{mw}}trim(t), '+') AND length({{mw}}digits(t)) >= 10))",
        ),
        SqlFunction("is_nik", _T, "BOOLEAN", f"IF(t IS NULL, NULL, coalesce({nik}, false))"),
        SqlFunction("is_npwp", _T, "BOOLEAN", "length({mw}digits(t)) IN (15, 16)"),
        SqlFunction("is_card", _T, "BOOLEAN", rf"rlike(regexp_replace(t, r'[{SPACES}-]', ''), r'^[0-9]{{13,19}}\z') AND luhn_check(regexp_replace(t, r'[{SPACES}-]', ''))"),
        SqlFunction(
            "is_date_text", _T, "BOOLEAN",
            rf"CASE WHEN rlike({{mw}}trim(t), r'{_ISO}') THEN coalesce({_part(_ISO, 2)} BETWEEN 1 AND 12 AND {_part(_ISO, 3)} BETWEEN 1 AND 31, false) WHEN rlike({{mw}}trim(t), r'{_SHORT}') THEN coalesce(({a} BETWEEN 1 AND 31 AND {b} BETWEEN 1 AND 12) OR ({b} BETWEEN 1 AND 31 AND {a} BETWEEN 1 AND 12), false) ELSE rlike({{mw}}trim(t), r'{named}') END",
        ),
        SqlFunction("is_currency_text", _T, "BOOLEAN", rf"rlike({{mw}}trim(t), r'(?i)^(Rp|IDR|USD|\$|€|£)?{WS}?-?[0-9.,]+({WS}?(Rp|IDR|USD))?\z') AND rlike(t, '[0-9]')"),
        SqlFunction("looks_like_name", _T, "BOOLEAN", rf'rlike({{mw}}trim(t), r"^[A-ZÀ-ɏ][a-zÀ-ɏ.\x27-]*({WS}+[A-ZÀ-ɏ][a-zÀ-ɏ.\x27-]*){{1,3}}\z")'),
        SqlFunction("looks_like_address", _T, "BOOLEAN", "{mw}units({mw}trim(t)) >= 10 AND rlike({mw}trim(t), r'" + _edge(f"(?i)(?<![A-Za-z0-9_])({ADDRESS_WORDS})") + "')"),
        SqlFunction("find_embedded", _T, "ARRAY<STRING>", f"IF(t IS NULL OR {{mw}}units(t) < 12, CAST(array() AS ARRAY<STRING>), array_compact(array({kinds})))"),
    ]


def _masks() -> list[SqlFunction]:
    local = r"regexp_extract(t, r'(?s)^(.+)(@[^@]*)\z', 1)"
    most = "floor(char_length(t) / 2)"
    fits = f"greatest(keep_start, 0) + greatest(keep_end, 0) <= {most}"
    start = f"CAST(IF({fits}, greatest(keep_start, 0), least(greatest(keep_start, 0), greatest({most} - greatest(keep_end, 0), ceil({most} / 2)))) AS INT)"
    end = f"CAST(IF({fits}, greatest(keep_end, 0), least(greatest(keep_end, 0), greatest({most} - greatest(keep_start, 0), floor({most} / 2)))) AS INT)"
    n = "length({mw}digits(t))"
    return [
        SqlFunction("mask_generic", "t STRING, keep_start INT DEFAULT 1, keep_end INT DEFAULT 0, mark STRING DEFAULT '*'", "STRING", f"IF(char_length(t) < 4, {{mw}}times(mark, char_length(t)), concat(substr(t, 1, {start}), {{mw}}times(mark, char_length(t) - {start} - {end}), right(t, {end})))"),
        SqlFunction("mask_email", _M, "STRING", rf"IF(rlike(t, r'(?s)^(.+)(@[^@]*)\z'), concat(IF({{mw}}units({local}) > 1, substr({local}, 1, 1), ''), {{mw}}times(mark, greatest({{mw}}units({local}) - 1, 1)), regexp_extract(t, r'(?s)^(.+)(@[^@]*)\z', 2)), {{mw}}mask_generic(t, 1, 0, mark))"),
        SqlFunction("mask_phone", _M, "STRING", f"CASE WHEN {n} < 6 THEN {{mw}}times(mark, {{mw}}units(t)) ELSE concat(IF(startswith(regexp_replace(t, r'^{WS}+', ''), '+'), '+', ''), IF({n} <= 9, {{mw}}mask_generic({{mw}}digits(t), 0, 2, mark), concat(left({{mw}}digits(t), 4), {{mw}}times(mark, {n} - 8), right({{mw}}digits(t), 4)))) END"),
        SqlFunction("mask_card", _M, "STRING", f"IF({n} < 12, {{mw}}mask_generic({{mw}}digits(t), 0, 4, mark), concat(left({{mw}}digits(t), 6), {{mw}}times(mark, {n} - 10), right({{mw}}digits(t), 4)))"),
        SqlFunction("mask_nik", _M, "STRING", f"IF({n} <> 16, {{mw}}mask_generic({{mw}}digits(t), 4, 2, mark), concat(left({{mw}}digits(t), 4), repeat(mark, 10), right({{mw}}digits(t), 2)))"),
        SqlFunction("mask_npwp", _M, "STRING", f"concat(left({{mw}}digits(t), 2), {{mw}}times(mark, {n} - 2))"),
        SqlFunction("mask_date_text", _M, "STRING", "IF(rlike(t, r'(?<![A-Za-z0-9_])(19|20)[0-9]{2}(?![A-Za-z0-9_])'), concat(regexp_extract(t, r'(?<![A-Za-z0-9_])((?:19|20)[0-9]{2})(?![A-Za-z0-9_])', 1), '-', repeat(mark, 2), '-', repeat(mark, 2)), {mw}times(mark, {mw}units(t)))"),
        SqlFunction("mask_name", _M, "STRING", f"regexp_replace(t, r'(?<={NOT_WS}){NOT_WS}', replace(replace(mark, r'\\', r'\\\\'), '$', r'\\$'))"),
        SqlFunction("mask_address", _M, "STRING", "regexp_replace(t, '[0-9]', replace(replace(mark, r'\\', r'\\\\'), '$', r'\\$'))"),
        SqlFunction("mask_whole", _M, "STRING", "{mw}times(mark, {mw}units(t))"),
    ]


def _pseudonyms() -> list[SqlFunction]:
    low, given = f"& {MASK}L", "t STRING, salt STRING, locale STRING DEFAULT 'id'"
    step = f"transform(transform(transform(array(element_at(o, -1)), v -> (v ^ shiftleft(v, 13)) {low}), v -> v ^ shiftright(v, 17)), v -> (v ^ shiftleft(v, 5)) {low})[0]"
    draws = lambda n: f"{{mw}}draws({{mw}}seed({{mw}}digest(t, salt)), {n})"
    below = lambda k, n: f"shiftright(d[{k}] * {n}L, 32)"
    pick = lambda k, words, n: f"element_at({words}, CAST({below(k, n)} + 1 AS INT))"
    by_size = lambda k, lists: f"element_at({_by_locale(lists)}, CAST(shiftright(d[{k}] * IF(locale = 'en', {len(lists['en'])}L, {len(lists['id'])}L), 32) + 1 AS INT))"
    digits = lambda first, n: ", ".join(f"CAST({below(first + i, 10)} AS STRING)" for i in range(n))
    two = lambda x: f"lpad(CAST({x} AS STRING), 2, '0')"
    once = lambda n, body: f"IF(t IS NULL, NULL, element_at(transform(array({draws(n)}), d -> {body}), 1))"
    name = f"concat({by_size(0, FIRST_NAMES)}, ' ', {by_size(1, LAST_NAMES)})"
    number = f"CAST({below(0, 200)} + 1 AS STRING)"
    street, city = by_size(1, STREETS), by_size(2, CITIES)
    return [
        SqlFunction("digest", "t STRING, salt STRING, length INT DEFAULT 12", "STRING", "substring(sha2(concat(salt, t), 256), 1, least(64, greatest(4, length)))"),
        SqlFunction("seed", _T, "BIGINT", f"aggregate(filter(split(t, ''), c -> c <> ''), {FNV_START}L, (h, c) -> ((h ^ CAST(ascii(c) AS BIGINT)) * {FNV_PRIME}L) {low})"),
        SqlFunction("draws", "seed BIGINT, k INT", "ARRAY<BIGINT>", f"aggregate(sequence(1, k), array(IF(seed = 0, 1L, seed)), (o, i) -> concat(o, array({step})), o -> slice(o, 2, k))"),
        SqlFunction("fake_name", given, "STRING", once(2, name)),
        SqlFunction("fake_address", given, "STRING", once(3, f"IF(locale = 'en', concat({number}, ' ', {street}, ', ', {city}), concat({street}, ' No. ', {number}, ', ', {city}))")),
        SqlFunction("fake_phone", given, "STRING", once(9, f"IF(locale = 'en', concat('+1 555-', {digits(0, 4)}), concat('+62 ', {pick(0, _words(CARRIERS), len(CARRIERS))}, '-', {digits(1, 4)}, '-', {digits(5, 4)}))")),
        SqlFunction("fake_email", given, "STRING", once(2, f"concat(replace(lower({name}), ' ', '.'), '@example.com')")),
        SqlFunction("fake_nik", given, "STRING", once(7, f"concat({pick(0, _words(REGION_CODES), len(REGION_CODES))}, {two(f'{below(1, 30)} + 1')}, {two(f'IF(d[2] < {1 << 31}L, 40, 0) + {below(3, 28)} + 1')}, {two(f'{below(4, 12)} + 1')}, {two(f'({below(5, 45)} + 60) % 100')}, lpad(CAST({below(6, 9999)} + 1 AS STRING), 4, '0'))")),
        SqlFunction("fake_npwp", given, "STRING", once(16, f"concat({digits(0, 16)})")),
        SqlFunction("fake_card", given, "STRING", once(15, f"concat('4', {digits(0, 15)})")),
        SqlFunction("fake_date", given, "STRING", once(3, f"concat(CAST({below(0, 50)} + 1960 AS STRING), '-', {two(f'{below(1, 12)} + 1')}, '-', {two(f'{below(2, 28)} + 1')})")),
    ]


FUNCTIONS: list[SqlFunction] = [*_cells(), *_validators(), *_masks(), *_pseudonyms()]


def sql_predicate(spark: SparkSession, name: str, condition: str, prefix: str = PREFIX) -> Callable[[Column], Column]:
    """A predicate from SQL text over a text `t`, which may call this module's functions: makes it the session's function {prefix}is_{name} and returns it for Columns, as plans.registry takes it."""
    function = SqlFunction(f"is_{name}", _T, "BOOLEAN", f"coalesce({condition}, false)")
    spark.sql(function.statement(prefix))
    return lambda text: F.call_function(f"{prefix}is_{name}", text)


def register_sql(spark: SparkSession, prefix: str = PREFIX) -> list[str]:
    """Makes all functions temporary ones of the session, replacing earlier ones of the same names, and returns their names."""
    for f in FUNCTIONS:
        spark.sql(f.statement(prefix))
    return [prefix + f.name for f in FUNCTIONS]
