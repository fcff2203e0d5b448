"""Cells, validators, masks and fakes, value by value."""

import re
from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions import cells, masks, validators
from maskwright.functions.fake import break_luhn, draws, fake, fake_currency, fnv_seed
from maskwright.functions.wordlists import CARRIERS, CITIES, FIRST_NAMES, LAST_NAMES, REGION_CODES, STREETS

S, D, TS = T.StringType(), T.DoubleType(), T.TimestampNTZType()


def run(spark, values, kind, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", kind)]))
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_number_texts(spark):
    values = [5e6, 12345678.0, 1.5, 0.1, -0.0, -2.25, 1e20, 66686.46, 1e-6, None, 123456789.125]
    assert run(spark, values, D, lambda v: cells.text_of(v, D)) == ["5000000", "12345678", "1.5", "0.1", "0", "-2.25", "100000000000000000000", "66686.46", "0.000001", None, "123456789.125"]


def test_date_texts_and_display(spark):
    values = [datetime(1990, 1, 25, 1, 2, 3, 4000), None]
    assert run(spark, values, TS, lambda v: cells.text_of(v, TS)) == ["1990-01-25T01:02:03.004Z", None]
    assert run(spark, values, TS, lambda v: cells.display_of(v, TS)) == ["1990-01-25", ""]
    assert run(spark, [True, None], T.BooleanType(), lambda v: cells.text_of(v, T.BooleanType())) == ["true", None]


def test_unicode_spaces_and_units(spark):
    assert run(spark, [" \t x　﻿", "\n"], S, cells.trim) == ["x", ""]
    assert run(spark, ["Budi😀", "é", ""], S, cells.units) == [6, 1, 0]
    assert run(spark, [None, "", " ", "a"], S, lambda v: cells.is_empty(v, S)) == [True, True, False, False]
    assert run(spark, [None, "", " ", "a"], S, lambda v: cells.is_blank(v, S)) == [True, True, True, False]


CASES = {
    "is_email": (["budi.santoso@example.com", "a+tag@sub.example.co.id", " a@b.co "], ["not an email", "missing@tld", "@nolocal.com", "a b@c.de", "a@b.com\nx"]),
    "is_phone": (["081234567890", "+628123456789", "0812-3456-7890", "+14155552671"], ["2024", "12345", "14155552671", "+123456789"]),
    "is_nik": (["3175012501900001", "3175016501900001"], ["3175019901900001", "3175012599900001", "317501250190", "9975012501900001", "0175012501900001", "", "abc"]),
    "is_npwp": (["091234567890123", "0912345678901234", "09.123.456.7-890.123"], ["12345", ""]),
    "is_card": (["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004"], ["4111111111111112", "411111", "", "abcd"]),
    "is_date_text": (["1990-01-25", "25/01/1990", "01-25-1990", "25 January 1990", "3 Feb 2001"], ["hello", "1990-13-01", "32/32/1990", "25 Foo 1990", "2024"]),
    "looks_like_name": (["Budi Santoso", "Siti Nurul Rahayu", "Élodie Ångström"], ["Budi", "Budi 123", "by the manager", "A B C D E", ""]),
    "looks_like_address": (["Jl. Sudirman No. 45, Jakarta", "123 Main St, Springfield", "Rumah éno. 12 x no 3"], ["Jakarta", "Nothing here at all", "jl 4"]),
}


@pytest.mark.parametrize("name", CASES)
def test_validators(spark, name):
    good, bad = CASES[name]
    check = getattr(validators, name)
    assert run(spark, good, S, check) == [True] * len(good)
    assert run(spark, bad, S, check) == [False] * len(bad)


def test_typed_dates_and_amounts(spark):
    serials = [9999.0, 10000.0, 44000.0, 59999.0, 60000.0, 44000.5, 0.0]
    assert run(spark, serials, D, lambda v: validators.is_date(v, cells.text_of(v, D), D)) == [False, True, True, True, False, False, False]
    assert run(spark, [datetime(2020, 1, 1)], TS, lambda v: validators.is_date(v, cells.text_of(v, TS), TS)) == [True]
    assert run(spark, ["1500000", "Rp 1.500.000", "$1,200.50", "1.000 idr"], S, lambda v: validators.is_currency(v, v, S)) == [True] * 4
    assert run(spark, ["Budi", "Rp", "."], S, lambda v: validators.is_currency(v, v, S)) == [False] * 3
    assert run(spark, [1.5, float("nan")], D, lambda v: validators.is_currency(v, v, D)) == [True, False]


def test_dates_are_not_tax_numbers(spark):
    """A date cell's text has sixteen digits; it is a date all the same."""
    hits = run(spark, [datetime(2020, 1, 1)], TS, lambda v: F.to_json(F.struct(*[c.alias(k) for k, c in validators.value_tests(v, cells.text_of(v, TS), TS).items()])))[0]
    assert [k for k in ("npwp", "nik", "card", "date") if f'"{k}":true' in hits] == ["date"]


def test_embedded(spark):
    values = ["Approved by Budi Santoso i", "call 0812-3456-7890 now", "mail a@b.com please", "nik 3175012501900001 ok", "plain prose, nothing else", "OK 123", "xby Budi Santoso", "éby budi santoso x", None]
    assert run(spark, values, S, validators.find_embedded) == [["name"], ["phone"], ["email"], ["nik"], [], [], [], ["name"], []]


def test_strict_names_need_capitals(spark):
    values = ["approved BY Budi Santoso i", "approved by the manager", "approved by Budi santoso", None]
    assert run(spark, values, S, lambda v: validators.find_embedded(v, strict_names=True)) == [["name"], [], [], []]


def test_broken_checksums(spark):
    values = ["4539578763621486", "4539578763621487", "4111111111111111", "79927398713", None]
    assert run(spark, values, S, break_luhn) == ["4539578763621487", "4539578763621487", "4111111111111112", "79927398714", None]
    assert run(spark, ["0000000000000000", "4000000000000259"], S, lambda v: validators.luhn(break_luhn(v))) == [False, False]


MASKS = [
    ("mask_email", "budi.santoso@example.com", "b***********@example.com"), ("mask_email", "a@b.com", "*@b.com"), ("mask_email", "@b.com", "@*****"), ("mask_email", "x@y@z.com", "x**@z.com"),
    ("mask_phone", "+628123456789", "+6281****6789"), ("mask_phone", "0812-3456-7890", "0812****7890"), ("mask_phone", "12345", "*****"), ("mask_phone", "12-34", "*****"),
    ("mask_phone", "12345678", "******78"), ("mask_phone", "123456789", "*******89"), ("mask_phone", "1234567890", "1234**7890"),
    ("mask_card", "4111 1111 1111 1111", "411111******1111"), ("mask_card", "12345678", "****5678"),
    ("mask_nik", "3175012501900001", "3175**********01"), ("mask_nik", "123", "***"),
    ("mask_npwp", "091234567890123", "09*************"), ("mask_npwp", "1", "1"),
    ("mask_name", "Budi Santoso", "B*** S******"), ("mask_name", "Siti  Nurul", "S***  N****"), ("mask_name", "A", "A"),
    ("mask_address", "Jl. Sudirman No. 45", "Jl. Sudirman No. **"), ("mask_whole", "1500000", "*******"),
    ("mask_generic", "abc", "***"), ("mask_generic", "abcdefgh", "a*******"),
]


def test_masks(spark):
    for name, value, want in MASKS:
        assert run(spark, [value], S, getattr(masks, name)) == [want], (name, value)
    assert run(spark, ["Budi Santoso"], S, lambda v: masks.mask_name(v, "#")) == ["B### S######"]
    assert run(spark, ["a$1"], S, lambda v: masks.mask_address(v, "$")) == ["a$$"]
    assert run(spark, ["25/01/1990", "not a date", "x1990", "2024"], S, lambda v: masks.mask_date(v, v, S)) == ["1990-**-**", "*" * 10, "*****", "2024-**-**"]
    assert run(spark, [date(1990, 1, 25)], T.DateType(), lambda v: masks.mask_date(v, v.cast("string"), T.DateType())) == ["1990-**-**"]


def stepped(value, start, end):
    """The generic mask by giving way one character at a time."""
    n = len(value)
    if n < 4:
        return "*" * n
    start, end = max(0, start), max(0, end)
    while start + end > n // 2:
        if end >= start:
            end -= 1
        else:
            start -= 1
    return value[:start] + "*" * (n - start - end) + value[n - end :] if end else value[:start] + "*" * (n - start)


def test_generic_mask_closed_form(spark):
    values = ["abcdefghijklmnopqrstuvwxyz0123456789"[:n] for n in range(1, 37)]
    for s in (-1, 0, 1, 2, 3, 6, 20):
        for e in (0, 1, 2, 5, 7, 30):
            assert run(spark, values, S, lambda v, s=s, e=e: masks.mask_generic(v, s, e)) == [stepped(v, s, e) for v in values]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00*"), min_size=1, max_size=30), min_size=1, max_size=20), st.integers(0, 20), st.integers(0, 20))
def test_generic_mask_never_shows_more_than_half(spark, values, start, end):
    for value, out in zip(values, run(spark, values, S, lambda v: masks.mask_generic(v, start, end)), strict=True):
        assert len(out) == len(value) and out.count("*") >= (len(value) + 1) // 2


class Model:
    """A plain xorshift generator."""

    def __init__(self, seed):
        self.x = seed or 1

    def next(self):
        x = self.x
        x = (x ^ (x << 13)) & 0xFFFFFFFF
        x ^= x >> 17
        self.x = x = (x ^ (x << 5)) & 0xFFFFFFFF
        return x

    def below(self, n):
        return int(self.next() / 2**32 * n)

    def digits(self, n):
        return "".join(str(self.below(10)) for _ in range(n))

    def value(self, kind, loc):
        pick = lambda words: words[self.below(len(words))]
        if kind in ("name", "text"):
            return f"{pick(FIRST_NAMES[loc])} {pick(LAST_NAMES[loc])}"
        if kind == "email":
            return self.value("name", loc).lower().replace(" ", ".") + "@example.com"
        if kind == "address":
            n = 1 + self.below(200)
            return f"{pick(STREETS[loc])} No. {n}, {pick(CITIES[loc])}" if loc == "id" else f"{n} {pick(STREETS[loc])}, {pick(CITIES[loc])}"
        if kind == "phone":
            return f"+62 {pick(CARRIERS)}-{self.digits(4)}-{self.digits(4)}" if loc == "id" else f"+1 555-{self.digits(4)}"
        if kind == "npwp":
            return self.digits(16)
        if kind == "card":
            return "4" + self.digits(15)
        if kind == "date":
            return f"{1960 + self.below(50)}-{1 + self.below(12):02d}-{1 + self.below(28):02d}"
        region, district, female = pick(REGION_CODES), 1 + self.below(30), self.next() / 2**32 < 0.5
        day = 1 + self.below(28) + (40 if female else 0)
        return f"{region}{district:02d}{day:02d}{1 + self.below(12):02d}{(60 + self.below(45)) % 100:02d}{1 + self.below(9999):04d}"


SEEDS = [0, 1, 5, 9, 11, 2**32 - 1, *(n * 104729 % 2**32 for n in range(200))]


@pytest.mark.parametrize("kind", ["name", "text", "address", "phone", "email", "nik", "npwp", "card", "date"])
@pytest.mark.parametrize("locale", ["id", "en"])
def test_fakes_match_a_plain_generator(spark, kind, locale):
    assert run(spark, SEEDS, T.LongType(), lambda v: fake(kind, locale, v)) == [Model(s).value(kind, locale) for s in SEEDS]


def test_fakes_are_valid(spark):
    assert all(run(spark, SEEDS, T.LongType(), lambda v: validators.is_nik(fake("nik", "id", v))))
    assert all(re.fullmatch(r"[a-z]+\.[a-z]+@example\.com", x) for x in run(spark, SEEDS, T.LongType(), lambda v: fake("email", "id", v)))


def test_draws_and_seeds(spark):
    assert run(spark, [7], T.LongType(), lambda v: draws(v, 5))[0] == [(m := Model(7), [m.next() for _ in range(5)])[1]][0]

    def fnv(text):
        h = 2166136261
        for c in text:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return h

    assert run(spark, ["", "a", "0123456789ab"], S, fnv_seed) == [fnv(""), fnv("a"), fnv("0123456789ab")]


def test_fake_amounts_keep_their_size(spark):
    out = run(spark, [5e6, 999.99, 12.0, 0.5, -70000.0], D, lambda v: fake_currency(F.lit(5).cast("bigint"), v))
    assert [len(str(int(x))) - 1 for x in out] == [6, 2, 1, 1, 4]
    assert run(spark, [5], T.LongType(), lambda v: fake("currency", "id", v))[0].endswith("000000")


# --- SQL text
def _sql_cases():
    from maskwright.functions import fake, masks, validators
    from maskwright.functions.cells import digits, trim, units
    from maskwright.operators.pseudonym import consistent_fake, digest

    one = {"trim": trim, "units": units, "digits": digits, "seed": fake.fnv_seed, "find_embedded": validators.find_embedded, "is_currency_text": lambda t: validators.is_currency(t, t, T.StringType())}
    one |= {n: getattr(validators, n) for n in ("is_email", "is_phone", "is_nik", "is_npwp", "is_card", "is_date_text", "looks_like_name", "looks_like_address")}
    out = {f"mw_{n}(v)": f for n, f in one.items()}
    for n in ("generic", "email", "phone", "card", "nik", "npwp", "name", "address", "whole"):
        out[f"mw_mask_{n}(v)"] = getattr(masks, f"mask_{n}")
        out[f"mw_mask_{n}(v, mark => '#$')"] = lambda t, n=n: getattr(masks, f"mask_{n}")(t, mark="#$")
    out["mw_mask_generic(v, 6, 3)"] = lambda t: masks.mask_generic(t, 6, 3)
    out["mw_mask_generic(v, 2, 5)"] = lambda t: masks.mask_generic(t, 2, 5)
    out["mw_mask_date_text(v)"] = lambda t: masks.mask_date(t, t, T.StringType())
    out["mw_digest(v, 's')"] = lambda t: digest(t, "s")
    out["mw_digest(v, 's', 99)"] = lambda t: digest(t, "s", 99)
    out["mw_draws(mw_seed(v), 4)"] = lambda t: fake.draws(fake.fnv_seed(t), 4)
    for kind in ("name", "address", "phone", "email", "nik", "npwp", "card", "date"):
        for locale in ("id", "en"):
            out[f"mw_fake_{kind}(v, 's', '{locale}')"] = lambda t, k=kind, loc=locale: consistent_fake(t, k, loc, "s")
    return out


SQL_TEXTS = [
    "", " ", "a", "ab@c.de", " budi.santoso@example.com\t", "x@y", "+628123456789", "0812-3456-7890", "62 812 345", "3175023112900001", "3175027112900001", "4111 1111 1111 1111", "4111111111111112", "01.234.567.8-901.000", "1990-13-25", "1990-12-25", "31/12/1999", "13/13/1999", "25 January 1990",
    "Rp 5.000", "$12,5 usd", "Budi Santoso", "budi", "Ágnes Ödön", "Jl. Merdeka No. 5", "Jalan", "call 0812 3456 7890 or mail x@y.org", "Approved by Budi Santoso in May", " Budi　", "Budi\U0001f600 Joy", "it's a 'quoted' \\ text", "line\nbreak 1987", "abcdefghijklmnop", None,
]


@pytest.mark.parametrize("call", sorted(_sql_cases()))
def test_sql_text_gives_what_the_column_gives(spark, call):
    from maskwright.functions.sql import register_sql

    if not spark.catalog.functionExists("mw_mask_whole"):
        register_sql(spark)
    df = spark.createDataFrame([(n, v) for n, v in enumerate(SQL_TEXTS)], "n int, v string")
    df.createOrReplaceTempView("sql_texts")
    want = df.select("n", _sql_cases()[call](F.col("v")).alias("out")).orderBy("n").collect()
    got = spark.sql(f"SELECT n, {call} AS out FROM sql_texts ORDER BY n")
    assert got.collect() == want
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_every_sql_function_is_covered():
    from maskwright.functions.sql import FUNCTIONS

    assert {f.name for f in FUNCTIONS} - {"times"} == {c.split("(")[0].removeprefix("mw_") for c in _sql_cases()}
