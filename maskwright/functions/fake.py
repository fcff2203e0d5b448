"""Synthetic values from a 32-bit seed, as expressions.

A seed drives a xorshift generator with shifts 13, 17 and 5; the k-th output d gives a choice among n as (d * n) >> 32, which
is exact in 64-bit integers.  All draws of a value are made by one fold over a short sequence and bound once, so that the expression tree
stays small however often a draw is used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wordlists import CARRIERS, CITIES, FIRST_NAMES, LAST_NAMES, REGION_CODES, STREETS

MASK = 0xFFFFFFFF
FNV_START, FNV_PRIME = 2166136261, 16777619


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fnv_seed(text: Column) -> Column:
    """FNV-1a over the characters of an ASCII text, as a bigint in 32 bits."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(FNV_START).cast("bigint"), step)


def _next(x: Column) -> Column:
    low = lambda v: v.bitwiseAND(F.lit(MASK))
    return let(low(x.bitwiseXOR(F.shiftleft(x, 13))), lambda a: let(a.bitwiseXOR(F.shiftright(a, 17)), lambda b: low(b.bitwiseXOR(F.shiftleft(b, 5)))))


def draws(seed: Column, k: int) -> Column:
    """The first k outputs of the generator, as array<bigint>."""
    start = F.struct(F.when(seed == 0, F.lit(1)).otherwise(seed).cast("bigint").alias("x"), F.array().cast("array<bigint>").alias("o"))
    step = lambda s, _: let(_next(s["x"]), lambda x: F.struct(x.alias("x"), F.concat(s["o"], F.array(x)).alias("o")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step, lambda s: s["o"])


class _Draws:
    """The bound draws of one value, taken in order."""

    def __init__(self, array: Column):
        self.array, self.used = array, 0

    def raw(self) -> Column:
        self.used += 1
        return self.array[self.used - 1]

    def below(self, n: int) -> Column:
        return F.shiftright(self.raw() * F.lit(n).cast("bigint"), 32)

    def pick(self, words: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), (self.below(len(words)) + 1).cast("int"))

    def digits(self, n: int) -> list[Column]:
        return [self.below(10).cast("string") for _ in range(n)]


def _padded(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _name(d: _Draws, locale: str) -> Column:
    first = d.pick(FIRST_NAMES[locale])
    return F.concat(first, F.lit(" "), d.pick(LAST_NAMES[locale]))


def _address(d: _Draws, locale: str) -> Column:
    number = (d.below(200) + 1).cast("string")
    street, city = d.pick(STREETS[locale]), d.pick(CITIES[locale])
    return F.concat(street, F.lit(" No. "), number, F.lit(", "), city) if locale == "id" else F.concat(number, F.lit(" "), street, F.lit(", "), city)


def _phone(d: _Draws, locale: str) -> Column:
    if locale == "en":
        return F.concat(F.lit("+1 555-"), *d.digits(4))
    carrier = d.pick(CARRIERS)
    return F.concat(F.lit("+62 "), carrier, F.lit("-"), *d.digits(4), F.lit("-"), *d.digits(4))


def _email(d: _Draws, locale: str) -> Column:
    return F.concat(F.replace(F.lower(_name(d, locale)), F.lit(" "), F.lit(".")), F.lit("@example.com"))


def _nik(d: _Draws, locale: str) -> Column:
    region, district, female, day, month, year, serial = d.pick(REGION_CODES), d.below(30) + 1, d.raw() < (1 << 31), d.below(28) + 1, d.below(12) + 1, (d.below(45) + 60) % 100, d.below(9999) + 1
    day = F.when(female, day + 40).otherwise(day)
    return F.concat(region, _padded(district, 2), _padded(day, 2), _padded(month, 2), _padded(year, 2), _padded(serial, 4))


def _date(d: _Draws, locale: str) -> Column:
    year, month, day = d.below(50) + 1960, d.below(12) + 1, d.below(28) + 1
    return F.concat(year.cast("string"), F.lit("-"), _padded(month, 2), F.lit("-"), _padded(day, 2))


#: type -> (draws needed, builder)
_KINDS: dict[str, tuple[int, Callable[[_Draws, str], Column]]] = {
    "name": (2, _name),
    "address": (3, _address),
    "phone": (9, _phone),
    "email": (2, _email),
    "nik": (7, _nik),
    "npwp": (16, lambda d, _: F.concat(*d.digits(16))),
    "card": (15, lambda d, _: F.concat(F.lit("4"), *d.digits(15))),
    "date": (3, _date),
}


def break_luhn(card: Column) -> Column:
    """The card number if its checksum is wrong, else with its last digit raised by one (9 becomes 0), which makes it wrong."""
    end = lambda c: ((F.right(c, F.lit(1)).cast("int") + 1) % 10).cast("string")
    return let(card, lambda c: F.when(F.call_function("luhn_check", c), F.concat(F.substring(c, F.lit(1), F.length(c) - 1), end(c))).otherwise(c))


def fake(semantic: str, locale: str, seed: Column) -> Column:
    """A synthetic text of a type; text and unknown get a name.  seed is a bigint from 0 to 2^32 - 1."""
    if semantic == "currency":
        return fake_currency(seed).cast("decimal(38,0)").cast("string")
    count, build = _KINDS.get(semantic, _KINDS["name"])
    return let(draws(seed, count), lambda a: build(_Draws(a), locale))


def fake_currency(seed: Column, original: Column | None = None) -> Column:
    """A double of one leading digit and the magnitude of the original, of a million without one."""
    if original is None:
        power = F.lit(6)
    else:
        size = F.abs(original.cast("double"))
        whole = F.length(F.floor(size).cast("decimal(38,0)").cast("string")) - 1
        power = F.when(size < 1, F.lit(1)).otherwise(F.greatest(F.lit(1), whole))
    return let(draws(seed, 1), lambda a: _Draws(a).below(9) + 1).cast("double") * F.pow(F.lit(10.0), power)
