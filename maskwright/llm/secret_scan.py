"""Secrets in texts: three fixed patterns, and tokens that a battery of randomness tests takes for generated.

A candidate token is a run of 20 or more characters of the base64 alphabets in what the pattern matches leave of a text, and each of
its parts between / _ - that is as long.  Its encoding is the smallest alphabet that holds it.  Three tests look at a candidate twice.

Against the null hypothesis that words and identifiers made it, as p-values that have the token's length and encoding in their null distribution:

* runs: the changes between signs, lower case, upper case and digits, as the likelihood ratio of uniform symbols against the steps of identifiers;
* serial correlation of lag 1: the letters given the ones before them, as the likelihood ratio of uniform symbols against letter pairs of words;
* chi-squared: the symbol counts, whose statistic has the exact mean and variance of that many letters of words.

The two ratios belong to one factorisation of the token's likelihood, so their product is an e-value; the chi-squared p-value is calibrated to another
one, and their mean's inverse is the candidate's p-value.  P-values go through Benjamini-Hochberg over the candidates of a document, separately for
each encoding and weighted by length, as longer tokens are easier to tell: the expected share of false spans stays below the chosen rate however many candidates a text has.

Against the null hypothesis of uniform random symbols of the encoding, as a check of what that leaves: a token that chi-squared (with exact mean and variance, as expected
counts below one are common), the number of runs above and below the alphabet's middle or the lag-1 serial correlation rejects at 0.001 / 3 is no random token.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import erfc, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_of, shipped, texts_of, tidy

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_PART = re.compile(r"[A-Za-z0-9+]+={0,2}")
_NEEDLES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = (
    ("decimal", _DIGITS),
    ("hex", _DIGITS + "abcdef"),
    ("hex", _DIGITS + "ABCDEF"),
    ("base32", "234567" + _UPPER),
    ("base36", _DIGITS + _LOWER),
    ("base36", _DIGITS + _UPPER),
    ("base62", _DIGITS + _LOWER + _UPPER),
    ("base64", _DIGITS + _LOWER + _UPPER + "+/"),
    ("base64url", _DIGITS + _LOWER + _UPPER + "-_"),
    ("base64", _DIGITS + _LOWER + _UPPER + "+/-_"),
)
_SETS = [(name, frozenset(letters), {c: n for n, c in enumerate(letters)}) for name, letters in ALPHABETS]
#: Bits of a step from a sign, lower case, upper case or a digit (rows) to one of them, measured on identifiers and words of Python's standard library; camel case on TypeScript sources.
_STEPS = ((3.5, 0.4, 3.3, 5.0), (5.5, 0.05, 5.2, 8.4), (4.4, 1.3, 0.9, 7.2), (4.0, 2.6, 5.6, 0.4))
#: Half bits (A is none) of the letters a to z at the start of a word and after a to z, measured in equal parts on these sources and on prose in four languages, with a tenth of even odds.
_BIGRAMS = """
    HKIJHJMKIONKKJIKOJHGMMLOPP NLIJMOMOJPNHJFNLQHHGJNOONQ IPNPEQMQLKPEPPHOQLMPHQQQIQ IQNPHPQFHQJIPNFQQLNGLPQQNQ HNOKDPNMGQQLPMHPQKKKKQNPOQ IOJIKLONKPPILGMLNFHINMNJNO
    HPONIJOOFQPJPOEOQGMKIPPQNP HMOQDPKIHQOKOJKPQIIIJOOQQO FMPQDQPKIQPMPLIPQLKJOPNQPP LMJKIJLPOQOJKEHMPLHGPLPNQN EQOQEQQQLQPJQQGPQQHQHQQQQQ KJPOCOMQHQQLQKNOQOINJQKQOQ
    HOPLEHPQHQQHPPHOQPJKIPPQHQ FJQNDQQQIQQNLKHGQPLOLQQQPQ IMJGGNGMKQNLOLINPMHFLNNQOP NMLKOINQLPMKJELKQFKJHNKPQQ FQOOFKQMKQQHPQGJQGKILPOMLP QQQQQQQQQQQNQPPPQOOPAQQQQQ
    HNMLDOMMHQMMLJGOQJJILNOPLP KPJPEOOHIPMLNOJKPNIEKOOOMQ IONPGPQEFQPNPOIOQIKLKPNPKN KMLLFMMNKQPIIGMKPGIHPPPJQQ EQQQCQMQFQQQPPKQQPQQQQQQQQ GNPOIQQDFQQOPKHNQJIPQQPQQQ
    JPGPIOQPJQQJMQLEOMLEQOQMNQ KMNPHPPKJQQJMIIEQLGGNPKQON JMLODPNOIONMMNJNONMLENQQPN
""".split()
_SIGN_BITS, _DIGIT_BITS = 2.0, 3.32


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and not overlapping within a kind; matches that are too short are dropped and still consume their characters."""
    out = []
    raw = text.encode("utf-8", "surrogatepass").lower()
    if any(n in raw for n in _NEEDLES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a maximal run of hex digits has 24 or more exactly if it is matched here
    out += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(out)


def _moments(n: int, size: int, squares: float, cubes: float) -> tuple[float, float]:
    """Exact mean and variance of the chi-squared statistic against `size` equal cells for n independent symbols whose probabilities have these sums of squares and cubes."""
    scale = size / n
    mean = scale * (n + n * (n - 1) * squares) - n
    variance = scale**2 * 2 * n * (n - 1) * (squares + 2 * (n - 2) * cubes - (2 * n - 3) * squares**2)
    return mean, max(variance, 1e-9)


def _chi_z(x: float, mean: float, variance: float) -> float:
    """Standard normal score of a statistic with these moments, by the cube root of the gamma variable that shares them."""
    k = 2 * mean**2 / variance
    return ((max(x, 0.0) / mean) ** (1 / 3) - (1 - 2 / (9 * k))) / sqrt(2 / (9 * k))


def encoding_of(body: str) -> tuple[str, int, dict[str, int]]:
    """(name, number of symbols, their places) of the smallest alphabet that holds a token."""
    letters = set(body)
    return next(((n, len(s), p) for n, s, p in _SETS if letters <= s), ("base64", 66, _SETS[-1][2]))


def _chi_squared(body: str, size: int) -> float:
    counts = np.unique(np.frombuffer(body.encode("latin-1", "replace"), np.uint8), return_counts=True)[1].astype(np.float64)
    return float((counts**2).sum()) * size / len(body) - len(body)


def randomness(token: str) -> tuple[str, float]:
    """(encoding, p) under uniform random symbols of the encoding: the least p-value of the three tests, times three."""
    body = token.rstrip("=")
    name, size, place = encoding_of(body)
    x = np.fromiter(map(place.__getitem__, body), np.float64, len(body))
    n = len(x)
    ps = [erfc(abs(_chi_z(_chi_squared(body, size), *_moments(n, size, 1 / size, 1 / size**2))) / sqrt(2))]
    high = x >= size / 2
    above = int(high.sum())
    below = n - above
    if above and below:
        mean = 1 + 2 * above * below / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + int((high[1:] != high[:-1]).sum())
        ps.append(erfc(abs(runs - mean) / sqrt(2 * var)) if var > 0 else 1.0)
    else:
        ps.append(2.0 ** (1 - n))
    d = x - x.mean()
    power = float((d * d).sum())
    r = float((d[1:] * d[:-1]).sum()) / power if power else 1.0
    ps.append(erfc(abs(r + 1 / n) * sqrt(n) / sqrt(2)))
    return name, min(1.0, 3 * min(ps))


def prose_parts(token: str) -> tuple[float, float]:
    """Bits that the measured statistics of prose and identifiers take to write a token: for the kinds of its symbols, and for the symbols given their kinds."""
    steps, symbols, last, row = 0.0, 0.0, 0, 0
    for c in token:
        kind = 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 if "0" <= c <= "9" else 0
        steps += _STEPS[last][kind]
        if kind == 1 or kind == 2:
            letter = ord(c) - (96 if kind == 1 else 64)
            symbols += (ord(_BIGRAMS[0 if kind == 2 and last == 1 else row][letter - 1]) - 65) / 2
            row = letter
        else:
            symbols += _DIGIT_BITS if kind else _SIGN_BITS
            row = 0
        last = kind
    return steps, symbols


def prose_bits(token: str) -> float:
    return sum(prose_parts(token))


def uniform_bits(token: str) -> float:
    """Bits to write a token as uniform symbols of the smallest alphabet that holds it, and to name the alphabet."""
    return len(token) * log2(encoding_of(token)[1]) + log2(len(_SETS))


@lru_cache(1)
def _letter_sums() -> tuple[float, float]:
    """Sums of the squares and cubes of the letters' shares in words, by the letter pairs' stationary distribution."""
    pairs = np.array([[2.0 ** (-(ord(c) - 65) / 2) for c in row] for row in _BIGRAMS[1:]])
    share = np.full(26, 1 / 26)
    for _ in range(200):
        share = share @ (pairs / pairs.sum(axis=1, keepdims=True))
    return float((share**2).sum()), float((share**3).sum())


def battery(token: str) -> tuple[str, float, float, float]:
    """(encoding, bits of runs, bits of serial correlation, p of chi-squared) against the hypothesis that words and identifiers made the token.

    Bits are log likelihood ratios of uniform symbols: by Markov's inequality 2^-bits bounds each test's p-value, and 2^-sum that of both.  Uniform symbols take their kinds by the
    kinds' shares of the alphabet and then a symbol of the kind; naming the alphabet is charged to the runs."""
    body = token.rstrip("=")
    name, size, _ = encoding_of(body)
    steps, symbols = prose_parts(body)
    kinds = [0, 0, 0, 0]
    for c in body:
        kinds[1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 if "0" <= c <= "9" else 0] += 1
    held = [(k, m) for k, m in zip(kinds, _kinds_of(name, size), strict=True) if k]
    runs = steps - sum(k * log2(size / m) for k, m in held) - log2(len(_SETS))
    serial = symbols - sum(k * log2(m) for k, m in held)
    chi = erfc(-_chi_z(_chi_squared(body, size), *_moments(len(body), size, *_letter_sums())) / sqrt(2)) / 2
    return name, runs, serial, chi


@lru_cache(64)
def _kinds_of(name: str, size: int) -> tuple[int, ...]:
    """Signs, lower-case letters, upper-case letters and digits that tokens of these alphabets can hold, at least one each."""
    letters = "".join(s for n, s in ALPHABETS if n == name and len(s) == size) or ALPHABETS[-1][1]
    return tuple(max(1, len(set(letters) & set(x))) for x in ("+/-_", _LOWER, _UPPER, _DIGITS))


def prose_p(token: str) -> float:
    """The battery's p-value of a token against words and identifiers: the inverse of the mean of two e-values, the likelihood ratio of runs and serial correlation together and
    half the inverse square root of chi-squared's p-value."""
    _, runs, serial, chi = battery(token)
    ratio = 2.0 ** min(1000.0, runs + serial)
    return min(1.0, 2 / (ratio + 0.5 / sqrt(max(chi, 1e-6))))


def _runs(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Candidates of a maximal run: the run, its parts between / _ -, and the stretch of parts that is likest to be random."""
    parts = [(m.start(), m.end()) for m in _PART.finditer(text, start, end)]
    found = {(start, end), *parts}
    best, gain, first = 0.0, 0.0, start
    for s, e in parts:
        if gain <= 0:
            gain, first = 0.0, s
        part = text[s:e].rstrip("=")
        gain += prose_bits(part) - 6 * len(part)
        if gain > best:
            best, stretch = gain, (first, e)
    if best:
        found.add(stretch)
    return sorted(f for f in found if len(text[f[0] : f[1]].rstrip("=")) >= 20)


def _likeliest(text: str, start: int, end: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of the spans of a run, those without overlap that together save most bits against prose; one that is not the whole run takes some to name it among all stretches of parts."""
    parts = sum(1 for _ in _PART.finditer(text, start, end)) if spans else 0
    naming = log2(max(1, parts * (parts + 1) / 2))
    spans = sorted(spans, key=lambda f: (f[1], f[0]))
    ends = [e for _, e in spans]
    best: list[tuple[float, tuple | None]] = [(0.0, None)]  # bits saved by the first spans, and the chosen ones as a chain from the last
    for n, (s, e) in enumerate(spans):
        body = text[s:e].rstrip("=")
        bits, chain = best[bisect_right(ends, s, 0, n)]
        bits += prose_bits(body) - uniform_bits(body) - (naming if (s, e) != (start, end) else 0)
        best.append((bits, (s, e, chain)) if bits > best[-1][0] else best[-1])
    out, chain = [], best[-1][1]
    while chain:
        out.append(chain[:2])
        chain = chain[2]
    return out[::-1]


def random_spans(text: str, taken: list[tuple[int, int, int]], rate: float = 0.001) -> list[tuple[int, int, int]]:
    """Random tokens in what the spans of taken, in order of their starts, leave of a text."""
    gaps, at = [], 0
    for s, _, e in taken:
        if s > at:
            gaps.append((at, s))
        at = max(at, e)
    gaps.append((at, len(text)))
    runs = [(m.span(), _runs(text, *m.span())) for lo, hi in gaps for m in _CANDIDATE.finditer(text, lo, hi)]
    by: dict[str, list[tuple[float, int, int]]] = defaultdict(list)
    for _, run in runs:
        for s, e in run:
            by[encoding_of(text[s:e].rstrip("="))[0]].append((prose_p(text[s:e]), s, e))
    good = set()
    for found in by.values():  # an encoding's candidates are one family; weights have mean 1
        mean = sum(e - s for _, s, e in found) / len(found)
        weighed = sorted((p * mean / (e - s), s, e) for p, s, e in found)
        last = max((n for n, (p, _, _) in enumerate(weighed, 1) if p <= rate * n / len(weighed)), default=0)
        good |= {(s, e) for _, s, e in weighed[:last] if randomness(text[s:e])[1] >= 0.001}
    edges = {edge for s, _, e in taken for edge in (s, e)}
    out = []
    for (lo, hi), run in runs:
        for s, e in _likeliest(text, lo, hi, [f for f in run if f in good]):
            # one sign between a token and the end of its run can be the token's own, unless it parts it from another secret
            out.append((lo if s == lo + 1 and lo not in edges else s, 3, hi if e == hi - 1 and hi not in edges else e))
    return out


def scan_text(text: str | None) -> list[tuple[int, int, int]]:
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + random_spans(text, base))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>), one row per row; offsets are code points, ends exclusive, order by start, then kind as in KINDS.

    A null or empty text has no spans.  Null ids stay null, repeated rows get equal results, other columns are ignored.  Narrow: whole texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for ids, texts in texts_of(batches):
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan_text(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, kind)], names=["id", "spans"])

    out = shipped(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "id long, spans array<struct<kind: string, start: int, end: int>>")
    return out.withColumnRenamed("id", id_col)


def redact_text(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each span, overlapping ones merged, replaced by a mark."""
    spans = scan_text(text)
    out, at = [], 0
    merged: list[list[int]] = []
    for s, _, e in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:] if spans else text


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with the secrets of text_col replaced; all columns, whatever their names, stay, null texts stay null, repeated rows get equal texts; an empty table gives an empty result.

    Only the texts go through Python."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = (redact_text(t, mark) for at, count in parts_of(texts) for t in texts.slice(at, count).to_pylist())
            yield pa.array(found, pa.string())

    return shipped(docs).withColumn(text_col, F.arrow_udf(tidy(run), "string")(F.col(f"`{text_col}`")))
