"""How the filters of a corpus overlap: what every order of applying them removes at every step, and each filter's Shapley share.

The documents of a part are counted by the set of filters that they fail (a mask).  With x_i for "filter i is applied", the documents removed are the
multilinear polynomial

    R(x) = sum over masks m of n_m * (1 - product over i in m of (1 - x_i)).

Its corners are the removals of every set of filters, so any order's steps are differences of corners.  Its partial derivative along the diagonal,
integrated from 0 to 1, is filter i's Shapley value; with the polynomial in monomials that is the sum of a_T / |T| over the monomials T that hold i, in exact rationals.

Only the counts depend on the data: one narrow pass over the texts, a search for texts that a smaller id has too, and one aggregate of at most 2^filters rows a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, shipped, stash, tidy

#: The contract's special signs and limits are fixed values.
SIGNS = "[#$%&*|]"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on a text that is not null: few words, few distinct words, many capitals, special signs."""
    words = ascii_words(text)
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": F.size(words) < 200, "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50, "C": capitals * 100 > F.char_length(text) * 3, "D": text.rlike(SIGNS)}


def removal_polynomial(counts: dict[int, int], filters: int) -> list[int]:
    """Coefficients of R by monomial, the set of its variables as bits: those of n_m * (1 - product of (1 - x_i)) summed over masks."""
    out = [0] * (1 << filters)
    for mask, n in counts.items():
        term = mask
        while term:  # all non-empty subsets of the mask
            out[term] += n if term.bit_count() % 2 else -n
            term = (term - 1) & mask
    return out


def corners(polynomial: list[int]) -> list[int]:
    """R at every corner: the sum of the coefficients of the subsets of each set."""
    out = list(polynomial)
    bit = 1
    while bit < len(out):
        for at in range(len(out)):
            if at & bit:
                out[at] += out[at ^ bit]
        bit <<= 1
    return out


def shapley(polynomial: list[int], variable: int) -> Fraction:
    """The integral of the partial derivative by a variable along the diagonal from 0 to 1."""
    return sum((Fraction(c, t.bit_count()) for t, c in enumerate(polynomial) if t >> variable & 1), Fraction(0))


def order_rows(names: str, counts: dict[int, int], losses: list[dict[int, int]]) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, a count for each of losses, shapley times the number of orders) for all orders of the filters."""
    n, all_set = len(names), (1 << len(names)) - 1
    polynomial = removal_polynomial(counts, n)
    gone = corners(polynomial)
    lost = [corners(removal_polynomial(c, n)) for c in losses]
    total = sum(counts.values())
    share = [shapley(polynomial, i) * factorial(n) for i in range(n)]
    assert all(s.denominator == 1 for s in share)
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = gone[after] - gone[before]
            yield "".join(names[k] for k in order), step, total - gone[after], removed, gone[1 << i] - removed, gone[all_set] - gone[all_set ^ 1 << i], *[x[after] - x[before] for x in lost], share[i].numerator
            before = after


def repeated_texts(rows: DataFrame) -> DataFrame:
    """(doc_id, digest) of a row -> repeats: whether a smaller doc_id has the same digest.

    The least id of a digest is a partial aggregate, one row a task for a group of copies; rows are then joined by (id, digest), so no task gets all copies of a text.
    Null ids are not larger than any, so they repeat nothing."""
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first")).select(F.col("first").alias("doc_id"), "digest", F.lit(True).alias("is_first"))
    return rows.join(firsts, ["doc_id", "digest"], "left").withColumn("repeats", F.col("is_first").isNull() & F.col("doc_id").isNotNull()).drop("is_first")


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask) of each row: bits 0 to 3 for the text filters, bit 4 for a text that a smaller id has too, anywhere in the table.  Texts are told apart by their SHA-256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = sum((F.when(fails, 1 << n).otherwise(0) for n, fails in enumerate(text_filters(text).values())), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), bits.alias("bits"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return repeated_texts(stash(rows, "marks")).select("doc_id", "part", (F.col("bits") + F.when(F.col("repeats"), 16).otherwise(0)).alias("mask"))


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interaction_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step: the columns of AUDIT.

    A part is a value of part_col, the empty string for null.  A null text is empty: it fails A and nothing else but E.  labels (doc_id, quality, toxic): a document is good (toxic) if any of its
    labels says 1; rows without an id or label are neither.  Rows that repeat an id count each and are no repeats of each other.  Other columns are ignored; an
    empty table gives an empty result."""
    masks = failure_masks(docs, id_col, text_col, part_col)
    says = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("good or toxic")
    counted = masks.join(says, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    by_part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # at most 32 each
    names = [c.split()[0] for c in AUDIT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, good, toxic = ({c["mask"]: c[k] for c in counts} for k in ("n", "good", "toxic"))
                found = list(zip(*order_rows("ABCDE", n, [good, toxic]), strict=True))
                columns = [pa.array([part] * len(found[0])), pa.array(found[0]), pa.array(found[1], pa.int32()), *[pa.array(c, pa.int64()) for c in found[2:]]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return shipped(by_part).mapInArrow(tidy(run), AUDIT)
