"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target of words by its weight.  Its documents then all have the same expected number of copies, target / size of the source; the whole
part of it is certain, and the fraction is a copy probability.  Pivotal rounding makes the probabilities integral two units at a time: mass (words) moves at random between
a document and its partner until one of them is at 0 or 1, with chances that keep every expectation, so the words of all units together never change.

Documents go from the longest to the shortest, and a document's partner is the pool of all shorter ones that are still open, whose probabilities move together: so a long
document is settled while others can take what it leaves, and what is open in the end is short.  Where the pool is too small to take a heavy document's mass one way, it goes the other way, if that settles the document:
being near the target comes before the expectation of a document that outweighs the others.

This runs as a reduction tree: a source's documents, in one total order, are dealt out to groups of at most GROUP like cards, so each group has long and short ones; each group settles all its documents but
one; those residuals are grouped again, and so on until a source has one group, whose last document is rounded to the nearer side.  A source's words thus miss its target by half of that one document at most, however many tasks took part.

Order, groups and random numbers depend on the rows alone (the numbers are hashes of ids and texts), not on partitions: reruns agree.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.operators.pseudonym import global_rank

from .common import ascii_words, discard, shipped, stash

#: Rows that one step of the tree settles together, and sources up to which the table of sources is broadcast.
GROUP, FEW_SOURCES = 4096, 100_000
#: A document with a larger share of its group's words is never left open for want of partners.
HEAVY = 0.1
#: Probabilities so near to 0 or 1 are taken for it: sums of doubles end there.
TINY = 1e-12


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit keys, by the finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))).astype(np.float64) / 2.0**64


def settle(sizes: np.ndarray, odds: np.ndarray, keys: np.ndarray, salt: int = 0) -> np.ndarray:
    """Probabilities after pivotal rounding: all 0 or 1 but for at most one, and sum(sizes * odds) as before (up to rounding of doubles).

    sizes: positive; odds: in [0, 1]; keys: 64-bit, the source of randomness.  Rows are taken in the given order, which should be by falling size."""
    out = np.where(odds < TINY, 0.0, np.where(odds > 1 - TINY, 1.0, odds))
    live = np.flatnonzero((out > 0) & (out < 1))
    chance, heavy = _uniform(keys, salt), HEAVY * sizes[live].sum()
    while len(live) > 1:
        first, rest = live[0], live[1:]
        own, size, pool = out[first], sizes[first], out[rest]
        weight = sizes[rest].sum()
        up = min((1 - own) * size, pool.min() * weight)  # the document gains, the pool loses
        down = min(own * size, (1 - pool.max()) * weight)
        settles_up, settles_down = (size > heavy and x for x in (up == (1 - own) * size, down == own * size))
        if settles_up if settles_up != settles_down else chance[first] * (up + down) < down:
            own, pool = own + up / size, pool - up / weight
        else:
            own, pool = own - down / size, pool + down / weight
        snap = lambda x: np.where(x < TINY, 0.0, np.where(x > 1 - TINY, 1.0, x))
        out[first], out[rest] = snap(own), snap(pool)
        # one of the two is integral now: the document, or at least one of the pool
        live = live[(out[live] > 0) & (out[live] < 1)]
    return out


LEVEL = "source_no long, at long, groups long, doc_id long, size long, key long, whole long, odds double"


def _settle_group(table: pa.Table) -> pa.Table:
    """One group of one source, of any order -> its rows with settled odds; the only group of a source rounds its residual too."""
    table = table.sort_by([("size", "descending"), ("at", "ascending")])
    sizes, odds = table.column("size").to_numpy().astype(np.float64), table.column("odds").to_numpy()
    keys = table.column("key").to_numpy().view(np.uint64)
    live = np.flatnonzero(sizes > 0)
    out = np.zeros(len(sizes))
    out[live] = settle(sizes[live], odds[live], keys[live], table.num_rows)
    if table.column("groups")[0].as_py() == 1:
        left = (out > 0) & (out < 1)
        out[left] = out[left] > 0.5
    return table.set_column(table.column_names.index("odds"), "odds", pa.array(out))


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, rank, words) -> with target: share of all words, dealt out by the weights (repeating by rank); a target stops at `most` times its source's words and what is
    over is dealt out again, until none is above.

    A round is one aggregate over the table of sources; there are as many rounds as the excess is dealt out."""
    cap = F.col("words") * F.lit(float(most))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1)
    rows = sources.withColumns({"cap": cap, "weight": weight})
    everything = (rows.agg(F.sum("words")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        capped, number, open_weight = rows.agg(F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.count_if(over), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if number == full or not open_weight:
            break
        full, level = number, (everything - capped) / open_weight
    return rows.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).drop("cap", "weight")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, size (words), source_size, target (its source's), copies, taken (size * copies).

    Sources go by code point, null last, and a null source is one of its own; weights repeat along them.  Null and blank texts have no words and are never taken.  Rows that repeat an id are
    rounded each; equal rows can get different copies, but always the same ones together.  Other columns are ignored; an empty table gives an empty result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(ascii_words(text)).cast("long").alias("size"), F.xxhash64(F.col(id_col).cast("long"), text).alias("key"))
    rows = rows.select("*", F.col("source").isNull().alias("no_source"), (-F.col("size")).alias("shorter"))
    ranked = global_rank(rows, "no_source", "source", "shorter", "key", "doc_id")
    found = ranked.groupBy("no_source", "source").agg(F.min("rank").alias("start"), F.count("*").alias("n"), F.sum("size").alias("words"))
    numbered = global_rank(found, "no_source", "source")
    sources = stash(targets(numbered, weights, share, most), "targets")
    discard(numbered)
    number, largest = sources.agg(F.count("*"), F.max("n")).first()
    copies = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(F.lit(0.0))
    known = sources.select(F.col("source").alias("of"), F.col("rank").alias("source_no"), "start", "n", copies.alias("copies"))
    known = F.broadcast(known) if number <= FEW_SOURCES else known
    at = F.col("rank") - F.col("start")
    whole = F.floor("copies")
    groups = lambda rows: F.expr(f"({rows} + {group - 1}) div {group}")
    level = ranked.join(known, F.col("source").eqNullSafe(F.col("of"))).select("source_no", at.alias("at"), groups("n").alias("groups"), "doc_id", "size", "key", whole.alias("whole"), (F.col("copies") - whole).alias("odds"))
    settled, is_open = None, "odds > 0 and odds < 1"
    for _ in range(_levels(largest or 0, group)):
        done = stash(shipped(level).groupBy("source_no", F.expr("at % groups")).applyInArrow(_settle_group, LEVEL), "settled")
        ready = done.where(f"not ({is_open})")
        settled = ready if settled is None else settled.union(ready)
        # a residual stands for its group: its place among the residuals is the group's number
        level = done.where(is_open).withColumns({"at": F.expr("at % groups"), "groups": groups("groups")})
    discard(ranked)
    names = sources.select(F.col("rank").alias("source_no"), "source", F.col("words").alias("source_size"), "target")
    out = settled.join(F.broadcast(names) if number <= FEW_SOURCES else names, "source_no").withColumn("copies", F.col("whole") + F.col("odds").cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _levels(rows: int, group: int) -> int:
    """Levels of the tree over so many rows."""
    n = 0
    while rows > 1 or not n:
        rows, n = ceil(rows / group), n + 1
    return n
