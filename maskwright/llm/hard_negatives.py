"""Hard negatives by branch and bound over ball trees: for an anchor and each of its best positives, the best rows of other labels whose score lies in a window below the positive's.

Scores are inner products of integer vectors.  Rows are ordered by label and cut into chunks of bounded bytes; every chunk becomes a ball tree in the memory of one task.  For a query q, a node
of centre c and radius r holds scores within q.c - |q| r and q.c + |q| r only.  A node is pruned if that interval lies outside a query's score window (above or below), if it
is strictly beneath the query's current kth score (a tie could still win by its id), or if its labels can't match.  Leaves that are left are scored exactly.

Queries are dealt out to all chunks that can hold a match (for positives those of the anchor's label, for negatives all that hold another one) and stream past the tree batch by
batch, behind the chunk's rows in one sorted partition: a task holds a chunk and a batch, however many anchors there are.  Each chunk answers with at most k rows a window, and the first k of these answers are the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.operators.pseudonym import global_rank

from .common import discard, shipped, shuffle_width, stash, tidy

#: Bytes of a chunk's vectors at most, rows of a chunk at least, and rows of a leaf.
CHUNK_BYTES, LEAST_ROWS, LEAF = 64 << 20, 2048, 64
LOW, HIGH = -(1 << 62), 1 << 62


@dataclass
class BallTree:
    """Nodes in depth-first order: a leaf's rows are [first, last) of the reordered rows; right is 0 for a leaf, the left child follows its parent."""

    vectors: np.ndarray  # (rows, dimensions) float64, whole numbers, reordered
    ids: np.ndarray
    labels: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    norms: np.ndarray  # of the centres
    first: np.ndarray
    last: np.ndarray
    right: np.ndarray
    least: np.ndarray  # label of a node
    most: np.ndarray


def build(vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> BallTree:
    """Splits at the median of the dimension that spreads most; equal rows, which no plane parts, are halved all the same, so the depth is log2(rows / leaf)."""
    order, nodes = np.arange(len(ids)), []
    waiting: list[tuple[int, int, int]] = [(0, len(ids), -1)]
    while waiting:
        lo, hi, parent = waiting.pop()
        if parent >= 0:
            nodes[parent][4] = len(nodes)
        own = vectors[order[lo:hi]]
        centre = own.mean(axis=0)
        nodes.append([centre, np.sqrt(((own - centre) ** 2).sum(axis=1).max()), lo, hi, 0])
        if hi - lo > leaf:
            middle = (hi - lo) // 2
            at = np.argpartition(own[:, own.var(axis=0).argmax()], middle)
            order[lo:hi] = order[lo:hi][at]
            here = len(nodes) - 1
            waiting += [(lo + middle, hi, here), (lo, lo + middle, -1)]
    centres = np.array([n[0] for n in nodes])
    first, last, right = (np.array([n[k] for n in nodes]) for k in (2, 3, 4))
    labels = labels[order]
    ends = list(zip(first.tolist(), last.tolist(), strict=True))
    return BallTree(vectors[order], ids[order], labels, centres, np.array([n[1] for n in nodes]), np.sqrt((centres**2).sum(axis=1)), first, last, right, np.array([labels[a:b].min() for a, b in ends]), np.array([labels[a:b].max() for a, b in ends]))


@dataclass
class Queries:
    """q: (queries, dimensions); low, high: (queries, windows) of scores, a window with low > high is none; ids are never matched."""

    q: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    low: np.ndarray
    high: np.ndarray


def search(tree: BallTree, queries: Queries, k: int, same_label: bool, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of shape (queries, windows, k): per window the first k rows of the query's label (or of other ones), by falling score and then rising id; LOW fills what is missing.

    seen, if given, gets the number of queries that each visited leaf was scored for."""
    q, low, high = queries.q, queries.low, queries.high
    top = np.full((*low.shape, k), LOW)
    ids = np.full((*low.shape, k), HIGH)
    norms = np.sqrt((q**2).sum(axis=1))
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(tree.vectors).max(initial=0)) * max(1, q.shape[1]) < 2.0**53

    def interval(node: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle, reach = q[rows] @ tree.centres[node], norms[rows] * tree.radii[node]
        slack = 1e-9 * (norms[rows] * (tree.norms[node] + tree.radii[node]) + 1)  # rounding of doubles never prunes
        return middle - reach - slack, middle + reach + slack

    waiting = [(0, np.arange(len(q)))] if len(tree.ids) else []
    while waiting:
        node, rows = waiting.pop()
        least, most = tree.least[node], tree.most[node]
        label = queries.labels[rows]
        rows = rows[(label >= least) & (label <= most) if same_label else (label != least) | (label != most)]
        if not len(rows):
            continue
        below, above = interval(node, rows)
        open_ = (above[:, None] >= low[rows]) & (below[:, None] <= high[rows]) & (above[:, None] >= top[rows, :, -1]) & (low[rows] <= high[rows])
        rows = rows[open_.any(axis=1)]
        if not len(rows):
            continue
        if tree.right[node]:
            children = [node + 1, int(tree.right[node])]
            # the child with the higher scores first: it raises the kth scores that prune the other
            nearer = [(q[rows] @ tree.centres[c]).mean() for c in children]
            waiting += [(c, rows) for _, c in sorted(zip(nearer, children, strict=True))]
            continue
        part = slice(tree.first[node], tree.last[node])
        if seen is not None:
            seen.append(len(rows))
        if exact:
            scores = (q[rows] @ tree.vectors[part].T).astype(np.int64)
        else:
            scores = q[rows].astype(np.int64) @ tree.vectors[part].T.astype(np.int64)
        match = (tree.labels[part][None, :] == queries.labels[rows][:, None]) == same_label
        match &= tree.ids[part][None, :] != queries.ids[rows][:, None]
        for w in range(low.shape[1]):
            good = match & (scores >= low[rows, w, None]) & (scores <= high[rows, w, None]) & (scores >= top[rows, w, -1:])
            hit = np.flatnonzero(good.any(axis=1))
            if len(hit):
                r = rows[hit]
                both = np.concatenate([top[r, w], np.where(good[hit], scores[hit], LOW)], axis=1)
                named = np.concatenate([ids[r, w], np.where(good[hit], tree.ids[part][None, :], HIGH)], axis=1)
                order = np.lexsort((named, -both), axis=1)[:, :k]
                top[r, w], ids[r, w] = np.take_along_axis(both, order, 1), np.take_along_axis(named, order, 1)
    return top, ids


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows; shorter ones are filled up with zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    starts = np.cumsum(sizes) - sizes
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(starts, sizes)] = flat
    return out


FOUND = "no long, w int, score long, id long"


def _stream(k: int, width: int, same_label: bool) -> Callable:
    """A partition sorted by (chunk, is_query): each chunk's rows become a tree, and its queries pass it by in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree = None, [], None

        def grown() -> BallTree:
            return build(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))

        for batch in batches:
            chunks, is_query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(chunks) != 0) | (is_query[1:] != is_query[:-1])) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if chunks[lo] != now:
                    now, held, tree = chunks[lo], [], None
                part = batch.slice(lo, hi - lo)
                ids, labels = part.column(3).to_numpy(), part.column(4).to_numpy()
                vectors = _matrix(part.column(5), width)
                if not is_query[lo]:
                    held.append((vectors, ids, labels))
                    continue
                if tree is None:
                    if not held:
                        continue
                    tree, held = grown(), []
                windows = int(pc.max(pc.list_value_length(part.column(6))).as_py())
                low, high = np.full((hi - lo, windows), HIGH), np.full((hi - lo, windows), LOW)
                for out, column in ((low, part.column(6)), (high, part.column(7))):
                    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
                    at = np.repeat(np.arange(hi - lo), sizes)
                    out[at, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
                top, found = search(tree, Queries(vectors, ids, labels, low, high), k, same_label)
                n, w, j = np.nonzero(top > LOW)
                yield pa.RecordBatch.from_arrays([pa.array(part.column(2).to_numpy()[n]), pa.array(w, pa.int32()), pa.array(top[n, w, j]), pa.array(found[n, w, j])], names=["no", "w", "score", "id"])

    return tidy(run)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k answers of each query's window, with their rank."""
    order = Window.partitionBy("no", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def quantised(table: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", relabel: Column | None = None) -> DataFrame:
    """(id, label, q): floor(scale * x) of every component.  Rows with a null id, label or vector, or with a null or non-finite component, are left out."""
    label = F.col(label_col) if relabel is None else relabel
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    live = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vector.isNotNull() & finite
    return table.where(live).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least_percent: int = 80, most_percent: int = 100, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """vectors (id, label, q) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor is a condition on id.  An anchor's positives are its first rows of the same label with another id; a positive's negatives are the first rows of other labels with
    least_percent * positive_score <= 100 * negative_score <= most_percent * positive_score, ranked from 1.  First means by falling score, ties by smaller id.  Anchors without positives and
    positives without negatives (all with a negative score among them) have no rows.  Rows that repeat an id are candidates each, and an anchor that repeats its id is several.
    Shorter vectors count as filled up with zeros.  Scores must fit 64 bits; they are exact then.  An empty table gives an empty result."""
    spark = vectors.sparkSession
    ranked = global_rank(vectors, "label", "id", name="no")
    total, width = ranked.agg(F.count("*"), F.max(F.size("q"))).first()
    width = max(1, width or 0)
    rows_each = max(1, min(chunk_bytes // (8 * width), max(LEAST_ROWS, -(-total // (2 * shuffle_width(spark))))))
    chunks = max(1, -(-total // rows_each))
    rows = ranked.withColumn("chunk", F.expr(f"(no - 1) div {rows_each}"))
    nothing = F.lit(None).cast("array<long>")
    as_rows = rows.select("chunk", F.lit(False).alias("is_query"), "no", "id", "label", "q", nothing.alias("low"), nothing.alias("high"))
    anchors = stash(rows.where(is_anchor).select("no", "id", "label", "q"), "anchors")
    # where a label's rows are, and the chunks that hold nothing else
    ends = rows.groupBy("chunk").agg(F.min("label").alias("a"), F.max("label").alias("b"))
    places = rows.groupBy("label").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"))
    pure = ends.where("a = b").groupBy(F.col("a").alias("label")).agg(F.min("chunk").alias("pure_first"), F.max("chunk").alias("pure_last"))
    places = stash(places.join(pure, "label", "left"), "places")

    def answers(queries: DataFrame, where: Column, k: int, same_label: bool) -> DataFrame:
        """queries (no, id, label, q, low, high) past the chunks of `where`, an array of numbers."""
        dealt = queries.join(places, "label").select(F.explode(where).alias("chunk"), F.lit(True).alias("is_query"), "no", "id", "label", "q", "low", "high")
        both = as_rows.union(dealt).repartition(max(shuffle_width(spark), chunks), "chunk").sortWithinPartitions("chunk", "is_query")
        return _first(shipped(both).mapInArrow(_stream(k, width, same_label), FOUND), k)

    everywhere = F.lit(LOW + 1), F.lit(HIGH - 1)
    wide = anchors.select("*", *[F.array(x.cast("long")).alias(n) for x, n in zip(everywhere, ("low", "high"), strict=True)])
    found = answers(wide, F.sequence("first", "last"), positives, True)
    found = stash(found.select("no", F.col("rank").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # 100 * score >= least * positive and 100 * score <= most * positive, in whole numbers
    down = lambda x: f"(({x}) - pmod({x}, 100)) div 100"
    window = F.struct("p", (-F.expr(down(f"-{least_percent} * positive_score"))).alias("low"), F.expr(down(f"{most_percent} * positive_score")).alias("high"))
    windows = found.groupBy("no").agg(F.sort_array(F.collect_list(window)).alias("s"))  # at most `positives` each
    narrow = anchors.join(windows, "no").select("no", "id", "label", "q", F.col("s.low").alias("low"), F.col("s.high").alias("high"))
    others = F.when(F.col("pure_first").isNull(), F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<long>")).otherwise(
        F.concat(*[F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<long>")) for a, b in ((F.lit(0).cast("long"), F.col("pure_first") - 1), (F.col("pure_last") + 1, F.lit(chunks - 1).cast("long")))])
    )
    mined = stash(answers(narrow, others, negatives, False), "negatives")
    discard(places)
    named = mined.select("no", (F.col("w") + 1).alias("p"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(found, ["no", "p"]).join(anchors.select("no", F.col("id").alias("anchor_id")), "no")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
