"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is its set of distinct k-word shingles (k = 2 by default for the query, see `near_duplicates`).
Every set gets a sketch of T coordinates by rounds of hashed bin placement: in round i < T each
element falls into one random bin with a value in [i, i + 1) and a bin keeps its least value; in round T + j
every element falls into bin j, so after 2T rounds no coordinate is left empty.  The number of equal
coordinates of two sketches has mean T * J with Chernoff-type concentration, as for MinHash, at a cost of
O(n + T log T) instead of O(n * T).

Steps, all distributed:

1. one pass over the texts: set size, 128-bit digest of the set, band keys, two bit planes of the sketch;
2. equal sets collapse to one numbered node (partial aggregation, so a huge group of copies is one row per task);
3. nodes that share a band key meet at their bucket's smallest node (a star, linear in the bucket, never
   all pairs); pairs pass if sizes and bit planes allow a similarity of the threshold, and are then verified on the full sets;
4. connected components of the verified links (alternating large and small stars on tables);
5. what a star cannot decide: buckets that still hold several components.  Nodes outside the bucket's largest component first try
   six random members of it.  Of the buckets still open then, those of up to 64 members give all pairs across components that sizes and bit planes
   allow; larger ones are cut into blocks of bounded size, and each pair of blocks compares its members with their full sets in place and
   returns only links;
6. components of all links; each row gets the smallest doc_id of its component.

A pair at exactly 0.8 is missed by all 32 bands of 4 rows with probability (1 - 0.8^4)^32 < 1e-7 and by the bit planes
with a probability below 1e-6.  A set is named by all 128 bits of its digest.

Sets are only needed of nodes with a candidate: bitmap filters (KeyFilter) drop other texts where they are read, and members of buckets with a
single node before they are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import KeyFilter, WordHashes, discard, parts_of, shipped, stash, texts_of, tidy

T, BANDS, ROWS = 128, 32, 4
#: Members up to which a bucket's pairs are joined, and shingles of a block of larger buckets.
FEW, BLOCK_SHINGLES = 64, 500_000
_U = np.uint64
_GOLD, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> _U(30))) * _M1
        z = (z ^ (z >> _U(27))) * _M2
        return z ^ (z >> _U(31))


with np.errstate(over="ignore"):
    _SEEDS = _mix(np.arange(1, 2 * T + 1, dtype=_U) * _GOLD)
    _SALTS = _mix(np.arange(2001, 2007, dtype=_U) * _GOLD).view(np.int64).tolist()
    _BAND_SEEDS = _mix(np.arange(1001, 1001 + BANDS, dtype=_U) * _GOLD)


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct `size`-word shingles; fewer words make one shingle, none an empty set."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    span = min(size, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - span + 1, _U(span))
        for k in range(span):
            out = _mix((out + _GOLD) * _M1 ^ h[k : len(h) - span + 1 + k])
    return np.unique(out)


def sketch(x: np.ndarray) -> np.ndarray:
    """The T coordinates of a non-empty set: round in the upper 8 bits, value in the others."""
    out, empty = np.full(T, ~_U(0)), T
    at, step = 0, max(1, ceil(1.2 * T * log(T) / len(x)))
    while empty and at < T:
        upto = min(T, at + step)
        z = _mix(x[None, :] ^ _SEEDS[at:upto, None])
        value = (z >> _U(8)) | (np.arange(at, upto, dtype=_U)[:, None] << _U(56))
        np.minimum.at(out, (z & _U(T - 1)).astype(np.intp).ravel(), value.ravel())
        empty = int((out == ~_U(0)).sum())
        at, step = upto, max(1, step // 4)
    for j in np.flatnonzero(out == ~_U(0)) if empty else ():
        out[j] = (_mix(x ^ _SEEDS[T + j]) >> _U(8)).min() | (_U(T + j) << _U(56))
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    key = _BAND_SEEDS.copy()
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = _mix((key + _GOLD) * _M2 ^ coordinates[k::ROWS])
    return key


def bit_planes(coordinates: np.ndarray) -> np.ndarray:
    """Two bits of every coordinate, as 2 x 128 bits in four 64-bit integers."""
    return np.concatenate([np.packbits((coordinates >> _U(s)).astype(np.uint8) & 1).view(_U) for s in (0, 1)])


def set_digest(x: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(x.tobytes())


SKETCHED = "doc_id long, n_shingles long, h1 long, h2 long, p0 long, p1 long, p2 long, p3 long, bands array<long>"
PLANES = ("p0", "p1", "p2", "p3")


def _halves(digests: list[bytes | None]) -> list[pa.Array]:
    """Both 64-bit halves of digests."""
    return [pa.array([None if d is None else int.from_bytes(d[lo : lo + 8], "big", signed=True) for d in digests], pa.int64()) for lo in (0, 8)]


def _sketcher(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for ids, texts in texts_of(batches):
            n, digests, planes, bands = [], [], [], []
            for text in texts:
                x = shingle_set(text, size, hashes)
                n.append(len(x))
                if len(x):
                    c = sketch(x)
                    digests.append(set_digest(x))
                    planes.append(bit_planes(c).view(np.int64).tolist())
                    bands.append(band_keys(c).view(np.int64))
                else:
                    digests.append(None)
                    planes.append([None] * 4)
                    bands.append(None)
            columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *_halves(digests), *[pa.array([p[k] for p in planes], pa.int64()) for k in range(4)], pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SKETCHED.split(", ")])

    return tidy(run)


def _full_sets(size: int):
    """(nid, text, digest) -> (nid, shingles) for the rows whose set is really the one of the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at, count in parts_of(batch.column(1)):
                part = batch.slice(at, count)
                nids, sets = [], []
                for nid, text, digest in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                    x = shingle_set(text, size, hashes)
                    if len(x) and set_digest(x) == digest:
                        nids.append(nid)
                        sets.append(x.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(nids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["nid", "shingles"])

    return tidy(run)


def _most_unequal(percent: int) -> int:
    """Unequal coordinates that the bit planes may show at a similarity of percent / 100: one shows in two random bits three times of four, and 5.5 standard deviations are added."""
    miss = (1 - percent / 100) * 0.75
    return int(T * miss + 5.5 * sqrt(T * miss * (1 - miss))) + 1


def _allowed(percent: int, a: str, b: str):
    """Whether sizes and bit planes leave room for a similarity of percent / 100."""
    x = [F.col(f"{a}.p{k}").bitwiseXOR(F.col(f"{b}.p{k}")) for k in range(4)]
    unequal = F.bit_count(x[0].bitwiseOR(x[2])) + F.bit_count(x[1].bitwiseOR(x[3]))
    lo, hi = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")), F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
    return (lo * 100 >= hi * percent) & (unequal <= _most_unequal(percent))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, component) with component the least node of each connected component.

    Alternates large stars (every node links its larger neighbours to its least one) and small stars (every node links its
    smaller neighbours and itself to the least) until a round changes nothing.  Each round is a few joins and
    aggregations over tables in the shared folder; a hub's rows can be split by the engine's skew handling."""

    def step(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = e.join(low, "u")
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def written(e: DataFrame) -> tuple[DataFrame, dict]:
        """e as a table, with its number of rows and a sum over them, which the write itself observes."""
        seen = Observation()
        table = stash(e.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("total")), "edges")
        return table, seen.get

    now, was = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while was["n"]:
        new, is_ = written(step(step(now, True), False))
        discard(now)
        now = new
        if is_ == was:
            break
        was = is_
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """found (node, component), as components() gives it, once links (a, b) join some of its components or new nodes.

    Links become links between components first, so that the rounds work on the components that a link touches and not on all nodes.
    Both components and the ends of links outside of found are least nodes, so the least of those is the least of all."""
    x, y = (found.select(F.col("node").alias(f"{end}_node"), F.col("component").alias(f"{end}_part")) for end in "ab")
    ends = links.join(x, F.col("a") == F.col("a_node"), "left").join(y, F.col("b") == F.col("b_node"), "left")
    joint = components(ends.select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b")))
    least = joint.select(F.col("node").alias("part"), F.col("component").alias("least"))
    moved = found.join(least, F.col("component") == F.col("part"), "left").select("node", F.coalesce("least", "component").alias("component"))
    out = stash(moved.union(joint), "parts")
    discard(joint)
    return out


def _sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(nid, shingles) of the nodes of wanted (nid), from the whole text of one document each; texts of other documents are dropped where they are read."""
    wanted = stash(nodes.select("nid", "rep", "h1", "h2").join(wanted.distinct(), "nid"), "wanted")
    ids = KeyFilter(wanted, "rep")
    digest = F.concat(*[F.unhex(F.lpad(F.hex(h), 16, "0")) for h in ("h1", "h2")])
    texts = ids.only(docs, F.col("doc_id")).join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("nid", "text", digest.alias("digest"))
    out = stash(texts.mapInArrow(_full_sets(size), "nid long, shingles array<long>").dropDuplicates(["nid"]), "sets")
    discard(wanted)
    ids.discard()
    return out


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; sets of no pair are dropped before they are shuffled."""
    ids = KeyFilter(pairs.select(F.col("a").alias("nid")).union(pairs.select("b")), "nid")
    sets = ids.only(sets, F.col("nid"))
    one = sets.select(F.col("nid").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("nid").alias("b"), F.col("shingles").alias("y"))
    met = pairs.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("s"))
    out = stash(met.where(F.col("i") * 100 >= (F.col("s") - F.col("i")) * percent).select("a", "b"), "links")
    ids.discard()
    return out


def _candidates(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) that sizes and bit planes allow."""
    met = pairs.distinct().join(marks.alias("m"), F.col("a") == F.col("m.nid")).join(marks.alias("h"), F.col("b") == F.col("h.nid"))
    return stash(met.where(_allowed(percent, "m", "h")).select("a", "b"), "pairs")


def _open_buckets(shared: DataFrame, found: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, with their component, their bucket's largest one and how many members it has.

    What is known of a bucket is a table of its own, so that the rows of a large bucket can be split over tasks as they are joined to it."""
    placed = shared.select("bucket", "nid").join(found.withColumnRenamed("node", "nid"), "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    placed = stash(placed, "placed")
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("top"), F.count("*").alias("parts"), F.sum("k").alias("members")).where("parts > 1")
    main = stash(main.select("bucket", F.col("top.component").alias("main"), "members"), "main")
    some = KeyFilter(main, "bucket")
    out = stash(some.only(placed, F.col("bucket")).join(main, "bucket"), "open")
    discard(placed, main)
    some.discard()
    return out


def _block_links(percent: int):
    """All members x outside the main component and all members y of one block each -> links between their components, at most one less than there are components."""
    most = _most_unequal(percent)

    def columns(t: pa.Table):
        planes = np.stack([t.column(f"p{k}").to_numpy().view(_U) for k in range(4)], axis=1)
        bands = np.array(t.column("bands").to_pylist(), np.int64).reshape(len(planes), BANDS)
        flat = t.column("shingles").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(flat.value_lengths().to_numpy())])
        return t.column("nid").to_numpy(), t.column("component").to_numpy(), t.column("n").to_numpy(), planes, bands, flat.flatten().to_numpy().view(_U), ends

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if left.num_rows and right.num_rows:
            bucket = left.column("bucket")[0].as_py()
            xn, xc, xs, xp, xb, xf, xe = columns(left)
            yn, yc, ys, yp, yb, yf, ye = columns(right)
            top: dict[int, int] = {}

            def root(c: int) -> int:
                while (up := top.get(c, c)) != c:
                    c = up
                return c

            for i in range(len(xn)):
                z = yp ^ xp[i]
                unequal = np.bitwise_count(z[:, 0] | z[:, 2]) + np.bitwise_count(z[:, 1] | z[:, 3])
                near = (yc != xc[i]) & (unequal <= most) & (np.minimum(ys, xs[i]) * 100 >= np.maximum(ys, xs[i]) * percent)
                at = np.flatnonzero(near)
                # a pair is looked at in the first bucket that it shares
                at = at[yb[at, (yb[at] == xb[i]).argmax(axis=1)] == bucket] if len(at) else at
                own = xf[xe[i] : xe[i + 1]]
                for j in at.tolist():
                    a, b = root(int(xc[i])), root(int(yc[j]))
                    if a != b:
                        other = yf[ye[j] : ye[j + 1]]
                        place = np.minimum(np.searchsorted(own, other), len(own) - 1)
                        both = int((own[place] == other).sum())
                        if both * 100 >= (len(own) + len(other) - both) * percent:
                            top[a] = b
                            out_a.append(int(xn[i]))
                            out_b.append(int(yn[j]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def _large_bucket_links(still: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links across components in buckets of many members.  A bucket is cut into blocks by its shingles; each pair of blocks is one group that gets the full sets of its members and returns links alone, so pairs are compared but never sent."""
    full = still.join(nodes.select("nid", "n", *PLANES, "bands"), "nid")
    weights = stash(full.groupBy("bucket").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks")), "blocks")
    full = full.join(weights, "bucket").join(sets, "nid").withColumn("block", F.pmod("nid", F.col("blocks")).cast("int"))
    all_blocks = F.explode(F.expr("sequence(0, blocks - 1)"))
    kept = ["bucket", "nid", "component", "n", *PLANES, "bands", "shingles"]
    x = full.where("component <> main").select(*kept, F.col("block").alias("i"), all_blocks.alias("j"))
    y = full.select(*[F.col(c).alias(c) for c in kept], F.col("block").alias("j"), all_blocks.alias("i"))
    out = stash(x.groupBy("bucket", "i", "j").cogroup(y.groupBy("bucket", "i", "j")).applyInArrow(_block_links(percent), "a long, b long"), "links")
    discard(weights)
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Null, empty and blank texts have an empty set and stay alone.  Rows of equal sets are one node, so repeated rows and ties
    share a component; rows that repeat one doc_id each get a row.  A null id never becomes a component's id unless all its
    ids are null.  Other columns, whatever their names, are ignored.  An empty table gives an empty result."""
    docs = shipped(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = stash(docs.mapInArrow(_sketcher(size), SKETCHED), "sketches")
    firsts = [F.first(c).alias(c if c != "n_shingles" else "n") for c in ("n_shingles", *PLANES, "bands")]
    nodes = sketches.where("h1 is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), *firsts)
    nodes = stash(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")  # a number for each set, fixed by writing it down
    marks = nodes.select("nid", "n", *PLANES)

    # only bucket and node are exploded; members of buckets with one node are dropped before they are joined
    member = nodes.select(F.explode("bands").alias("bucket"), "nid")
    heads = stash(member.groupBy("bucket").agg(F.min("nid").alias("head"), F.count("*").alias("c")).where("c > 1").select("bucket", "head"), "heads")
    several = KeyFilter(heads, "bucket")
    shared = stash(several.only(member, F.col("bucket")).join(heads, "bucket"), "buckets")
    discard(heads)
    several.discard()
    star = _candidates(shared.where("nid <> head").select(F.col("nid").alias("a"), F.col("head").alias("b")), marks, percent)
    sets = _sets_of(star.select(F.col("a").alias("nid")).union(star.select("b")), nodes, docs, size)
    links = _linked(star, sets, percent)
    first = components(links)
    discard(star, links)

    # copies of one text that differ from each other more than from it hold together only through a central one: the nodes
    # outside a bucket's largest component try several of its members before everything that is left is looked at
    still = _open_buckets(shared, first)
    discard(shared)
    middle = still.where("component = main").groupBy("bucket").agg(F.array_distinct(F.array(*[F.min(F.col("nid").bitwiseXOR(F.lit(s))).bitwiseXOR(F.lit(s)) for s in _SALTS])).alias("heads"))
    middle = stash(middle, "middle")
    tries = _candidates(still.where("component <> main").join(middle, "bucket").select(F.col("nid").alias("a"), F.explode("heads").alias("b")), marks, percent)
    discard(middle)
    more = _sets_of(still.select("nid").distinct().join(sets.select("nid"), "nid", "left_anti"), nodes, docs, size)
    all_sets = sets.union(more)
    tried = _linked(tries, all_sets, percent)
    found = second = merged(first, tried)
    discard(tries, tried, first)

    rest = _open_buckets(still, second)
    discard(still)
    few = rest.where(F.col("members") <= FEW).join(marks, "nid")
    x, y = few.where("component <> main").alias("x"), few.alias("y")
    apart = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.nid") < F.col("y.nid")))
    pairs = stash(x.join(y, apart & _allowed(percent, "x", "y")).select(F.greatest("x.nid", "y.nid").alias("a"), F.least("x.nid", "y.nid").alias("b")).distinct(), "pairs")
    close = _linked(pairs, all_sets, percent)
    discard(pairs)
    large = _large_bucket_links(rest.where(F.col("members") > FEW), all_sets, nodes, percent)
    last = close.union(large)
    if not last.isEmpty():
        found = merged(second, last)

    in_part = nodes.select("nid", "rep", "h1", "h2").join(found.withColumnRenamed("node", "nid"), "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    least = stash(in_part.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    named = stash(in_part.join(least, "component").select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), "component_id"), "named")
    rows = stash(sketches.select("doc_id", "n_shingles", "h1", "h2"), "rows")
    discard(sketches, nodes, sets, more, rest, second, close, large, least, None if found is second else found)
    out = rows.join(named, (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")), "left")
    out = out.withColumn("component_id", F.when(F.col("h1").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
