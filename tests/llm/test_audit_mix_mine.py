"""The filter audit, the source mix and the hard negatives against plain versions."""

import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import filter_audit, hard_negatives, source_mix
from maskwright.llm.hard_negatives import BallTree, Queries, build, search
from maskwright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LETTERS = "ABCDE"


def plain_fails(rows):
    """The letters that each (doc_id, text, ...) row fails."""
    firsts = {}
    for d, t, *_ in rows:
        if d is not None:
            firsts[t or ""] = min(d, firsts.get(t or "", d))
    out = []
    for d, t, *_ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and d > firsts[t]]
        out.append({x for x, fails in zip(LETTERS, tests, strict=True) if fails})
    return out


def plain_audit(rows, labels):
    """Every order applied document by document."""
    fails, out = plain_fails(rows), {}
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    parts = {}
    for row, f in zip(rows, fails, strict=True):
        parts.setdefault(row[2] or "", []).append((row[0], f))
    for part, docs in parts.items():
        shares = dict.fromkeys(LETTERS, 0)
        for order in itertools.permutations(LETTERS):
            left = docs
            for step, x in enumerate(order, 1):
                gone, before = [d for d in left if x in d[1]], set(order[: step - 1])
                left = [d for d in left if x not in d[1]]
                shares[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(x in f and bool(f & before) for _, f in docs), sum(f == {x} for _, f in docs), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), x]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shares[row[-1]]
    return out


def audit_rows(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, mask int, digest int, part int")
    got = filter_audit.interaction_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == [c.split()[0] for c in filter_audit.AUDIT.split(", ")]
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got.collect()}


def test_audit_is_that_of_every_order_applied(spark):
    rng = random.Random(5)
    rows = []
    for n in range(120):
        few = rng.random() < 0.4
        words = ["x y z"] * 90 if rng.random() < 0.2 else [f"w{rng.randrange(500)}" for _ in range(20 if few else 260)]
        if rng.random() < 0.3:
            words = [w.upper() for w in words]
        if rng.random() < 0.3:
            words.append("a|b")
        rows.append((n, rng.choice([" ", "\n", "\t \x0b"]).join(words), rng.choice(["en", "de", None, ""])))
    rows += [(200 + n, rows[n % 9][1], "en") for n in range(40)]  # copies
    rows += [(300, None, "de"), (301, "", None), (302, " \t\n", "de"), (None, None, "en"), (None, rows[3][1], "en"), (7, rows[7][1], rows[7][2]), (7, "other", "xx"), (400, "w w  " * 120, "nb"), (401, "lone word " * 200_000, "long")]
    labels = [(n, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for n in range(0, 420, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    assert audit_rows(spark, rows, labels) == plain_audit(rows, labels)


def test_audit_of_no_documents(spark):
    assert audit_rows(spark, [], [(1, 1, 1)]) == {}
    assert len(audit_rows(spark, [(1, None, None)], [])) == 600


def test_removal_polynomial_is_its_product_form():
    rng = random.Random(2)
    counts = {m: rng.randrange(50) for m in range(32) if rng.random() < 0.7}
    poly = filter_audit.removal_polynomial(counts, 5)
    at = lambda x: sum(n * (1 - np.prod([1 - x[i] for i in range(5) if m >> i & 1] or [Fraction(1)])) for m, n in counts.items())
    x = [Fraction(rng.randrange(10), 7) for _ in range(5)]
    assert sum(c * np.prod([x[i] for i in range(5) if t >> i & 1] or [Fraction(1)]) for t, c in enumerate(poly)) == at(x)
    gone = filter_audit.corners(poly)
    assert all(gone[s] == sum(n for m, n in counts.items() if m & s) for s in range(32))
    for i in range(5):  # every document is shared equally by the filters that it fails
        assert filter_audit.shapley(poly, i) == sum(Fraction(n, m.bit_count()) for m, n in counts.items() if m >> i & 1)


# --- op12
def mixed(spark, rows, partitions=3, **options):
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, size int, key int, rank int").repartition(partitions)
    return source_mix.mix(docs, **options)


def plain_targets(sizes):
    """source -> target, dealing out the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(names)}
    total, full = Fraction(3, 2) * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(full.values())
        level = Fraction(left) / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            return {s: full.get(s, level * weight[s] if s in open_ else 0) for s in names}
        full |= {s: Fraction(2 * sizes[s]) for s in over}


def mix_rows():
    rng = random.Random(9)
    rows = []
    for n in range(900):
        source = "hot" if n % 3 == 0 else rng.choice(["a", "B", "é", "zz", "\U0001f600", None, ""])
        rows.append((n, " ".join(["w"] * min(400, int(rng.paretovariate(1.1) * 5))), source))
    rows += [(1000, None, "a"), (1001, "", "empty"), (1002, " \t", "empty"), (None, "one two", "a"), (None, "one two", "a"), *[(5, "same same", "rep")] * 50, (1003, "w " * 50_000, "long"), (1004, "w " * 30_000, "long"), *[(1100 + n, "w " * 40, "long") for n in range(900)]]
    return rows


@pytest.mark.parametrize("group", [4096, 40])
def test_mix_meets_its_targets(spark, group):
    rows = mix_rows()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = plain_targets(sizes)
    got = mixed(spark, rows, group=group).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((False, d, count(t)) for d, t, _ in rows if d is not None) and len(got) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]))
        assert r.taken == r.size * r.copies and r.taken <= 2 * r.size and r.copies in (int(r.target / max(1, r.source_size)), int(r.target / max(1, r.source_size)) + 1)
        taken[r.source] += r.taken
    for s in set(sizes) - ({"long"} if group < 1000 else set()):  # a group of 40 has too few partners for 50,000 words; within reach of the shortest documents, not of the longest
        assert abs(taken[s] - want[s]) <= max(8, float(want[s]) * 0.01), (s, taken[s], float(want[s]))


def test_mix_is_the_same_however_rows_are_dealt(spark):
    rows = mix_rows()
    once = sorted(map(repr, mixed(spark, rows, 1, group=16).collect()))
    random.Random(1).shuffle(rows)
    assert sorted(map(repr, mixed(spark, rows, 7, group=16).collect())) == once


def test_mix_of_nothing(spark):
    assert mixed(spark, []).count() == 0
    assert [(r.target, r.taken) for r in mixed(spark, [(1, None, "a"), (2, "", None)]).collect()] == [(0.0, 0), (0.0, 0)]
    assert [(r.target, r.taken) for r in mixed(spark, [(1, "a b", "a")]).collect()] in ([(3.0, 2)], [(3.0, 4)])


def test_rounding_keeps_words_and_expectations():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(1, 400, 60))[::-1].astype(float)
    odds = np.full(60, 0.37)
    mean = np.zeros(60)
    for salt in range(3000):
        out = source_mix.settle(sizes, odds, rng.integers(0, 1 << 63, 60).astype(np.uint64), salt)
        assert ((out > 0) & (out < 1)).sum() <= 1 and (out * sizes).sum() == pytest.approx((odds * sizes).sum())
        mean += out
    assert np.abs(mean / 3000 - odds).max() < 0.05
    assert source_mix._levels(0, 10) == source_mix._levels(1, 10) == source_mix._levels(10, 10) == 1 and source_mix._levels(11, 10) == 2 and source_mix._levels(101, 10) == 3


def test_op12_over_the_smallest_table(spark):
    got = QUERIES["op12_source_mix"](spark, SF)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    rows = got.collect()
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r.size for r in rows), rel=0.01)
    assert sorted(map(repr, QUERIES["op12_source_mix"](spark, SF).collect())) == sorted(map(repr, rows))


# --- op13
def plain_negatives(rows):
    """(anchor, positive, rank, negative, scores) by sorting all rows for each anchor."""
    live = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            live.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, label, q in live:
        if i % 100 == 0:
            scored = sorted((-dot(q, v), j, other) for j, other, v in live if j != i)
            for s, j, _ in [x for x in scored if x[2] == label][:5]:
                fits = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
                out += [(i, j, n, x[1], -s, -x[0]) for n, x in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    table = spark.createDataFrame([(i, v if v is None else [x if x is None else float(x) for x in v], *r, 1, 2) for i, v, *r in rows], "vec_id long, embedding array<double>, label int, chunk int, no int")
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hard_negatives.hard_negatives(hard_negatives.quantised(table, relabel=relabel), F.col("id") % 100 == 0, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("chunk_bytes", [64 << 20, 2000])
def test_mined_negatives_are_those_of_sorting_all_rows(spark, chunk_bytes, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 50)
    rng = np.random.default_rng(6)
    rows = []
    for n in range(1200):
        v = rng.normal(size=6) + 2 * np.eye(6)[n % 6]
        rows.append((n, v.tolist(), int(n % 6)))
    same = rows[500][1]
    rows += [(2000 + n, same, int(n % 3)) for n in range(400)]  # copies of one vector in several labels: ties
    rows += [(4000, None, 1), (4100, rows[1][1], None), (4200, [1.0, None, 0, 0, 0, 0], 1), (4300, [float("nan")] * 6, 1), (4400, [float("inf")] + [0.0] * 5, 1), (None, rows[1][1], 1), (4500, [0.0] * 6, 2), (4600, [-5.0] * 6, 3), (4700, rows[2][1], 9), (700, rows[3][1], 4), (701, rows[3][1], 4), (701, rows[3][1], 4)]
    got, want = mined(spark, rows, chunk_bytes=chunk_bytes), plain_negatives(rows)
    assert len(want) > 200 and got == want


def test_vectors_of_other_lengths_and_none(spark):
    assert mined(spark, []) == [] and mined(spark, [(100, [1.0, 0.0], 1)]) == []
    rows = [(100, [1.0, 1.0], 1), (101, [1.0], 1), (102, [0.9, 0.05], 2), (103, [], 1), (104, [0.9], 3), (105, [3.0, 3.0], 2)]
    want = [(100, 101, 1, 102, 256 * 256, 256 * (230 + 12)), (100, 101, 2, 104, 256 * 256, 256 * 230)]
    # shorter vectors count as filled up with zeros; a positive score of 0 has the window [0, 0], which no score here meets
    assert mined(spark, rows) == want


def test_scores_beyond_doubles_are_exact():
    rng = np.random.default_rng(4)
    v = rng.integers(-(1 << 28), 1 << 28, (300, 5)).astype(float)
    labels, ids = rng.integers(0, 3, 300), np.arange(300)
    tree = build(v, ids, labels, 16)
    q = Queries(v[:20], ids[:20], labels[:20], np.full((20, 1), hard_negatives.LOW + 1), np.full((20, 1), hard_negatives.HIGH - 1))
    top, found = search(tree, q, 5, True)
    for n in range(20):
        want = sorted((-sum(int(a) * int(b) for a, b in zip(v[n], v[m], strict=True)), m) for m in range(300) if m != n and labels[m] == labels[n])[:5]
        assert [(-s, i) for s, i in zip(top[n, 0].tolist(), found[n, 0].tolist(), strict=True)] == want


def test_nodes_are_pruned_above_below_and_beneath_the_kth():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8)) * 300
    v = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 8)) * 5)
    tree: BallTree = build(v, np.arange(4000), np.zeros(4000, np.int64))
    for n, (lo, hi) in enumerate(zip(tree.first, tree.last, strict=True)):  # every row lies in its node's ball
        assert np.sqrt(((tree.vectors[lo:hi] - tree.centres[n]) ** 2).sum(axis=1)).max() <= tree.radii[n] + 1e-6
    scores = v @ v[0]
    bounds = [(hard_negatives.LOW + 1, hard_negatives.HIGH - 1), (int(np.median(scores)), int(np.median(scores)) + 2000), (hard_negatives.LOW + 1, int(np.median(scores)))]
    leaves = int((tree.right == 0).sum())
    for low, high in bounds:
        seen = []
        top, _ = search(tree, Queries(v[:1], np.array([-1]), np.zeros(1, np.int64), np.array([[low]]), np.array([[high]])), 5, True, seen)
        want = np.sort(scores[(scores >= low) & (scores <= high)])[::-1][:5]
        assert top[0, 0][: len(want)].tolist() == want.tolist() and len(seen) < leaves * 0.6
    tied = build(np.ones((500, 3)), np.arange(500)[::-1].copy(), np.zeros(500, np.int64), 8)
    top, found = search(tied, Queries(np.ones((1, 3)), np.array([-1]), np.zeros(1, np.int64), np.array([[0]]), np.array([[9]])), 5, True)
    assert found[0, 0].tolist() == [0, 1, 2, 3, 4]  # ties in other leaves win by id
