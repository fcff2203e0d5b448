"""Exact and near duplicates against brute force, on texts that are null, empty, very long, tied and repeated."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from maskwright.llm.exact_dedup import OWNER_ROWS, STREAM_ROWS, exact_duplicates, exchange_width, golomb_decode, golomb_encode, suspect_prints
from maskwright.llm.minhash_dedup import BANDS, ROWS, T, components, merged, near_duplicates, shingle_set, sketch
from maskwright.llm.common import KeyFilter, WordHashes, clear_stashes, parts_of, shared_folder

SCHEMA = "n_chars long, doc_id long, text string, size int, digest string, component string"


def frame(spark, rows):
    """Rows (id, text) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(1, i, t, 7, "x", "y") for i, t in rows], SCHEMA)


def brute_near(rows, size, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                part[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def near_rows():
    rng = random.Random(4)
    vocabulary = [f"w{n}" for n in range(400)]
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE two"), (8, "Été one"), (9, "été one")]
    i = 10
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 60, 150]))]
        for _ in range(rng.randint(1, 12)):
            copy = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.02, 0.06, 0.12]) else w for w in base]
            rows.append((i, " ".join(copy)))
            i += 1
    rows += [(i, " ".join(rng.choice(vocabulary) for _ in range(30_000))), (20, "repeated id"), (20, "repeated id"), (None, "no id here"), (None, "one two")]
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_match_brute_force(spark, size):
    rows = near_rows()
    got = near_duplicates(frame(spark, rows), size, 80).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute_near(rows, size, 80), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_groups_of_near_copies_need_no_pairs(spark, monkeypatch):
    """More copies than a bucket may join, around a base that few of them reach directly; blocks of a few members each."""
    import maskwright.llm.minhash_dedup as m

    monkeypatch.setattr(m, "FEW", 8)
    monkeypatch.setattr(m, "BLOCK_SHINGLES", 900)
    rng = random.Random(9)
    base = [f"b{n}" for n in range(60)]
    rows = []
    for i in range(90):
        copy = list(base)
        for k in rng.sample(range(60), rng.choice([1, 2, 3, 4, 5])):
            copy[k] = f"x{rng.randint(0, 30)}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), 2, 80).collect()}
    assert got == {d: c for d, _, c in brute_near(rows, 2, 80)}


def test_sketches_fill_and_agree_as_often_as_sets_do():
    hashes = WordHashes()
    for n in (1, 2, 7, 128, 5000):
        x = shingle_set(" ".join(f"t{k}" for k in range(n)), 1, hashes)
        assert len(x) == n and len(sketch(x)) == T == BANDS * ROWS and (sketch(x) != np.uint64(2**64 - 1)).all()
    a, b = (shingle_set(" ".join(f"t{k}" for k in range(lo, lo + 400)), 1, hashes) for lo in (0, 100))
    assert abs((sketch(a) == sketch(b)).mean() - 300 / 500) < 0.2


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(frame(spark, []), 2).count() == 0
    assert [tuple(r) for r in near_duplicates(frame(spark, [(5, None)]), 2).collect()] == [(5, 0, 5, True)]


def test_components_grow_by_later_links(spark):
    rng = random.Random(8)
    chain = [(n, n + 1) for n in range(100, 140)]
    hub = [(7, n) for n in range(200, 260)]
    first = chain + hub + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(60)] + [(5, 5)]
    later = [(rng.randrange(250, 700), rng.randrange(90, 700)) for _ in range(40)] + [(1, 7), (1, 7), (140, 2), (900, 901), (3, 3)]
    found = components(spark.createDataFrame(first, "a long, b long"))

    def least(links):
        part = {}

        def root(n):
            while part.setdefault(n, n) != n:
                n = part[n]
            return n

        for a, b in links:
            part[max(root(a), root(b))] = min(root(a), root(b))
        return {n: root(n) for n in list(part) if root(n) != n}

    assert {r.node: r.component for r in found.collect()} == least(first)
    joined = merged(found, spark.createDataFrame(later, "a long, b long"))
    rows = [(r.node, r.component) for r in joined.collect()]
    assert dict(rows) == least(first + later) and len(dict(rows)) == len(rows)
    nothing = spark.createDataFrame([], "a long, b long")
    assert {r.node: r.component for r in merged(joined, nothing).collect()} == dict(rows)
    assert components(nothing).count() == 0 and merged(components(nothing), nothing).count() == 0
    assert {r.node: r.component for r in merged(components(nothing), spark.createDataFrame(later, "a long, b long")).collect()} == least(later)


def test_golomb_round_trip():
    rng = np.random.default_rng(3)
    for n, bits in ((0, 20), (1, 60), (2, 63), (900, 24), (20_000, 40)):
        values = np.unique(rng.integers(0, 1 << bits, n).astype(np.uint64))
        assert (golomb_decode(golomb_encode(values)) == values).all()
    dense = np.arange(5000, dtype=np.uint64)
    assert len(golomb_encode(dense)) < 1300


def test_streams_are_linear_in_rows():
    for rows in (10**8, 10**9, 10**10, 10**11, 65 * 10**9):
        owners, senders = exchange_width(rows, 200)
        assert owners * senders <= max(200 * 200, rows / STREAM_ROWS) and rows / owners <= OWNER_ROWS and senders >= 200
    assert exchange_width(1000, 8) == (8, 8) and exchange_width(0, 8) == (8, 8)


def test_suspects_are_the_prints_that_occur_twice(spark, monkeypatch):
    """Within a sender, across batches of it, across senders, and where streams are cut because they are long."""
    import maskwright.llm.exact_dedup as m

    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 30, 6000).tolist() + [7] * 4000 + [(1 << 30) - 1] * 3 + [0, 0]
    prints += prints[:900]
    want = {x for x, n in Counter(prints).items() if n > 1}
    df = spark.createDataFrame([(x,) for x in prints], "print long")
    for parts, owners, senders, longest in ((1, 4, 4, 4_000_000), (5, 3, 9, 4_000_000), (6, 4, 2, 4_000_000), (3, 1, 3, 512)):
        monkeypatch.setattr(m, "OWNER_ROWS", longest)
        found = suspect_prints(df.repartition(parts), 30, owners, senders).collect()
        assert len(found) == len(want) and {r.print for r in found} == want
    held = suspect_prints(df.repartition(40), 30, 4, 40).where("often").collect()
    assert {r.print for r in held} == {7}
    assert suspect_prints(df.limit(0), 30, 4, 4).count() == 0


def test_exact_duplicates_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "ab"), (6, "a\tb  "), (7, "a b"), (8, "x" * 300_000), (9, "x" * 300_000 + " "), (10, "AB"), (11, "tie"), (12, "tie")]
    rows += [(100 + n, f"text {rng.randint(0, 40)}" + " " * rng.randint(0, 3)) for n in range(200)]
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), d))
    want = set()
    for d, t in rows:
        norm = re.sub("[\x20\x09-\x0d]", "", t or "")
        keep = min(groups[norm])[1]
        want.add((d, keep, len(groups[norm]), d == keep, hashlib.sha256(norm.encode()).hexdigest()))
    got = exact_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want
    assert exact_duplicates(frame(spark, [])).count() == 0


def test_exact_duplicates_with_repeated_and_missing_ids(spark):
    got = exact_duplicates(frame(spark, [(1, "a"), (1, "a"), (None, "a"), (None, "b")])).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]


def test_only_suspect_texts_are_shuffled(spark, tmp_path):
    """Texts leave the task that reads them only behind the filter, once they are grouped."""
    import maskwright.llm.exact_dedup as m

    plans = []
    stash = m.stash

    def noted(df, tag):
        if tag == "groups":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stash(df, tag)

    frame(spark, [(n, f"text {n} " * 20) for n in range(300)] + [(900, "text 1 " * 20)]).write.parquet(f"{tmp_path}/d")
    m.stash = noted
    try:
        got = exact_duplicates(spark.read.parquet(f"{tmp_path}/d")).where("group_size > 1").collect()
    finally:
        m.stash = stash
    assert sorted(r.doc_id for r in got) == [1, 900] and len(plans) == 1
    below = plans[0][plans[0].index("hashpartitioning(norm") :]
    assert "BroadcastHashJoin" in below and below.count("hashpartitioning") == 1 and "SortMergeJoin" not in below


def test_key_filters_lose_no_key(spark):
    keys = spark.range(0, 3000, 3)
    rows = spark.range(3000).withColumnRenamed("id", "slot").selectExpr("slot", "slot as word", "slot as bits")
    some = KeyFilter(keys, "id")
    kept = {r.slot for r in some.only(rows, rows.slot).collect()}
    assert set(range(0, 3000, 3)) <= kept and len(kept) < 1300
    marked = some.mark(rows, "hit", rows.slot)
    assert marked.columns == ["slot", "word", "bits", "hit"] and {r.slot for r in marked.where("hit").collect()} == kept
    tight = KeyFilter(keys, "id", most_bits=1024)
    assert set(range(0, 3000, 3)) <= {r.slot for r in tight.only(rows, rows.slot).collect()}
    full = KeyFilter(keys, "id", most_bits=512)
    assert full.table is None and full.only(rows, rows.slot).count() == 3000
    assert KeyFilter(keys.limit(0), "id").only(rows, rows.slot).count() == 0


def test_parts_are_bounded():
    import pyarrow as pa

    texts = pa.array(["a" * 10, None, "", "b" * 100, "c" * 5, "d" * 5], pa.string())
    assert list(parts_of(texts, rows=3, size=20)) == [(0, 3), (3, 1), (4, 2)] and list(parts_of(texts.slice(6), 3, 20)) == []


def test_tables_of_an_application_can_be_cleared(spark):
    import glob

    near_duplicates(frame(spark, near_rows()[:30]), 2).collect()
    folder = f"{shared_folder(spark).removeprefix('file://')}/maskwright/{spark.sparkContext.applicationId}"
    assert {x.rsplit("/", 1)[1].split("-")[0] for x in glob.glob(f"{folder}/*")} >= {"rows", "named"}
    clear_stashes(spark)
    assert glob.glob(f"{folder}/*") == []


def test_near_duplicates_leave_only_what_the_result_reads(spark):
    import glob

    clear_stashes(spark)
    near_duplicates(frame(spark, near_rows()[:60]), 2).collect()
    folder = f"{shared_folder(spark).removeprefix('file://')}/maskwright/{spark.sparkContext.applicationId}"
    assert {x.rsplit("/", 1)[1].split("-")[0] for x in glob.glob(f"{folder}/*")} == {"rows", "named"}
