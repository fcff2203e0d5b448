"""The pipeline over a folder of its own documents, every stage against a plain version fed with the stage before."""

import os
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from maskwright.llm import language_crf
from maskwright.llm.packing import WordTokens, decompose
from maskwright.llm.queries import LANGUAGE_SAMPLE
from maskwright.llm.secret_scan import redact_text

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"aa": ["tho", "ing", "and", "ere"], "bb": ["ung", "sch", "ein", "keit"]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda k: "".join(rng.choice(SYLLABLES[k]) for _ in range(rng.randint(1, 4)))
    rows = []
    for n in range(160):
        k = "aa" if n % 3 else "bb"
        lines = [" ".join(word(k) for _ in range(rng.randint(6, 20))) for _ in range(rng.randint(2, 6))]
        if n % 4 == 0:
            lines.insert(1, "A Shared Line of all")
        if n % 10 == 0:
            lines.append("token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff")
        rows.append((n, "\n".join(lines), k))
        if n % 8 == 0:
            rows.append((1000 + n, "\n".join(lines).upper(), k))
    rows += [(2000, None, "aa"), (2001, "123 456", "aa"), (2002, "", None)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    one = stage("language")(spark, docs, folder)
    assert one.columns == columns and set(texts(one)) == {i for i, t in texts(docs).items() if t and any(c.isalpha() for c in t)}
    two = stage("lines")(spark, one, folder)
    want = {i: "\n".join(x for x in t.split("\n") if x.lower() not in ("a shared line of all", "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff")) for i, t in texts(one).items()}
    assert two.columns == columns and texts(two) == want and all(r.n_chars == len(r.text) for r in two.collect())
    three = stage("near_dedup")(spark, two, folder)
    assert three.columns == columns and texts(three) == {i: t for i, t in want.items() if i < 1000}
    secret = spark.createDataFrame([(1, "my password: hunter2222 x", "aa", "s", 25), (2, "clean", "aa", "s", 5), (3, None, None, None, None)], SCHEMA)
    four = stage("secrets")(spark, secret, folder)
    assert four.columns == columns and texts(four) == {1: "my [SECRET] x", 2: "clean", 3: None} and texts(four) == {i: redact_text(t) for i, t in texts(secret).items()}
    packed = stage("packing")(spark, three, folder).toPandas()
    tokens = WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in texts(three).items():
        n = len(np.frombuffer(tokens.encode_batch([t])[0], "<u4")) + 1
        assert packed[packed.doc_id == i].sort_values("start").length.tolist() == decompose(n, 2048)


def test_run_is_the_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, run in corpus_pipeline.STAGES:
        docs = run(spark, docs, folder)
    key = ["doc_id", "start"]
    got = corpus_pipeline.run(spark, folder).select(*key, "length", "ids_crc32").orderBy(*key).collect()
    assert got == docs.select(*key, "length", "ids_crc32").orderBy(*key).collect() and len(got) > 100


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_long_repeated_and_extra(spark, tmp_path):
    """Very long texts, rows that repeat an id or have none, and columns with clashing names, through all stages."""
    rng = random.Random(3)
    word = lambda k: "".join(rng.choice(SYLLABLES[k]) for _ in range(rng.randint(1, 4)))
    text = lambda n, k="aa": " ".join(word(k) for _ in range(n))
    long, twice = text(60_000), text(40)
    rows = [(n, text(30, "aa" if n % 2 else "bb"), "aa" if n % 2 else "bb") for n in range(40)]
    rows += [(100, long, "aa"), (101, long, "aa"), (7, rows[7][1], "aa"), (8, text(30), "aa"), (None, text(30), None), (None, twice, "aa"), (200, twice, "aa")]
    docs = spark.createDataFrame([(i, t, k, "s", len(t), 5, 6, 7, 8) for i, t, k in rows], f"{SCHEMA}, hit int, told int, d int, gone int")
    for name, run in corpus_pipeline.STAGES[:-1]:
        out = run(spark, docs, None)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}").selectExpr("*", "1 as hit", "2 as told", "3 as d", "4 as gone")
        ids = sorted(-1 if r.doc_id is None else r.doc_id for r in docs.collect())
        both = {"near_dedup", "secrets"} & {name}
        # 101 goes for 100; of the two rows without an id one stays by itself, so both do, and 200 leads the group of the other
        assert ids == sorted([*range(40), 7, 8, 100, -1, -1, 200] + ([] if both else [101])), name
    packed = corpus_pipeline.packing(spark, docs, None)
    assert packed.where("doc_id = 100").agg({"length": "sum"}).first()[0] == packed.where("doc_id = 100").first().doc_tokens > 60_000


def test_texts_of_no_language_are_rejected(spark):
    """Other alphabets, hexadecimal, keyboard rows and shuffled letters go; documents of the four languages and texts that switch between them stay.  Fitted to the larger table: shuffled letters take some hundred documents a
    language to tell."""
    rng = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    some = docs.where("doc_id % 10 = 3")
    clean = [r.text for r in some.where("length(text) > 200 and length(text) < 3000").orderBy("doc_id").limit(300).collect()]
    cyrillic = lambda t: "".join(chr(0x430 + ord(c) % 32) if c.isalpha() else c for c in t)
    han = lambda t: "".join(chr(0x4E00 + (ord(c) * 7919 + n) % 5000) if c.isalpha() else c for n, c in enumerate(t))
    shuffled = lambda t: " ".join("".join(rng.sample(w, len(w))) for w in t.split())
    junk = [f(t) for f in (cyrillic, han, shuffled) for t in clean[:40]]
    junk += [" ".join(f"{rng.getrandbits(64):x}" for _ in range(30)) for _ in range(40)] + [" ".join("".join(rng.choice("asdfghjkl") for _ in range(7)) for _ in range(30)) for _ in range(40)]
    switched = [" ".join(" ".join(t.split()[:25]) for t in rng.sample(clean, 3)) for _ in range(40)]
    rows = [(10**6 + n, t, None, "junk", len(t)) for n, t in enumerate(junk)] + [(2 * 10**6 + n, t, None, "switched", len(t)) for n, t in enumerate(switched)]
    model = language_crf.fit(language_crf.with_other(language_crf.training_windows(docs, LANGUAGE_SAMPLE)))
    kept = language_crf.keep_identified(some.union(spark.createDataFrame(rows, docs.schema)), model, corpus_pipeline.LEAST_SCORE)
    counts = {r["kind"]: r["count"] for r in kept.groupBy(F.when(F.col("doc_id") < 10**6, "clean").otherwise(F.col("source")).alias("kind")).count().collect()}
    assert counts.get("junk", 0) <= 0.03 * len(junk) and counts["switched"] == len(switched) and counts["clean"] >= 0.99 * some.where("text is not null").count(), counts


def test_a_run_leaves_only_its_result(spark, folder):
    from maskwright.session import _run_folder, clear_stashes

    clear_stashes(spark)
    corpus_pipeline.run(spark, folder)
    left = os.listdir(_run_folder(spark).removeprefix("file://"))
    assert [x for x in left if x.startswith("stage-")] == [x for x in left if x.startswith("stage-packing")]
    clear_stashes(spark)
    assert not os.path.exists(_run_folder(spark).removeprefix("file://"))
