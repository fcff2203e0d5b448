"""Every opN query over the whole smallest tables: against its SQL, a library or a plain version."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from maskwright.llm import audio_fingerprint as audio
from maskwright.llm.packing import decompose
from maskwright.llm.queries import BYTE_BPE, ORACLE_SQL, QUERIES, WORD_BPE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows_of(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    found = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    want = sorted(map(repr, found.fetchall()))
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == want


def test_op2_languages(spark, documents):
    got = rows_of(spark, "op2_language_id")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in documents)
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["lang_pred"] in {*filter(None, lang.values()), "und"} for r in got)
    texts = dict(documents)
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, texts[r["doc_id"]]))) for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"] and lang[r["doc_id"]]]) > 0.95


def test_op4_finds_every_take(spark):
    got = rows_of(spark, "op4_audio_fingerprint")
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert {r["vec_id"] for r in got} == set(vectors)
    class_of = {r["vec_id"]: r["print_class"] for r in got}
    found = {(r["print_class"], r["query_id"]): r["offset_frames"] for r in got if r["query_id"] is not None}
    pcm = {n: audio.melody(np.array(v)) for n, v in vectors.items()}
    prints = {n: audio.fingerprint(x) for n, x in pcm.items()}
    for q in (n for n in pcm if n % 50 == 0):
        assert found[class_of[q], q] == 3 + q % 29
        heard = audio.fingerprint(audio.take(pcm[q], q))
        for n, p in prints.items():  # all pairs, over all offsets that overlap by half
            least = min(audio.bit_error(heard, p, o)[0] for o in range(-40, len(p) // 2))
            assert ((class_of[n], q) in found) == (least <= 0.2)


def test_op5_ids_are_those_of_tiktoken(spark, documents):
    import tiktoken

    from maskwright.llm.byte_bpe import read_ranks

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(BYTE_BPE), special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    got = {r["doc_id"]: r for r in rows_of(spark, "op5_byte_bpe")}
    assert len(got) == len(documents)
    for d, t in documents:
        ids = own.encode_ordinary(t)
        assert got[d] == {"doc_id": d, "n_tokens": len(ids), "ids_sha256": sha(",".join(map(str, ids)).encode()), "decoded_sha256": sha(t.encode())}


def test_op7_pieces_are_those_of_the_library(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    got: dict[int, list] = {}
    for r in rows_of(spark, "op7_packing"):
        got.setdefault(r["doc_id"], []).append(r)
    sequences = sorted(r["sequence_id"] for rows in got.values() for r in rows)
    assert sequences == list(range(len(sequences))) and len(got) == len(documents)
    for d, t in documents:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r, length in zip(sorted(got[d], key=lambda r: r["start"]), decompose(len(ids), 2048), strict=True):
            assert (r["start"], r["length"], r["doc_tokens"], r["offset"]) == (at, length, len(ids), 0)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + length].tobytes())
            at += length


def plain_spans(text):
    """The three patterns as the contract writes them, one after the other."""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(out)


def test_op8_base_spans_are_those_of_the_plain_patterns(spark):
    names, sf = ("assign", "access", "hex"), SF.replace("0.001", "0.01")  # the smallest table holds no secrets
    documents = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r.asDict() for r in QUERIES["op8_secret_scan"](spark, sf).collect()}
    assert len(got) == len(documents)
    some = 0
    for d, t in documents:
        base = plain_spans(t)
        some += len(base)
        text = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in base)
        r = got[d]
        assert [r[f"n_{n}"] for n in names] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        listed = [x.split(":") for x in r["spans"].split(",") if x]
        assert ",".join(":".join(x) for x in listed if x[0] != "random") == text
        assert listed == sorted(listed, key=lambda x: (int(x[1]), [*names, "random"].index(x[0])))
    assert some > 0


def test_op9_contract(spark, documents):
    got = rows_of(spark, "op9_toxicity")
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in documents)
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
