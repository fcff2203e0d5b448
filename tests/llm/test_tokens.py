"""Tokenizers against the libraries, packing and sharding against their laws."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from maskwright.llm.byte_bpe import ByteBpe, decode, encode, read_ranks
from maskwright.llm.packing import WordTokens, decompose, pack
from maskwright.llm.sharding import shard_by_bytes

BYTE, WORD = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
POOL = "aàbc deéfİΣ\n\t\r\x0b\x1c\x85\xa0 1２٣²½!?'s'llσς漢字🙂👩‍👩‍👧​́<|endoftext|>"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    out = [None, "", " ", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "ab" * 500, "hello world", "x" * 60_000, "the " * 3000]
    return out + ["".join(rng.choice(rng.choice([POOL, "the in", "ab"])) for _ in range(rng.randint(0, 80))) for _ in range(1500)]


def frame(spark, rows):
    return spark.createDataFrame([(0, i, t, 1) for i, t in rows], "id long, doc_id long, text string, part int")


def test_byte_ids_are_those_of_tiktoken_and_decode(texts):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(BYTE), special_tokens={})
    bpe = ByteBpe(BYTE, public_tokenizers.PATTERN, bound=500)
    for lo in range(0, len(texts), 300):
        ids, ends = bpe.encode_batch(texts[lo : lo + 300])
        for t, a, b in zip(texts[lo : lo + 300], ends, ends[1:], strict=False):
            assert ids[a:b].tolist() == library.encode_ordinary(t or "")
            assert bpe.decode(ids[a:b]) == (t or "").encode()


def test_encode_and_decode_as_tables(spark, texts):
    rows = list(enumerate(texts[:60])) + [(None, "no id"), (3, texts[3])]
    out = decode(encode(frame(spark, rows), BYTE, public_tokenizers.PATTERN), BYTE, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded).decode() for r in out) == sorted(t or "" for _, t in rows)
    assert encode(frame(spark, []), BYTE, public_tokenizers.PATTERN).count() == 0


def test_word_ids_are_those_of_the_library(texts):
    library = Tokenizer.from_file(WORD)
    library.encode_special_tokens = True
    words = WordTokens(WORD, word_bound=400, piece_bound=900)
    for lo in range(0, len(texts), 250):
        for t, raw in zip(texts[lo : lo + 250], words.encode_batch(texts[lo : lo + 250]), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_special_tokens_of_the_packing_query_are_those_of_the_library(spark, tmp_path):
    from maskwright.llm.queries import op7_packing

    end, start = "<|endoftext|>", "<|startoftext|>"
    special = [end, start, f"a {end} b", f"Word{end}Word, x{start}", f"{start}{end}{end}.", f"{start}É {end}!\n{end}", "<|endoftext| > <|ENDOFTEXT|>", f"plain, {end[:-1]}", f"1{start}2", None]
    frame(spark, list(enumerate(special))).write.parquet(str(tmp_path / "documents.parquet"))
    library = Tokenizer.from_file(WORD)
    ids = {n: library.encode(t or "", add_special_tokens=False).ids for n, t in enumerate(special)}
    assert 49407 in ids[3] and 49406 in ids[3]
    got = op7_packing(spark, str(tmp_path)).collect()
    want = [(n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) for n, x in ids.items() for at, part in cut([*x, 1])]
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)


def cut(ids):
    at = 0
    for n in decompose(len(ids), 2048):
        yield at, ids[at : at + n]
        at += n


def test_decompose():
    for n in (1, 2, 3, 2047, 2048, 2049, 10_000):
        got = decompose(n, 2048)
        assert sum(got) == n and all(x & (x - 1) == 0 and x <= 2048 for x in got) and got == sorted(got, reverse=True)


def test_packing_keeps_every_token_once(spark, texts):
    rows = list(enumerate(texts[:200])) + [(None, "no id")]
    library = WordTokens(WORD)
    packed = pack(frame(spark, rows), WORD, end_id=1).toPandas()
    assert sorted(packed.sequence_id) == list(range(len(packed))) and (packed.offset == 0).all()
    assert packed.sort_values("sequence_id").length.is_monotonic_decreasing
    for i, t in rows[:200]:
        own = packed[packed.doc_id == i].sort_values("start")
        raw = b"".join(own.ids)
        assert raw == library.encode_batch([t])[0] + (1).to_bytes(4, "little") and (own.doc_tokens == len(raw) // 4).all()
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
    assert pack(frame(spark, []), WORD, end_id=1).count() == 0


def test_shards_are_contiguous_and_balanced(spark):
    rng = random.Random(8)
    rows = [(n, "é" * rng.randint(0, 300)) for n in range(700)] + [(700, None), (None, "no id"), (5, "again"), (5, "again")]
    out = shard_by_bytes(frame(spark, rows), 7).toPandas()
    assert len(out) == len(rows)
    by_id = dict(rows[:5] + rows[6:701])
    for r in out.itertuples():
        if r.doc_id == r.doc_id and r.doc_id in by_id:
            raw = (by_id[r.doc_id] or "").encode()
            assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    total, most = out["size"].sum(), out["size"].max()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g))) and abs(g["size"].sum() - total / 7) <= most
        assert g.sort_values("slot").doc_id.dropna().is_monotonic_increasing
    top = out.dropna().groupby("shard").doc_id.agg(["min", "max"])
    assert (top["min"].values[1:] >= top["max"].values[:-1]).all()
    assert shard_by_bytes(frame(spark, []), 7).count() == 0


def test_one_row_repeated_over_and_over(spark):
    out = shard_by_bytes(frame(spark, [(1, "same")] * 400), 4).toPandas()
    assert (out.groupby("shard").size() == 100).all()
