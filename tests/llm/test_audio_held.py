"""Held notes, pauses and silence: stable prints, bounded votes and recall on sustained recordings."""

import tracemalloc

import numpy as np
import pytest

from maskwright.llm import audio_fingerprint as audio

SF = "/root/testdata/sf0.001"


def noisy(pcm, rng, cut):
    return (pcm[audio.HOP * cut :] + rng.normal(0, 500, len(pcm) - audio.HOP * cut)).clip(-32768, 32767).astype("<i2")


def test_prints_do_not_depend_on_rounding(spark, monkeypatch):
    vectors = [r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").limit(60).collect()]
    pcm = [*map(audio.melody, map(np.array, vectors)), audio.melody(np.ones(40)), audio.melody(np.repeat([0.3, -1.0, 0.8], 20)), np.zeros(9000, np.int16)]
    before = [audio.fingerprint(x) for x in pcm]
    plain, rng = audio.chroma, np.random.default_rng(5)
    for size in (1e-9, 1e-13):
        monkeypatch.setattr(audio, "chroma", lambda x, rate=audio.RATE, size=size: (c := plain(x, rate)) * (1 + size * rng.uniform(-1, 1, c.shape)))
        assert all((audio.fingerprint(x) == p).all() for x, p in zip(pcm, before, strict=True))


def brute(own, query, least_votes, most_error):
    """Least error, most votes, smallest offset over all offsets, counted frame by frame."""
    best = None
    for o in range(-len(query), len(own)):
        error, overlap = audio.bit_error(query, own, o)
        if overlap >= max(1, min(len(own), len(query)) // 2) and error <= most_error:
            lo = max(0, -o)
            votes = int((query[lo : lo + overlap] == own[lo + o : lo + o + overlap]).sum())
            if votes >= least_votes:
                best = min(best or (2, 0, 0, 0), (error, -votes, o, overlap))
    return best


def test_votes_and_errors_by_runs_are_those_by_frames():
    rng = np.random.default_rng(1)
    for t in range(120):
        some = rng.integers(0, 1 << 32, 6, dtype=np.uint32)
        make = lambda n, some=some: np.repeat(some[rng.integers(0, 6, 40)], rng.integers(1, 12, 40))[:n]
        own, query = make(int(rng.integers(1, 200))), make(int(rng.integers(1, 200)))
        query = own.copy() if t % 5 == 0 else np.r_[make(5), own[3:90]] if t % 2 else query
        found = audio.QueryIndex([3, 7], [rng.integers(0, 1 << 32, 50, dtype=np.uint32), query]).align(own, 3, 0.3)
        want = brute(own, query, 3, 0.3)
        assert [(x[4], -x[2], x[1], x[3]) for x in found if x[0] == 7] == ([want] if want else [])


def test_held_notes_and_silence_take_memory_by_their_frames():
    held = audio.melody(np.ones(10_010))
    prints = [audio.fingerprint(x) for x in (held, audio.take(held, 5), np.zeros(64 * 20_000, np.int16))]
    assert all(len(p) > 19_900 for p in prints)
    alternating = np.tile(np.array([1, 2], np.uint32), 3000)  # no two equal in a row
    tracemalloc.start()
    index = audio.QueryIndex([0, 1, 2], prints)
    assert {x[0] for x in index.align(prints[0], 3, 0.2)} == {0, 1}
    assert [x[0] for x in index.align(prints[2], 3, 0.2)] == [2]
    found = audio.QueryIndex([0], [alternating]).align(alternating[1:].copy(), 3, 0.2)
    assert (found[0][1], found[0][4]) == (-1, 0.0)
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()


def test_recall_on_sustained_recordings():
    rng = np.random.default_rng(7)
    songs = [audio.melody(np.repeat(rng.normal(size=int(rng.integers(2, 5))), 16)) for _ in range(40)] + [audio.melody(np.full(40, x)) for x in rng.normal(size=6)]
    prints = [audio.fingerprint(x) for x in songs]
    index = audio.QueryIndex(list(range(len(prints))), prints)
    want, got, keys = set(), set(), [set(audio.index_keys(p).tolist()) for p in prints]
    for n, song in enumerate(songs):
        own = audio.fingerprint(noisy(song, rng, int(rng.integers(0, 20))))
        mine = set(audio.index_keys(own).tolist())
        got |= {(n, x[0]) for x in index.align(own, 3, 0.2) if mine & keys[x[0]]}
        for q, p in enumerate(prints):  # held notes share most bits, so this holds for most pairs: it bounds what may be found
            least = min(len(own), len(p)) // 2
            if any(e <= 0.2 and m >= least for e, m in (audio.bit_error(p, own, o) for o in range(-len(p), len(own)))):
                want.add((n, q))
    own = {(n, n) for n in range(len(songs))}
    assert own <= want and len(own & got) >= 0.9 * len(own) and not got - want


def test_recordings_that_share_silence_alone_do_not_meet(spark):
    rng = np.random.default_rng(9)
    pause = np.zeros(audio.HOP * 120, np.int16)
    pcm = {n: np.r_[pause, audio.melody(rng.normal(size=400)), pause] for n in range(40)} | {100 + n: np.zeros(audio.HOP * (60 + n), np.int16) for n in range(3)}
    prints = audio.fingerprints(spark.createDataFrame([(n, x.astype("<i2").tobytes()) for n, x in pcm.items()], "id long, pcm binary"))
    keys = [set(audio.index_keys(audio.fingerprint(x)).tolist()) for n, x in pcm.items() if n < 100]
    silence = set(audio.index_keys(audio.fingerprint(pcm[101])).tolist())
    assert len(silence) == 1 and not any(silence & k for k in keys)
    found = {(r.id, r.query_id) for r in audio.align(prints, prints.where("id = 101")).collect() if r.query_id is not None}
    assert found == {(100, 101), (102, 101)}


@pytest.mark.parametrize("vector", [[None, 1.0, None], [float("nan"), 1.0, 2.0], [float("inf"), 0.0], [], None, [0.0] * 8])
def test_odd_vectors_are_recordings_all_the_same(spark, vector):
    rows = spark.createDataFrame([(1, vector), (2, [0.5, -0.5] * 20)], "vec_id long, embedding array<double>")
    prints = audio.fingerprints(audio.recordings_of(rows, "vec_id", "embedding"))
    assert sorted((r.id, r.query_id) for r in audio.align(prints, prints.where("id = 2")).collect()) == [(1, None), (2, None)]
