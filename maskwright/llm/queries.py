"""The opN_<name> queries of this folder and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio_fingerprint, language_crf, toxicity
from .byte_bpe import decode, encode
from .common import documents, is_held_out, labels, stash
from .exact_dedup import exact_duplicates
from .filter_audit import interaction_audit
from .hard_negatives import hard_negatives, quantised
from .line_dedup import drop_frequent_lines
from .minhash_dedup import near_duplicates
from .packing import pack
from .secret_scan import scan
from .sharding import shard_by_bytes
from .source_mix import mix

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Labelled documents of a language that the language model is fitted to.
LANGUAGE_SAMPLE = 400


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=2, percent=80)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_crf.fit(language_crf.training_windows(docs.where(~is_held_out()), LANGUAGE_SAMPLE))
    return language_crf.identify(docs, model).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op4_audio_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: every embedding is played as a melody.  Other takes (shifted, less loud, with noise, see audio_fingerprint.take) of the recordings whose id is divisible
    by 50 are aligned with all recordings, equal ones as one class: each take should find the print_class of its own recording, 3 + id % 29 frames into it."""
    recordings = audio_fingerprint.recordings_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    takes = audio_fingerprint.takes_of(recordings.where("id % 50 = 0"))
    found = audio_fingerprint.align(audio_fingerprint.fingerprints(recordings), audio_fingerprint.fingerprints(takes), same_id=True)
    return found.withColumnRenamed("id", "vec_id")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = decode(encode(documents(spark, sf_dir), BYTE_BPE, public_tokenizers.PATTERN), BYTE_BPE, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(documents(spark, sf_dir), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(documents(spark, sf_dir), WORD_BPE, end_id=1, limit=2048, payload=F.crc32("ids").alias("ids_crc32"), special_as_text=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    named = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit_calibrated(spark, toxicity.training_samples(docs.where(~is_held_out()), labels(spark, sf_dir).where(~is_held_out())))
    return toxicity.score(docs, model).select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_frequent_lines(documents(spark, sf_dir), least=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction_audit(documents(spark, sf_dir), labels(spark, sf_dir))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir), weights=(3, 1, 2), share=1.5, most=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 256, relabel=relabel)
    return hard_negatives(vectors, F.col("id") % 100 == 0, positives=5, negatives=5, least_percent=80, most_percent=100)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # itself made of this folder's operators

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_audio_fingerprint": op4_audio_fingerprint,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_sharding": op6_sharding,
    "op7_packing": op7_packing,
    "op8_secret_scan": op8_secret_scan,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_source_mix": op12_source_mix,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    # all pairs that share a shingle: quick enough on the small tables that results are compared on
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) < 2 THEN words ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e AS a JOIN e AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT a AS doc_id, b AS other FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a),
least_of AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(other, s.doc_id)) AS component_id, s.doc_id <= coalesce(other, s.doc_id) AS kept
FROM s LEFT JOIN least_of USING (doc_id)
""",
    "op3_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
""",
    "op6_sharding": r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
         xor(4294967295, list_reduce(list_transform(string_split_regex(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\1 ', 'g'), ' '), lambda h: CASE WHEN h = '' THEN NULL ELSE ('0x' || h)::BIGINT END),
             lambda c, b: CASE WHEN b IS NULL THEN c ELSE xor(c >> 8, t[1 + xor(c & 255, b)]) END, 4294967295)) AS text_crc32
  FROM documents, crc_table),
p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32 ROWS UNBOUNDED PRECEDING) - (size + 1) // 2 AS middle, sum(size) OVER () AS total FROM d),
s AS (
  SELECT *, CAST(least(23, 24 * middle // total) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
""",
    "op10_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
""",
    "op11_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
says AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
  FROM d JOIN firsts USING (t) LEFT JOIN says USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f AS a, f AS b, f AS c, f AS d, f AS e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, own, c.*, contains(fails, own) AS hit, length(translate(fails, before, '')) < length(fails) AS gone FROM s, c),
g AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (NOT hit AND NOT gone) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed, sum(n) FILTER (hit AND gone) AS redundant, sum(n) FILTER (fails = own) AS unique_fails,
         sum(good) FILTER (hit AND NOT gone) AS good_lost, sum(toxic) FILTER (hit AND NOT gone) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM g
""",
    "op13_hard_negatives": r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id AS other, v.label = a.label AS same, CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank, other AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""",
}
