"""A corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

1. language: documents that are of no language go: those without a letter, and those whose words belong to all languages of the corpus together with less than three tenths of their weight (other alphabets,
   hexadecimal, shuffled or random letters).  Code-switched texts stay.
2. lines: lines that ten or more of the remaining documents share go from all of them.
3. near_dedup: of every group of near-duplicates (five-word shingles, similarity of 0.8 or more) the smallest doc_id stays.
4. secrets: secrets in the remaining texts are replaced by [SECRET]; no document goes.
5. packing: the remaining texts are packed into sequences of up to 2048 tokens.

Stages 1 to 4 return the columns of documents, whatever others come in; n_chars follows the text.  An empty table goes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import language_crf
from maskwright.llm.common import KeyFilter, discard, is_held_out, stash
from maskwright.llm.line_dedup import drop_frequent_lines
from maskwright.llm.minhash_dedup import near_duplicates
from maskwright.llm.packing import pack
from maskwright.llm.queries import LANGUAGE_SAMPLE
from maskwright.llm.secret_scan import redact

#: Share of a text's words that is of the corpus's languages at least.  Clean texts of ten words and more have 0.37 and more, most texts of other alphabets, random or shuffled letters less than 0.2.
LEAST_SCORE = 0.3
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits the model, with a state for words of no language, on a bounded sample of docs and keeps the documents that are of some language; a null id is judged by its text too."""
    model = language_crf.fit(language_crf.with_other(language_crf.training_windows(docs.where(~is_held_out()), LANGUAGE_SAMPLE)))
    return language_crf.keep_identified(docs, model, LEAST_SCORE).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without its shared lines; null and empty texts come back empty, rows that repeat an id count as one document."""
    return _with_length(drop_frequent_lines(docs.select(*COLUMNS), least=10))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays.  Rows that repeat an id (or have none) stay together if one of them does, and go together else.

    A bitmap filter over the ids that go leaves most texts where they are; only the others are joined to those ids."""
    found = near_duplicates(docs, size=5, percent=80).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = stash(found.where("not kept").select(F.col("doc_id").alias("gone")), "gone")
    marked = KeyFilter(gone, "gone").mark(docs.select(*COLUMNS), "hit", F.col("doc_id"))
    rest = marked.where("hit").join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")
    return marked.where("not hit").union(rest).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; null texts stay null, repeated rows get equal texts."""
    return _with_length(redact(docs.select(*COLUMNS)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document in one piece; null and empty texts are their end token alone, repeated rows and rows without an id are packed each."""
    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, limit=2048, payload=F.crc32("ids").alias("ids_crc32"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("lines", lines), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]

#: No SQL: neither the language model nor the tokenizer can be written in it; tests/llm hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over sf_dir's documents; each stage's result is a table in the application's part of the shared folder, which goes once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
        before = docs
    return docs
