"""From raw documents to packed token windows, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Every stage's result is written to the shared folder and read again before the next one.
"""

from __future__ import annotations

import functools
import threading

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import langid, neardup, packing, pii, suffix_dedup
from tallyspark.llm.common import counted, delete, documents, forget, recorded, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Tables that the stage before stored on its way, by session, corpus and thread: pipelines in one process leave each other's alone.
_LEFT: dict[tuple, set[str]] = {}


def stage(work):
    """A stage, which reads the five columns alone. It first deletes what the stage before it has left in the shared folder: the stages of a pipeline
    run one after the other in a thread, and each result is written before the next stage begins."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        pipeline = spark.sparkContext.applicationId, sf_dir, threading.get_ident()
        delete(spark, _LEFT.pop(pipeline, set()))
        with recorded() as left:
            out = work(spark, docs.select(*COLUMNS), sf_dir)
        _LEFT[pipeline] = left
        return out

    return run_stage


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which replaces what `lang` says; null, empty and other texts without a letter go, and so does every text where
    nothing could be learned. Repeated rows and rows with a null id are judged like any other; texts are read whole."""
    rows = langid.predict(docs, langid.train(docs), ("source", "n_chars"))
    return rows.where(F.col("lang_pred") != langid.UND).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


@stage
def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the least id stays. Of rows that repeat an id one stays (the
    first by text, then by the other columns), so exact repeats go too. Rows with a null id, and null or empty texts, are near to nothing and stay."""
    gone = neardup.near_duplicates(docs, neardup.Rule(words=5, share=80)).where("not kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    twice = counted(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    if not twice.stored_rows:
        return kept
    one = kept.join(twice, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    return kept.join(twice, "doc_id", "left_anti").union(one).select(*COLUMNS)


@stage
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that stand earlier in the corpus; whole characters stay. A document of which nothing
    is left goes; null and empty texts stay as empty ones. Rows with a null id keep their text; rows that repeat an id: as `deduplicated` says."""
    rows = suffix_dedup.deduplicated(docs, keep=("lang", "source"))
    text = F.when(F.col("spans").isNull(), F.col("body").cast("string")).otherwise(suffix_dedup.remaining(F.col("body"), F.col("spans")))
    whole = "size(spans) = 1 and spans[0].start = 0 and spans[0].end = octet_length(body)"  # told from the spans, so that the text is made once
    return rows.where(f"spans is null or not ({whole})").select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each span of personal data replaced by its kind. Every row stays; a null text stays null, with a null length."""
    return docs.select("doc_id", pii.masked(F.col("text")).alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of at most 4096 tokens: null and empty texts as their end alone, repeated rows and null ids
    as documents of their own, very long texts in several windows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("minhash_neardup", minhash_neardup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("pii_masking", pii_masking),
    ("packing", pack),
]

#: SQL expresses none of the learned and searching stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, work in STAGES[:-1]:
        docs = stored(work(spark, docs, sf_dir), name)
        if before is not None:
            forget(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
