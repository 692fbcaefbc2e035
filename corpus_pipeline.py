"""A corpus pipeline of five stages, each of which keeps, changes or places the documents that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemotide.llm import langid
from mnemotide.llm.minhash import near_duplicates
from mnemotide.llm.packing import pack
from mnemotide.llm.pii_anchor import personal_data
from mnemotide.llm.span_dedup import dedup_spans
from mnemotide.scratch import Scratch, bounded_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an accepted language go; `lang` becomes the language found where it differs.

    The operator works on narrow rows; only rejected and relabelled documents, which are few, meet the texts again,
    so texts need not be shuffled. Rows with a null id stay as they are.
    """
    bounded_batches(spark)
    found = langid.identify(docs, langid.fit_on(docs, sample_rows=2000), host=F.col("source"), keep=("lang",))
    changed = found.where((~F.col("accepted")) | ~F.col("language").eqNullSafe(F.col("lang")))
    changed = Scratch(spark, "language").save(changed.groupBy("doc_id").agg(F.bool_or("accepted").alias("accepted"), F.max_by("language", "probability").alias("language")))
    joined = docs.select(*COLUMNS).join(changed, "doc_id", "left").where("coalesce(accepted, true)")
    return joined.select("doc_id", "text", F.coalesce("language", "lang").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity of 0.8 or more."""
    bounded_batches(spark)
    gone = near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def span_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated spans of sentences go but for their first place; a document that loses all of its text goes."""
    bounded_batches(spark)
    found = dedup_spans(docs, keep=("text", "lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    kept = found.where(~changed | (F.trim(F.coalesce("clean_text", F.lit(""))) != ""))
    return kept.select("doc_id", F.when(changed, F.col("clean_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.length("clean_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes a mark of its kind."""
    bounded_batches(spark)
    found = personal_data(docs, keep=("lang", "source", "n_chars"), redact=True)
    changed = F.col("spans") != ""
    return found.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.when(changed, F.length("clean_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in batches of equal padded length."""
    return pack(docs, budget=65536, buckets=8)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("span_dedup", span_dedup), ("pii", pii), ("packing", packing)]

ORACLE_SQL = None  # the language model and the anchors' parsers have no form in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
