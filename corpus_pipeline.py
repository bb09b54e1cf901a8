"""A training-data pipeline: five stages, each on all that the one before kept.

language ID -> line dedup -> MinHash near-dedup -> benchmark decontamination ->
BPE encoding and decoding. Each stage is written as Parquet to the shared
folder and reread; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyrill.llm import bpe, decontaminate, langid, linededup, minhash
from skyrill.llm.shared import free_name, stage, table


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids``; a sort-merge join at every size, as ``ids`` grow with the documents."""
    key = free_name("id", docs)
    return docs.join(ids.select(F.col("doc_id").alias(key)).distinct().hint("merge"), F.col("doc_id") == F.col(key), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language of sufficient confidence go; ``lang`` is what was found."""
    verdict = stage(langid.identify_documents(docs).select("doc_id", "language", "kept"), "language")
    kept = _without(docs, verdict.where(~F.col("kept")))
    # Only declarations that the evidence overrules are looked up again.
    changed = verdict.where("kept").join(docs.select("doc_id", "lang"), "doc_id").where(~F.col("language").eqNullSafe(F.col("lang")))
    key, found = free_name("id", docs), free_name("found", docs)
    changed = changed.groupBy(F.col("doc_id").alias(key)).agg(F.min("language").alias(found))
    out = kept.join(changed.hint("merge"), F.col("doc_id") == F.col(key), "left").withColumn("lang", F.coalesce(found, "lang"))
    return out.select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and with them documents of which nothing but blanks and line ends is left."""
    out = linededup.dedup_lines(docs, exact_short=True).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    verdict = stage(minhash.near_duplicates(docs).select("doc_id", "kept"), "near")
    return _without(docs, verdict.where(~F.col("kept")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, decontaminate.matches(docs, table(spark, sf_dir, "benchmark")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text of each remaining document."""
    return bpe.digest(docs, bpe.default_vocabulary())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", encoding),
]

#: Language ID learns a model and the other stages iterate: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
