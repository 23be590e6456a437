"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept and returns a DataFrame with the columns of documents (the last one:
packed pieces). ``run`` writes each stage's result as Parquet in the shared
folder and reads it as the next one's docs, so a lost executor costs a part of
one stage at most. No row is lost by its id: the first stage gives rows without
a doc_id, and all but one of rows that share one, an id above all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.llm import decontam, packing, quality, simhash, suffix_dedup
from recurra.llm.common import materialize, own_ids, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _kept(docs: DataFrame, decisions: DataFrame, keep) -> DataFrame:
    return docs.join(decisions.where(keep).select("doc_id"), "doc_id", "left_semi").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts good (empty texts are judged like any other)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    docs, _ = own_ids(docs.select(*COLUMNS))
    return _kept(docs, quality.score(docs, model), F.col("predicted") == 1)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id."""
    return _kept(docs, simhash.near_duplicates(docs, shingle=3, radius=3), F.col("doc_id") == F.col("component_id"))


def suffix_array_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a 100-byte string covers which starts earlier.

    Spans are cut at character borders: a partly covered character stays. Texts of which nothing is left go;
    texts that were empty stay.
    """
    found = suffix_dedup.dedup(docs).select("doc_id", F.col("text").alias("left"), "n_removed")
    rows = docs.drop("text", "n_chars").join(found, "doc_id").where((F.col("n_removed") == 0) | (F.col("left") != ""))
    return rows.select("doc_id", F.col("left").alias("text"), "lang", "source", F.length("left").cast("long").alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    hits = decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts, laid into bins."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", quality_stage), ("simhash near-dedup", near_duplicate_stage),
          ("suffix-array dedup", suffix_array_stage), ("benchmark decontamination", decontamination_stage),
          ("best-fit packing", packing_stage)]

#: Packing cannot be expressed in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
