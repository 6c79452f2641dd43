"""The corpus pipeline: quality rules, toxicity, near-duplicates, PII, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the
shared folder and reads again as the next stage's docs. All but the last keep the columns of documents.
Models are fitted on the labelled rows of sf_dir (bounded samples) and applied to all of docs.

Defined cases: null, empty and short texts fail the base rules and go in the first stage; a later stage that is given them keeps
them, and packing makes one piece of the end id of each; rows that repeat are judged alike, and copies of a text under one
doc_id stay together; rows without doc_id are never near-duplicates; extra columns pass by until packing; an empty table
gives no rows; without labels nothing is rejected beyond the base rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import common, neardup, packing, pii, quality, toxicity


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    model = quality.train(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return quality.keep_documents(docs, model)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    model = toxicity.train(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return toxicity.keep_documents(docs, model)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of smallest doc_id."""
    return neardup.keep_documents(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes."""
    return pii.redact(docs, pii.train(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences."""
    return packing.packed(docs)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("neardup", neardup_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: The learned verdicts of two stages can't be written in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.persist(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
