"""A corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents: rejected documents go and lines above the limits are cut; one document of each group of near copies stays;
personal data is replaced by its kind; documents are repeated or left out as the mix says. The last returns the pieces of
packed sequences.

Every stage, by what its operator states: null text or no words: rejected by quality (a null doc_id alone rejects nothing, and a
null source is a source of its own); texts of any length are worked on whole; repeated rows are judged each, and of copies near_dedup
keeps the row with the smallest doc_id; ties in the mix go by doc_id, then text, rows in packing by their task's order; an
empty table gives empty tables with the same columns; further columns, whatever their names, are carried through all but the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm import mixing, neardup, packing, pii, quality
from skyloom.llm.common import stash
from skyloom.session import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.quality_documents(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return neardup.distinct_documents(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pii.redacted_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Token ids and sampling order have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
