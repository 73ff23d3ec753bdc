"""Corpus pipeline: quality rules, exact de-duplication, near-duplicate join, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm import exact_dedup, jaccard_join, mixing, packing, quality_rules
from tunedata.llm.common import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules on hosts that are kept."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "source", "text")
    marked = quality_rules.document_features(rows).drop("text")
    marked = staged(marked, "quality-documents")
    return quality_rules.judge_documents(marked).where("kept").select("doc.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text (largest id)."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: the smallest id (nulls last), of equal ids any one.

    Rows are told apart by a number of their own, whatever their ids.  Texts without words have no group and stay.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    docs = staged(docs.withColumn(row, F.monotonically_increasing_id()), "near-documents")
    groups = staged(jaccard_join.jaccard_components(docs, row).select(row, "component_id"), "near-groups")
    several = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("component_id")
    members = staged(groups.join(several, "component_id").join(docs.select(row, "doc_id"), row), "near-members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row].alias(row))
    drop = staged(members.select(row).join(first.select(row), row, "left_anti"), "near-drop")
    return docs.join(drop, row, "left_anti").drop(row)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it (a document taken twice is two rows)."""
    out = mixing.mix_sources(docs)
    return out.select(*docs.columns, F.explode(F.expr("array_repeat(0, copies)")).alias("__copy")).drop("__copy")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids (little-endian unsigned 32-bit)."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("jaccard_join", near), ("mixing", mix), ("packing", pack)]

#: iterative and sequential stages: held against a brute-force version in tests/llm instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
