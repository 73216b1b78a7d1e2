"""From documents to packed sequences: filter, deduplicate, mix and pack.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage
before it kept, and returns the columns of documents; the last one returns the
sequences. None of them needs anything but its input and the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import exact, mixing, near, packing, rules
from corpusloom.plans.table_queries.base import Query
from corpusloom.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep."""
    return rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in mixed order."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each sequence."""
    return packing.packing_digest(docs)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]

# SQL has no tokenizer, and near copies need more than SQL can say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


PIPELINE = {"pipeline": Query(run, ORACLE_SQL)}
