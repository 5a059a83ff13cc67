"""A training corpus from ``documents``: five stages, each over all rows its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
documents; the last one adds shard and vslot. ``run`` writes the result of each stage to the
shared folder and reads it back, so that a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, quality, sharding, simhash
from tidemark.llm.common import stored, table
from tidemark.session import ship

#: Learned models and near-duplicate groups cannot be said in SQL; tests compare with plain loops.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    ship(spark)
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    ship(spark)
    return simhash.kept_documents(docs)


def unseen_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    ship(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixing.mixed_documents(docs)


def sharded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and virtual slot."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("near-dedup", distinct_documents),
    ("decontamination", unseen_documents),
    ("mixing", mixed_documents),
    ("sharding", sharded_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
