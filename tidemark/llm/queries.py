"""The registered queries of the subpackage, each over its whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, source_audit
from tidemark.llm.chat import chat_table
from tidemark.llm.common import table
from tidemark.llm.decontaminate import leak_table
from tidemark.llm.quality import quality_table
from tidemark.session import ship

#: query: (table, module, function from the table to the result)
QUERIES = {
    "op1_entropy_mix": ("documents", "mixing", "mix_table"),
    "op4_url_model": ("pages", "url_filter", "url_table"),
    "op6_flac_media": ("documents", "flac", "media_table"),
    "op7_virtual_slots": ("documents", "sharding", "shard_table"),
    "op8_covering_simhash": ("documents", "simhash", "near_duplicate_table"),
    "op9_secret_automaton": ("documents", "secret_scan", "secret_table"),
    "op10_line_windows": ("documents", "line_dedup", "line_table"),
    "op11_sanitise": ("documents", "sanitise", "private_table"),
    "op12_token_align": ("documents", "token_align", "align_table"),
    "op13_source_audit": ("documents", "source_audit", "audit_table"),
}

ORACLES: dict[str, str] = {"op10_line_windows": line_dedup.SQL, "op13_source_audit": source_audit.SQL}


def _on_table(source: str, module: str, function: str) -> Callable[[SparkSession, str], DataFrame]:
    apply = getattr(importlib.import_module(f"tidemark.llm.{module}"), function)

    @wraps(apply)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship(spark)
        return apply(table(spark, sf, source))

    return run


def chat_turns(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations and one whose texts hold control strings."""
    probe = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)


def chats(spark: SparkSession, sf: str) -> DataFrame:
    return chat_table(chat_turns(spark, sf))


def leaks(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return leak_table(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def quality(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return quality_table(table(spark, sf, "documents"), table(spark, sf, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _on_table(*where) for name, where in QUERIES.items()} | {"op3_chat_log": chats, "op5_weak_labels": quality, "op2_latent_leaks": leaks}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
