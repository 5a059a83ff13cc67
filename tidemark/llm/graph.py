"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

ROUNDS = 60


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(
        low.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) of all linked nodes; the root is the smallest node reachable.

    Each round ties nodes to the smallest neighbour, first of the larger side, then
    of the smaller one; both are sums with partial results and joins, no list of
    neighbours is held. Rounds grow with the logarithm of the longest chain. Every
    round is a stored table. No links give no rows; loops and repeated links are ignored.
    """
    a, b = F.col(left), F.col(right)
    edges = links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges = stored(edges, "links")
    mark = None
    for _ in range(ROUNDS):
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
        edges = stored(_small(_large(edges)), "links")
    else:
        raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
