"""The engine's logical tables, derived from the shared test tables.

Each adapter has a twin: a DuckDB select text with the same columns, used as a
common table expression in the SQL the results are checked against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_YEAR = 1995
LAST_YEAR = 2001
POST_YEARS = list(range(BASE_YEAR + 1, LAST_YEAR + 1))
HORIZON = "30->15"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def errors(spark: SparkSession, sf: str) -> DataFrame:
    """``trajectory_errors``: one row per order, six games a year."""
    game = F.concat(F.lit("g"), (F.col("o_custkey") % 6).cast("string"))
    year = F.year("o_orderdate")
    return table(spark, sf, "orders").select(
        F.concat_ws("_", year.cast("string"), game).alias("match_id"),
        year.alias("year"),
        F.concat(F.lit("2024-01-01_10-00_"), game, F.lit(".log")).alias("log_file"),
        game.alias("proc_set_file"),
        F.col("o_orderpriority").alias("model"),
        F.lit(HORIZON).alias("horizon"),
        F.col("o_orderkey").alias("traj_id"),
        (F.col("o_totalprice") / 49999).alias("ade_traj"),
        (F.col("o_totalprice") / 24999).alias("fde_traj"),
        F.lit(15).alias("n_steps_pred"),
    )


ERRORS = """errors AS (
  SELECT CAST(year(o_orderdate) AS VARCHAR) || '_g' || (o_custkey % 6) AS match_id,
         CAST(year(o_orderdate) AS INTEGER) AS year,
         '2024-01-01_10-00_g' || (o_custkey % 6) || '.log' AS log_file,
         'g' || (o_custkey % 6) AS proc_set_file, o_orderpriority AS model,
         '30->15' AS horizon, o_orderkey AS traj_id, o_totalprice / 49999 AS ade_traj,
         o_totalprice / 24999 AS fde_traj, CAST(15 AS INTEGER) AS n_steps_pred
  FROM orders)"""


def games(spark: SparkSession, sf: str, model: str | None = None) -> DataFrame:
    """Mean error and row count per game and year."""
    df = errors(spark, sf)
    if model:
        df = df.where(F.col("model") == model)
    return df.groupBy("proc_set_file", "year").agg(
        F.avg("ade_traj").alias("ade_mean"), F.count(F.lit(1)).alias("n_traj"))


GAMES = """games AS (
  SELECT proc_set_file, year, avg(ade_traj) AS ade_mean, count(*) AS n_traj
  FROM errors GROUP BY ALL)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """The large order-free variant: one row per line item."""
    return table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("model"),
        (F.col("l_extendedprice") / 7000).alias("value"),
        F.col("l_quantity").alias("quantity"), F.col("l_suppkey").alias("unit"))


LINES = """lines AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag AS model,
         l_extendedprice / 7000 AS value, l_quantity AS quantity, l_suppkey AS unit
  FROM lineitem)"""


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """One detection per event; the user is the robot, the value its position."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select(
        F.concat(F.lit("g"), (F.col("user_id") % 6).cast("string")).alias("game"),
        F.when(F.col("user_id") % 2 == 0, "blue").otherwise("yellow").alias("team"),
        F.col("user_id").alias("robot_id"),
        F.col("event_id").alias("frame"),
        (ts / 1000000.0).alias("t"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        F.col("event_type").alias("kind"),
    )


DETECTIONS = """detections AS (
  SELECT 'g' || (user_id % 6) AS game,
         CASE WHEN user_id % 2 = 0 THEN 'blue' ELSE 'yellow' END AS team,
         user_id AS robot_id, event_id AS frame, epoch_us(ts) / 1000000.0 AS t,
         value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y,
         event_type AS kind FROM events)"""


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """Track rows with speed from successive positions (first row of a track dropped)."""
    from tidemark.operators.ordered import lag_value, series

    s = series(detections(spark, sf).where(F.col("kind") != "error"), ["robot_id"], ["t", "frame"], "pos")
    packed = s.using(s.df.withColumn("_xy", F.struct("x", "y")))
    out = lag_value(packed, "_xy", 1, "_prev").where(F.col("_prev").isNotNull())
    return out.select(
        "game", "team", "robot_id", "frame", "t", "x", "y", "pos",
        (F.col("x") - F.col("_prev.x")).alias("vx"), (F.col("y") - F.col("_prev.y")).alias("vy"))


STEPS = """steps0 AS (
  SELECT *, row_number() OVER (PARTITION BY robot_id ORDER BY t, frame) - 1 AS pos,
         x - lag(x) OVER (PARTITION BY robot_id ORDER BY t, frame) AS vx,
         y - lag(y) OVER (PARTITION BY robot_id ORDER BY t, frame) AS vy
  FROM detections WHERE kind <> 'error'),
steps AS (SELECT game, team, robot_id, frame, t, x, y, pos, vx, vy FROM steps0 WHERE pos > 0)"""


def divisions(spark: SparkSession, sf: str) -> DataFrame:
    """Division of four of the six games, from the nation and region tables."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).where("n_nationkey < 4").select(
        F.concat(F.lit("g"), F.col("n_nationkey").cast("string")).alias("proc_set_file"),
        F.when(F.col("r_regionkey") % 2 == 0, "A").otherwise("B").alias("division"))


DIVISIONS = """divisions AS (
  SELECT 'g' || n_nationkey AS proc_set_file,
         CASE WHEN r_regionkey % 2 = 0 THEN 'A' ELSE 'B' END AS division
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 4)"""


def weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with an error and a positive weight, for the weighted statistics."""
    return errors(spark, sf).select(
        "traj_id", "year", "proc_set_file", "ade_traj",
        (1 + F.col("traj_id") * 7919 % 101 / 25).alias("w"))


WEIGHTED = """weighted AS (
  SELECT traj_id, year, proc_set_file, ade_traj, 1 + traj_id * 7919 % 101 / 25 AS w FROM errors)"""


def alarms(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed rule for alarms on the error stream: unusually large errors."""
    s = stream(spark, sf)
    return s.df.where("ade_traj > 9.3").select("model", "idx", "year", "traj_id", "ade_traj")


def stream(spark: SparkSession, sf: str):
    from tidemark.sources.tables import error_stream

    return error_stream(errors(spark, sf), ["model"])


STREAM = """stream AS (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY year, match_id, traj_id) - 1 AS idx
  FROM errors)"""

ALARMS = """alarms AS (
  SELECT model, idx, year, traj_id, ade_traj FROM stream WHERE ade_traj > 9.3)"""

# two alarm channels on one axis: position, channel
CHANNELS = """channels AS (
  SELECT model, idx, year, CAST(CASE WHEN traj_id % 2 = 0 THEN 0 ELSE 1 END AS INTEGER) AS channel
  FROM stream WHERE ade_traj > 9.3)"""


def channels(spark: SparkSession, sf: str) -> DataFrame:
    return alarms(spark, sf).select(
        "model", "idx", "year", F.when(F.col("traj_id") % 2 == 0, 0).otherwise(1).alias("channel"))


def totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Baseline and post rows per series, the denominators of alarm rates."""
    return df.groupBy(*keys).agg(
        F.count_if(F.col("year") == BASE_YEAR).alias("base_rows"),
        F.count_if(F.col("year") > BASE_YEAR).alias("post_rows"))
