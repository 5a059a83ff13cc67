"""Streaming queries: the event table is read as a stream and run to its end."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import session
from tidemark.operators import aggregates as G
from tidemark.plans.catalog import query, with_tables
from tidemark.plans.detector_queries import gate_sql, split_sql
from tidemark.plans.shift_queries import WD, grid_sql, ks_sql
from tidemark.sources import adapters as A
from tidemark.streaming import online as O

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def events(spark, sf):
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def to_table(spark, df, label):
    return O.run_to_table(df, session.shared_path(spark, label), session.shared_path(spark, f"{label}-state"))


#: rows wait this long for earlier ones; rows behind the last watermark are settled when a stream ends
DELAY = "1 hour"
SETTLED = "passed AS (SELECT * FROM events WHERE ts < (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events))"
ES = f"{SETTLED}, es AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx FROM passed)"
MS_SRC = "src AS (SELECT event_type AS k, idx, value AS x, greatest(2, sqrt(2 * ln(2 / 0.2))) AS zc, 60 AS minw, 400 AS maxw, 40 AS pause FROM es)"


@query("st01_online_detector", with_tables(ES, MS_SRC, *split_sql("src"), body="""
SELECT ms.k AS event_type, ms.idx, es.event_id AS at FROM ms JOIN es ON es.event_type = ms.k AND es.idx = ms.idx""", recursive=True))
def online_detector(spark, sf):
    c = {"detector": "mean_split", "delta": 0.2, "min_window": 60, "max_window": 400, "cooldown": 40}
    return to_table(spark, O.online_alarms(events(spark, sf), "event_type", "ts", "event_id", "value", c, DELAY), "alarms")


@query("st02_online_gate", with_tables("""passed AS (SELECT * FROM events WHERE value > 120 AND ts < (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events WHERE value > 120)),
ev AS (SELECT event_type AS k, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n, event_id AS idx,
  CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 END AS ch, 40 AS w, 500 AS deb FROM passed)""", *gate_sql("ev"),
    body="SELECT k AS event_type, idx AS at FROM gate", recursive=True))
def online_gate(spark, sf):
    e = events(spark, sf).where("value > 120").withColumn("channel", F.col("user_id") % 2)
    return to_table(spark, O.online_gate(e, "event_type", "ts", "event_id", "channel", 40, 500, DELAY), "gate").select("event_type", "at")


@query("st02_two_sources", with_tables("""high AS (SELECT * FROM events WHERE value > 120),
cut AS (SELECT date_trunc('milliseconds', min(t)) - INTERVAL 1 HOUR - INTERVAL 10 MINUTE AS t FROM (SELECT max(ts) AS t FROM high GROUP BY user_id % 2)),
ev AS (SELECT event_type AS k, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n, epoch_us(ts) AS idx,
  user_id % 2 AS ch, 600000000 AS w, 7200000000 AS deb, event_id FROM high WHERE ts < (SELECT t FROM cut))""", *gate_sql("ev"),
    body="SELECT ev.k AS event_type, ev.event_id AS at FROM gr JOIN ev ON ev.k = gr.k AND ev.n = gr.n WHERE gr.hit", recursive=True))
def two_sources(spark, sf):
    """High values of even and of odd users, as two streams, within ten minutes of each other; one hit in two hours."""
    even, odd = (events(spark, sf).where(f"value > 120 AND user_id % 2 = {c}") for c in (0, 1))
    return to_table(spark, O.coincidences(even, odd, "event_type", "ts", "event_id", "10 minutes", "2 hours", DELAY), "pairs").select("event_type", "at")


@query("st03_count_blocks", with_tables(ES, body="""
SELECT event_type, idx // 25 AS block, round(avg(value), 6) AS block_mean FROM es GROUP BY event_type, idx // 25 HAVING count(*) = 25"""))
def count_blocks(spark, sf):
    return G.rounded(to_table(spark, O.count_blocks(events(spark, sf), "event_type", "ts", "event_id", "value", 25, DELAY), "blocks").drop("closed"), "block_mean")


@query("st03_time_blocks", """SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(avg(value), 6) AS mean FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def time_blocks(spark, sf):
    """Days closed by the watermark."""
    b = events(spark, sf).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    flat = b.select("event_type", F.col("window.start").alias("day"), "n", "mean")
    return G.rounded(to_table(spark, flat, "days").withColumn("day", F.col("day").cast("timestamp_ntz")), "mean")


SEG = SETTLED + """, cm AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 0 ELSE -1 END AS command FROM passed),
op AS (SELECT *, CASE WHEN command IN (2, 3) THEN 1 WHEN command = 0 THEN 0 END AS mark FROM cm),
sg AS (SELECT *, last_value(mark IGNORE NULLS) OVER w AS active, lag(mark) OVER w AS z FROM op WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
pv AS (SELECT *, lag(active) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM sg),
ct AS (SELECT *, count(*) FILTER (command = 0 AND was = 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stop_id FROM pv)"""


@query("st04_play_segments", with_tables(SEG, body="SELECT user_id, event_id AS at, stop_id FROM ct WHERE command = -1 AND active = 1"))
def play_segments(spark, sf):
    t = F.col("event_type")
    command = F.when(t == "purchase", 2).when(t == "signup", 3).when(t == "error", 0).otherwise(-1)
    e = events(spark, sf).withColumn("command", command)
    return to_table(spark, O.play_segments(e, "user_id", "ts", "event_id", "command", [2, 3], DELAY), "segments")


@query("st05_online_run_length")
def online_run_length(spark, sf):
    """Run lengths over blocks of 25 events; the prior is fixed in advance."""
    blocks = to_table(spark, O.count_blocks(events(spark, sf), "event_type", "ts", "event_id", "value", 25, DELAY), "blocks").withColumn("closed", F.timestamp_micros("closed"))
    path = session.shared_path(spark, "block-feed")
    blocks.write.parquet(path)
    feed = spark.readStream.schema(blocks.schema).parquet(path)
    c = {"detector": "run_length", "hazard": 0.1, "mu": 50.0, "kappa": 1.0, "alpha": 1.0, "beta": 90.0}
    from tidemark.operators import changepoint  # noqa: F401  (registers the kernel)

    return to_table(spark, O.online_alarms(feed, "event_type", "closed", "block", "block_mean", c, DELAY), "runs")


WEEKS = """w AS (SELECT event_type || '/' || strftime(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS g, event_type, value FROM events
  WHERE ts < (SELECT date_trunc('day', max(ts) - INTERVAL 1 HOUR) FROM events)),
gr AS (SELECT g, value FROM w), bs AS (SELECT x.g, e.value FROM (SELECT DISTINCT g, event_type FROM w) x JOIN events e ON e.event_type = x.event_type WHERE e.ts < TIMESTAMP '2024-01-08')"""


@query("st06_window_drift", with_tables(WEEKS, f"k AS ({ks_sql('gr', 'bs', 'g')})", f"qa AS ({grid_sql('gr', 'g')}), qb AS ({grid_sql('bs', 'g')})",
       body=f"SELECT a.g AS window_key, round(k.ks, 6) AS ks, round({WD}, 6) AS wd FROM qa a JOIN qb b ON a.g = b.g JOIN k ON k.g = a.g"))
def window_drift(spark, sf):
    """Each closed day against the first week, per event type."""
    counts = O.window_counts(events(spark, sf), "ts", ["event_type"], "value", "1 day", "1 hour")
    base = A.table(spark, sf, "events").where(F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz")).select("event_type", "value")
    path = session.shared_path(spark, "drift")

    def handle(batch, number):
        O.drift_per_window(session.cut(batch), base, ["event_type"], "value").write.mode("overwrite").parquet(f"{path}/batch={number}")

    O.run_batches(counts, session.shared_path(spark, "drift-state"), handle)
    out = spark.read.parquet(path)
    key = F.concat(F.col("event_type"), F.lit("/"), F.date_format("window_start", "yyyy-MM-dd"))
    return G.rounded(out.select(key.alias("window_key"), "ks", "wd"), "ks", "wd")


@query("st07_first_detections", with_tables(SETTLED, body="SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, true AS kept FROM passed GROUP BY user_id, event_type"))
def first_detections(spark, sf):
    """First event of each user and type, whatever the batch it arrives in, appended once."""
    first = O.first_detections(events(spark, sf), ["user_id", "event_type"], "ts", "event_id", DELAY, "400 days")
    return to_table(spark, first, "first").select("user_id", "event_type", "event_id", F.lit(True).alias("kept"))


@query("st07_clean_tracks", with_tables(SETTLED, """
s0 AS (SELECT user_id, epoch_us(ts) / 1e6 / 1200000 AS t, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS n FROM passed),
ch AS (SELECT user_id, n, t, x, t AS last, true AS keep FROM s0 WHERE n = 1
       UNION ALL SELECT s0.user_id, s0.n, s0.t, s0.x, CASE WHEN s0.t - last > 0.01 THEN s0.t ELSE last END, s0.t - last > 0.01
       FROM ch JOIN s0 ON s0.user_id = ch.user_id AND s0.n = ch.n + 1),
s AS (SELECT user_id, t, x FROM ch WHERE keep), g AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) - t AS gap FROM s),
k AS (SELECT *, CASE WHEN gap >= 0.022 THEN greatest(CAST(floor(60 * gap - 0.6) AS INTEGER), 0) ELSE 0 END AS n FROM g)""", body="""
SELECT user_id, sum(n)::BIGINT AS filled, count(*) AS seen, round(sum(x * (n + 1)), 4) AS held FROM k GROUP BY user_id""", recursive=True))
def clean_tracks(spark, sf):
    """Time is scaled down so that gaps lie around the frame rate."""
    e = events(spark, sf).withColumn("t", F.unix_micros("ts") / 1e6 / 1200000)
    c = to_table(spark, O.clean_tracks(e, "user_id", "ts", "t", ["value"], DELAY, "400 days"), "tracks")
    return c.groupBy("user_id").agg(F.count_if(~F.col("mask")).alias("filled"), F.count_if("mask").alias("seen"), F.round(F.sum("value"), 4).alias("held"))


@query("st08_parquet_sink", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def parquet_sink(spark, sf):
    return to_table(spark, events(spark, sf).select("event_type", "value"), "sink").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


