"""Queries over detectors, grids, gates and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import aggregates as G
from tidemark.operators import evaluate as E
from tidemark.operators import gates as N
from tidemark.operators import grids as D
from tidemark.operators import joins as J
from tidemark.operators import studies as S
from tidemark.operators.detectors.linked import detect
from tidemark.operators.ordered import series
from tidemark.operators.smoothers import smoothed
from tidemark.plans.catalog import query, with_tables
from tidemark.plans.shift_queries import windows
from tidemark.plans.window_queries import ROBZ, SCORES, scores
from tidemark.sources import adapters as A

BASE, POST = A.BASE_YEAR, A.POST_YEARS
RZ = ("robz", {"w": 40})

# ---- detectors in SQL -----------------------------------------------------------

def hinkley_sql(src: str) -> tuple[str, ...]:
    """Page-Hinkley over ``src`` (k, idx, x, delta, thr, ready, pause), by recursion."""
    return (
        f"hd AS (SELECT k, idx, thr, ready, pause, x - avg(x) OVER (PARTITION BY k ORDER BY idx) - delta AS dev FROM {src})",
        """hr AS (SELECT k, idx, greatest(dev, 0) AS g, 0 AS cool, idx + 1 >= ready AND greatest(dev, 0) > thr AS hit FROM hd WHERE idx = 0
  UNION ALL SELECT k, idx, g, cool, cool = 0 AND idx + 1 >= ready AND g > thr FROM (
    SELECT n.k, n.idx, n.ready, n.thr, greatest(CASE WHEN hr.hit THEN 0 ELSE hr.g END + n.dev, 0) AS g,
           CASE WHEN hr.hit THEN n.pause ELSE greatest(hr.cool - 1, 0) END AS cool FROM hr JOIN hd n ON n.k = hr.k AND n.idx = hr.idx + 1))""",
        "ph AS (SELECT k, idx FROM hr WHERE hit)")


def split_sql(src: str, tag: str = "ms") -> tuple[str, ...]:
    """Two-halves detector over ``src`` (k, idx, x, zc, minw, maxw, pause), by recursion."""
    z = """abs((k2.s - k1.s) / na - (k3.se - k2.s) / nb) / nullif(sqrt(greatest((k2.q - k1.q) - pow(k2.s - k1.s, 2) / na, 0) / (na - 1) / na
      + greatest((k3.qe - k2.q) - pow(k3.se - k2.s, 2) / nb, 0) / (nb - 1) / nb), 0)"""
    p = f"{tag}p"
    return (
        f"""{p} AS (SELECT k, idx, zc, minw, maxw, pause, sum(x) OVER w AS se, sum(x * x) OVER w AS qe, sum(x) OVER w - x AS s, sum(x * x) OVER w - x * x AS q
  FROM (SELECT k, idx, zc, minw, maxw, pause, x - avg(x) OVER (PARTITION BY k) AS x FROM {src}) WINDOW w AS (PARTITION BY k ORDER BY idx))""",
        f"""{tag}r AS (SELECT k, idx, 0::BIGINT AS st, 0 AS cool, false AS hit, 0::BIGINT AS cut FROM {p} WHERE idx = 0
  UNION ALL SELECT t.k, t.idx, t.st, t.cool, coalesce(t.cool = 0 AND na + nb >= k3.minw AND {z} > k3.zc, false), t.cut
  FROM (SELECT *, cut - lft AS na, idx - cut + 1 AS nb FROM (SELECT *, lft + (idx - lft + 1) // 2 AS cut FROM (
    SELECT r.k, r.idx + 1 AS idx, CASE WHEN r.hit THEN r.cut ELSE r.st END AS st, CASE WHEN r.hit THEN c.pause ELSE greatest(r.cool - 1, 0) END AS cool,
      greatest(CASE WHEN r.hit THEN r.cut ELSE r.st END, r.idx + 2 - c.maxw) AS lft
    FROM {tag}r r JOIN (SELECT DISTINCT k, pause, maxw FROM {src}) c ON c.k = r.k))) t
  JOIN {p} k3 ON k3.k = t.k AND k3.idx = t.idx JOIN {p} k2 ON k2.k = t.k AND k2.idx = t.cut JOIN {p} k1 ON k1.k = t.k AND k1.idx = t.lft)""",
        f"{tag} AS (SELECT k, idx FROM {tag}r WHERE hit)")


def gate_sql(src: str) -> tuple[str, ...]:
    """Coincidence gate over ``src`` (k, n, idx, ch, w, deb), by recursion."""
    return (
        f"""gr AS (SELECT k, n, idx, CASE WHEN ch = 0 THEN idx END AS ha, CASE WHEN ch = 1 THEN idx END AS hb, -1000000000::BIGINT AS last, false AS hit FROM {src} WHERE n = 0
  UNION ALL SELECT k, n, idx, CASE WHEN ok THEN NULL ELSE ha END, CASE WHEN ok THEN NULL ELSE hb END, CASE WHEN ok THEN idx ELSE last END, ok FROM (
    SELECT *, coalesce(idx - CASE WHEN ch = 0 THEN hb ELSE ha END <= w AND idx - last > deb, false) AS ok FROM (
      SELECT e.k, e.n, e.idx, e.ch, e.w, e.deb, gr.last, CASE WHEN e.ch = 0 THEN e.idx ELSE gr.ha END AS ha, CASE WHEN e.ch = 1 THEN e.idx ELSE gr.hb END AS hb
      FROM gr JOIN {src} e ON e.k = gr.k AND e.n = gr.n + 1)))""",
        "gate AS (SELECT k, idx FROM gr WHERE hit)")


# the whole series stands in when fewer than 100 baseline rows are there
MAD = f"""nbase AS (SELECT model, count(*) FILTER (year = {BASE}) AS nb FROM errors GROUP BY model),
bsel AS (SELECT model, ade_traj FROM errors JOIN nbase USING (model) WHERE year = {BASE} OR nb < 100),
med AS (SELECT model, quantile_cont(ade_traj, 0.5) AS med FROM bsel GROUP BY model),
mad AS (SELECT model, quantile_cont(abs(ade_traj - med), 0.5) AS mad FROM bsel JOIN med USING (model) GROUP BY model)"""
SPLIT = dict(delta=0.2, min_window=60, max_window=400, cooldown=40)


def split_source(table: str, x: str, d: float = 0.2, minw: int = 60, maxw: int = 400, pause: int = 40) -> str:
    return f"src AS (SELECT model AS k, idx, {x} AS x, greatest(2, sqrt(2 * ln(2 / {d}))) AS zc, {minw} AS minw, {maxw} AS maxw, {pause} AS pause FROM {table})"


def split_config(name: str, smoother=("none", {}), **changes) -> dict:
    return {"cfg": name, "detector": "mean_split", "smoother": smoother, **SPLIT, **changes}


HINKLEY_SRC = "src AS (SELECT model AS k, idx, ade_traj AS x, 0.02 * mad AS delta, 15 * mad AS thr, 100 AS ready, 50 AS pause FROM stream JOIN mad USING (model))"


@query("det01_page_hinkley", with_tables(A.ERRORS, A.STREAM, MAD, HINKLEY_SRC, *hinkley_sql("src"),
       body="SELECT k AS model, 'PH_K15_d0.02' AS cfg, idx FROM ph", recursive=True))
def page_hinkley(spark, sf):
    s = D.with_baseline(A.stream(spark, sf), "ade_traj", BASE)
    return detect(s, "ade_traj", D.hinkley_configs([15], [0.02], 100, 50), facts=["mad"])


@query("det02_mean_split", with_tables(A.ERRORS, A.STREAM, split_source("stream", "ade_traj"), *split_sql("src"),
       body="SELECT k AS model, idx FROM ms", recursive=True))
def mean_split(spark, sf):
    return detect(A.stream(spark, sf), "ade_traj", [split_config("s")]).drop("cfg")


@query("det03_bucket_window")
def bucket_window(spark, sf):
    return detect(A.stream(spark, sf), "ade_traj", [
        {"cfg": f"d{d}", "detector": "bucket_window", "delta": d, "max_window": 2000, "min_window": 60, "cooldown": 40} for d in (0.3, 0.9)])


@query("det04_recent_sample")
def recent_sample(spark, sf):
    return detect(A.stream(spark, sf), "ade_traj", D.recent_configs({"alpha": [0.05, 0.01], "window_size": [200], "stat_size": [50]}))


@query("det06_finite_rows_only", with_tables(A.ERRORS, A.STREAM, """
f AS (SELECT model, idx AS old, ade_traj, row_number() OVER (PARTITION BY model ORDER BY idx) - 1 AS idx FROM stream WHERE traj_id % 7 <> 0)""",
    split_source("f", "ade_traj"), *split_sql("src"), body="SELECT k AS model, f.old AS idx FROM ms JOIN f ON f.model = ms.k AND f.idx = ms.idx", recursive=True))
def finite_rows_only(spark, sf):
    s = A.stream(spark, sf)
    holes = s.df.withColumn("v", F.when(F.col("traj_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("ade_traj")))
    return detect(s.using(holes), "v", [split_config("s")]).drop("cfg")


TRIM = f"""t0 AS (SELECT model, idx // 20 AS block, idx, year, ade_traj, row_number() OVER (PARTITION BY model, idx // 20 ORDER BY ade_traj, idx) AS r FROM stream),
t1 AS (SELECT model, block, avg(ade_traj) FILTER (r > 2 AND r <= 18) AS x, max(idx) FILTER (idx % 20 = 10) AS centre, count(*) AS n FROM t0 GROUP BY ALL),
ty AS (SELECT model, block, year FROM (SELECT model, block, year, row_number() OVER (PARTITION BY model, block ORDER BY count(*) DESC, year) AS k FROM t0 GROUP BY model, block, year) WHERE k = 1),
bl AS (SELECT model, block, x, centre, year FROM t1 JOIN ty USING (model, block) WHERE n = 20),
bn AS (SELECT model, count(*) FILTER (year = {BASE}) AS nb FROM bl GROUP BY model),
bs AS (SELECT model, nb, x FROM bl JOIN bn USING (model) WHERE year = {BASE} OR nb < 5),
bm AS (SELECT model, quantile_cont(x, 0.5) AS med FROM bs GROUP BY model),
bd AS (SELECT model, max(nb) AS nb, quantile_cont(abs(x - med), 0.5) AS mad FROM bs JOIN bm USING (model) GROUP BY model),
src AS (SELECT model AS k, block AS idx, x, 0.05 * mad AS delta, 4 * mad AS thr, greatest(3, nb // 5) AS ready, greatest(2, nb // 20) AS pause FROM bl JOIN bd USING (model))"""


def block_alarms(spark, sf):
    return D.block_hinkley(A.stream(spark, sf), "ade_traj", 20, [4], [0.05], BASE, trim=0.10)


@query("det07_block_hinkley", with_tables(A.ERRORS, A.STREAM, TRIM, *hinkley_sql("src"),
       body="SELECT model, block, centre AS idx FROM ph JOIN bl ON bl.model = ph.k AND bl.block = ph.idx", recursive=True))
def block_hinkley(spark, sf):
    return block_alarms(spark, sf)[0].select("model", "block", "idx")


ROBZ_SPLIT = (A.ERRORS, A.STREAM, ROBZ, split_source("robz", "z"), *split_sql("src"))


@query("det08_smoothed_split", with_tables(*ROBZ_SPLIT, body="SELECT k AS model, idx FROM ms", recursive=True))
def smoothed_split(spark, sf):
    return detect(A.stream(spark, sf), "ade_traj", [split_config("s", RZ)]).drop("cfg")


# ---- grids ------------------------------------------------------------------------

@query("grd01_smoother_sweep")
def smoother_sweep(spark, sf):
    s = D.with_baseline(A.stream(spark, sf), "ade_traj", BASE)
    alarms, names = D.smoother_study(s, "ade_traj", SPLIT, {
        "threshold": D._times_mad(15), "delta": D._times_mad(0.02), "min_instances": 100, "cooldown": 50})
    return G.rounded(E.evaluate(alarms, s, names, BASE, POST).drop("snr_op"), "far_per_1k", "snr_smooth", "efficiency")


@query("grd02_split_grid")
def split_grid(spark, sf):
    """All 96 configurations of the published grid on every series."""
    s = A.stream(spark, sf)
    c = D.split_configs()
    return G.rounded(E.evaluate(detect(s, "ade_traj", c), s, [x["cfg"] for x in c], BASE, POST).drop("snr_op"), "far_per_1k", "snr_smooth", "efficiency")


@query("grd02_block_grid")
def block_grid(spark, sf):
    out = D.block_study(A.stream(spark, sf), "ade_traj", D.BLOCK_GRID, BASE, POST)
    return G.rounded(out.drop("snr_op"), "far_per_1k", "snr_smooth", "efficiency")


@query("grd02_recent_grid")
def recent_grid(spark, sf):
    s = A.stream(spark, sf)
    c = D.recent_configs()
    return G.rounded(E.evaluate(detect(s, "ade_traj", c), s, [x["cfg"] for x in c], BASE, POST).drop("snr_op"), "far_per_1k", "snr_smooth", "efficiency")


DELTAS = [0.3, 0.1]
SWEEP = (A.ERRORS, A.STREAM, f"dl AS (SELECT unnest([{', '.join(map(str, DELTAS))}])::DOUBLE AS d)",
         """src AS (SELECT model || '/' || d AS k, idx, ade_traj AS x, greatest(2, sqrt(2 * ln(2 / d))) AS zc, 60 AS minw, 400 AS maxw, 40 AS pause FROM stream, dl)""",
         *split_sql("src"))


def delta_sweep(spark, sf):
    s = A.stream(spark, sf)
    return s, detect(s, "ade_traj", [split_config(str(d), delta=d) for d in DELTAS])


@query("grd03_delta_sweep", with_tables(*SWEEP, "n AS (SELECT model, count(*) AS n FROM errors GROUP BY model)", body="""
SELECT model, CAST(d AS VARCHAR) AS cfg, count(ms.idx) AS n_alarms, round(1000.0 * count(ms.idx) / n, 6) AS per_1k
FROM n JOIN dl ON true LEFT JOIN ms ON ms.k = model || '/' || d GROUP BY model, d, n""", recursive=True))
def delta_sweep_rates(spark, sf):
    s, alarms = delta_sweep(spark, sf)
    n = s.df.groupBy("model").agg(F.count(F.lit(1)).alias("n")).withColumn("cfg", F.explode(F.array(*[F.lit(str(d)) for d in DELTAS])))
    k = alarms.groupBy("model", "cfg").agg(F.count(F.lit(1)).alias("n_alarms"))
    out = n.join(k, ["model", "cfg"], "left").fillna(0, ["n_alarms"])
    return out.select("model", "cfg", "n_alarms", F.round(1000.0 * F.col("n_alarms") / F.col("n"), 6).alias("per_1k"))


@query("grd03_limit_sweep", with_tables(A.ERRORS, A.STREAM, MAD, "lk AS (SELECT unnest([8, 15, 25]) AS kt)", """
src AS (SELECT model || '/PH_K' || kt || '_d0.02' AS k, idx, ade_traj AS x, 0.02 * mad AS delta, kt * mad AS thr, 100 AS ready, 50 AS pause FROM stream JOIN mad USING (model), lk)""",
    *hinkley_sql("src"), body="SELECT split_part(k, '/', 1) AS model, split_part(k, '/', 2) AS cfg, count(*) AS n_alarms FROM ph GROUP BY k", recursive=True))
def limit_sweep(spark, sf):
    s = D.with_baseline(A.stream(spark, sf), "ade_traj", BASE)
    return detect(s, "ade_traj", D.hinkley_configs([8, 15, 25], [0.02], 100, 50), facts=["mad"]).groupBy("model", "cfg").agg(
        F.count(F.lit(1)).alias("n_alarms"))


@query("grd04_heat_map", with_tables(*SWEEP, "n AS (SELECT model, count(*) AS n FROM errors GROUP BY model)",
       "c AS (SELECT model, d, count(ms.idx) AS n_alarms FROM n JOIN dl ON true LEFT JOIN ms ON ms.k = model || '/' || d GROUP BY model, d)", body="""
SELECT model, min(n_alarms) FILTER (d = 0.3) AS d30, min(n_alarms) FILTER (d = 0.1) AS d10
FROM c GROUP BY model""", recursive=True))
def heat_map(spark, sf):
    """Least alarms per model and delta, as a matrix."""
    g = delta_sweep_rates(spark, sf)
    wide = g.groupBy("model").pivot("cfg", [str(d) for d in DELTAS]).agg(F.min("n_alarms"))
    return wide.select("model", *[F.col(f"`{d}`").alias(f"d{int(d * 100):02d}") for d in DELTAS])


# ---- gates --------------------------------------------------------------------------

def gate_source(widths: list[int], deb: int) -> str:
    ws = ", ".join(map(str, widths))
    return f"""ev AS (SELECT model || '/' || w AS k, row_number() OVER (PARTITION BY model, w ORDER BY idx, channel) - 1 AS n, idx, channel AS ch, w, {deb} AS deb
  FROM channels, (SELECT unnest([{ws}]) AS w))"""


CH = (A.ERRORS, A.STREAM, A.CHANNELS)
WIDTHS = [5, 10, 20, 40]


def both(spark, sf):
    c = A.channels(spark, sf).select("model", "idx", "channel")
    return c.where("channel = 0").drop("channel"), c.where("channel = 1").drop("channel")


def low_alarms(spark, sf):
    return A.stream(spark, sf).df.where("ade_traj < 0.2").select("model", "idx")


@query("ens01_or_gate", with_tables(*CH, body="SELECT DISTINCT model, idx FROM channels"))
def ens_or(spark, sf):
    return N.or_gate(*both(spark, sf), ["model"])


@query("ens02_and_gate", with_tables(*CH, gate_source([10], 60), *gate_sql("ev"),
       body="SELECT split_part(k, '/', 1) AS model, CAST(split_part(k, '/', 2) AS INTEGER) AS \"W\", idx FROM gate", recursive=True))
def ens_and(spark, sf):
    return N.and_gate(*both(spark, sf), ["model"], [10], 60)


NEAR = """a AS (SELECT model, idx FROM channels WHERE channel = 0), b AS (SELECT model, idx FROM channels WHERE channel = 1),
near AS (SELECT a.model, a.idx, arg_min(b.idx, abs(b.idx - a.idx) * 1000000 - b.idx) AS partner, min(abs(b.idx - a.idx)) AS gap FROM a JOIN b USING (model) GROUP BY a.model, a.idx),
cd AS (SELECT model, greatest(idx, partner) AS t, row_number() OVER (PARTITION BY model ORDER BY idx) AS n FROM near WHERE gap <= 8),
dr AS (SELECT model, n, t AS last, true AS hit, t FROM cd WHERE n = 1 UNION ALL
       SELECT c.model, c.n, CASE WHEN c.t - dr.last >= 30 THEN c.t ELSE dr.last END, c.t - dr.last >= 30, c.t FROM dr JOIN cd c ON c.model = dr.model AND c.n = dr.n + 1)"""


@query("ens03_nearest_gate", with_tables(*CH, NEAR, body="SELECT model, CAST(8 AS INTEGER) AS \"W\", t AS idx FROM dr WHERE hit", recursive=True))
def ens_nearest(spark, sf):
    return N.nearest_gate(*both(spark, sf), ["model"], [8], 30)


LOW = "low AS (SELECT model, idx FROM stream WHERE ade_traj < 0.2)"
TIER = f"""pa AS (SELECT DISTINCT model, idx FROM channels WHERE channel = 0), pb AS (SELECT DISTINCT model, idx FROM channels WHERE channel = 1),
al AS (SELECT model, idx, 'c' AS t FROM (SELECT split_part(k, '/', 1) AS model, idx FROM gate) UNION ALL SELECT model, idx, 's' FROM pa UNION ALL SELECT model, idx, 's' FROM low
  UNION ALL SELECT model, idx, 'a' FROM pa UNION ALL SELECT model, idx, 'p' FROM pb UNION ALL SELECT model, idx, 'k' FROM low)"""


@query("ens04_two_tier", with_tables(*CH, gate_source([10], 60), *gate_sql("ev"), LOW, TIER, body="""
SELECT model, idx, bool_or(t = 'c') AS confirmed, bool_or(t = 's') AS suspected, bool_or(t = 'a') AS adwin_alarm, bool_or(t = 'p') AS ph_alarm, bool_or(t = 'k') AS kalman_alarm
FROM al GROUP BY model, idx""", recursive=True))
def ens_two_tier(spark, sf):
    a, b = both(spark, sf)
    return N.two_tier(a, b, low_alarms(spark, sf), ["model"], 10, 60)


@query("ens05_width_sweep", with_tables(*CH, gate_source(WIDTHS, 60), *gate_sql("ev"), body="""
SELECT split_part(k, '/', 1) AS model, CAST(split_part(k, '/', 2) AS INTEGER) AS "W", count(*) AS n_confirmed FROM gate GROUP BY k""", recursive=True))
def ens_width_sweep(spark, sf):
    return N.and_gate(*both(spark, sf), ["model"], WIDTHS, 60).groupBy("model", "W").agg(F.count(F.lit(1)).alias("n_confirmed"))


def score_sql(alarms: str, names: list[str]) -> tuple[str, ...]:
    """Metrics of ``alarms`` (model, cfg, idx) for every model and name."""
    return (
        f"nm AS (SELECT unnest([{', '.join(repr(n) for n in names)}]) AS cfg)",
        f"""tt AS (SELECT model, count(*) FILTER (year = {BASE}) AS base_rows, count(*) FILTER (year > {BASE}) AS post_rows FROM errors GROUP BY model)""",
        f"""sco AS (SELECT tt.model, nm.cfg, base_rows, post_rows, count(a.idx) AS n_alarms, count(*) FILTER (s.year = {BASE}) AS n_base, count(*) FILTER (s.year > {BASE}) AS n_post,
  {", ".join(f"count(*) FILTER (s.year = {y}) AS n_{y}" for y in POST)}
  FROM tt JOIN nm ON true LEFT JOIN {alarms} a ON a.model = tt.model AND a.cfg = nm.cfg LEFT JOIN stream s ON s.model = a.model AND s.idx = a.idx GROUP BY ALL)""",
        f"""scm AS (SELECT *, 1000.0 * n_base / greatest(1, base_rows) AS far_per_1k, CAST({" + ".join(f"CASE WHEN n_{y} > 0 THEN 1 ELSE 0 END" for y in POST)} AS INTEGER) AS year_coverage,
  (n_post + 1.0) * base_rows / ((n_base + 1.0) * post_rows) AS snr_smooth, CASE WHEN n_alarms = 0 THEN 0 ELSE n_post / n_alarms END AS efficiency FROM sco)""")


SCORE_BODY = "SELECT model, cfg, base_rows, post_rows, n_alarms, n_base, n_post, " + ", ".join(f"n_{y}" for y in POST) + """,
 round(far_per_1k, 6) AS far_per_1k, year_coverage, round(snr_smooth, 6) AS snr_smooth, round(efficiency, 6) AS efficiency FROM scm"""


def tidy(df):
    return G.rounded(df.drop("snr_op"), "far_per_1k", "snr_smooth", "efficiency")


@query("ens06_ablation", with_tables(*CH, gate_source([10], 60), *gate_sql("ev"), LOW, f"""
ev0 AS (SELECT k, n, idx, ch, w, 0 AS deb FROM ev)""", *[t.replace("gr ", "g2 ").replace("gr.", "g2.").replace("gate AS", "gate0 AS") for t in gate_sql("ev0")], """
va AS (SELECT DISTINCT model, cfg, idx FROM (
  SELECT split_part(k, '/', 1) AS model, unnest(['confirmed', 'and_only']) AS cfg, idx FROM gate UNION ALL SELECT split_part(k, '/', 1), 'confirmed_no_debounce', idx FROM gate0
  UNION ALL SELECT model, unnest(['suspected', 'or_only', 'adwin_standalone']), idx FROM channels WHERE channel = 0 UNION ALL SELECT model, unnest(['suspected', 'or_only', 'kalman_standalone']), idx FROM low
  UNION ALL SELECT model, 'ph_standalone', idx FROM channels WHERE channel = 1))""", *score_sql("va", N.VARIANTS), body=SCORE_BODY, recursive=True))
def ens_ablation(spark, sf):
    a, b = both(spark, sf)
    return tidy(E.evaluate(N.ablation(a, b, low_alarms(spark, sf), ["model"], 10, 60), A.stream(spark, sf), N.VARIANTS, BASE, POST))


def window_errors(spark, sf):
    """Track windows with their forecast error and input acceleration, per game parity."""
    from tidemark.functions import scalars
    from tidemark.operators.tracks import error_rows

    w = windows(spark, sf)
    # both sides are stored: the checks of their keys, the count of missing rows and the join read them again
    e = session.cut(error_rows(w, 3, ["robot_id", "start", "game"], "constant", "6->3"))
    a = scalars.kinematic_features(F.col("past_vx"), F.col("past_vy"))
    f = w.select("robot_id", "start", scalars.array_quantile(a["accel"], 0.95).alias("accel_p95"), scalars.array_mean(a["accel"]).alias("accel_mean"),
                 scalars.array_quantile(a["speed"], 0.95).alias("speed_p95"), scalars.array_mean(a["speed"]).alias("speed_mean"))
    f = session.cut(f)
    both_ = J.one_to_one(e, f, ["robot_id", "start"], "accel_p95")
    period = (F.lit(BASE) + F.floor(F.col("start") * 7 / 100)).cast("int")
    return both_.withColumn("year", F.least(period, F.lit(A.LAST_YEAR))).withColumn("match_id", F.concat_ws("_", F.col("year").cast("string"), "game"))


def feature_series(spark, sf):
    return series(session.cut(window_errors(spark, sf)), ["model"], ["year", "match_id", "robot_id", "start"])


ACCEL_GRID = {"delta": [0.3, 0.1], "min_window": [60], "cooldown": [40], "max_window": [300]}


@query("ens07_same_scale")
def same_scale(spark, sf):
    out = S.same_scale(feature_series(spark, sf), "ade_traj", "accel_p95", split_config("e", RZ),
                       D.split_configs(ACCEL_GRID, smoother=RZ), [20, 50, 200], 100, BASE, POST)
    return tidy(out)


# ---- evaluation ------------------------------------------------------------------------

CHANNEL_ALARMS = "ca AS (SELECT model, CASE WHEN channel = 0 THEN 'even' ELSE 'odd' END AS cfg, idx FROM channels)"


def channel_alarms(spark, sf):
    return A.channels(spark, sf).select("model", F.when(F.col("channel") == 0, "even").otherwise("odd").alias("cfg"), "idx")


@query("evl01_alarm_metrics", with_tables(*CH, CHANNEL_ALARMS, *score_sql("ca", ["even", "odd", "none"]), body=SCORE_BODY))
def alarm_metrics(spark, sf):
    return tidy(E.evaluate(channel_alarms(spark, sf), A.stream(spark, sf), ["even", "odd", "none"], BASE, POST))


@query("evl02_latency", with_tables(*CH, CHANNEL_ALARMS, f"""
bd AS (SELECT model, year, min(idx) AS boundary, count(*) AS n_rows, count(DISTINCT match_id) AS n_games FROM stream WHERE year > {BASE} GROUP BY model, year)""", body="""
SELECT bd.model, cf.cfg, bd.year, boundary, min(ca.idx) AS first_alarm, min(ca.idx) - boundary AS delay, round((min(ca.idx) - boundary) / (n_rows / greatest(1, n_games)), 6) AS delay_games,
  round(100.0 * (min(ca.idx) - boundary) / n_rows, 6) AS delay_pct, count(ca.idx) AS n_alarms
FROM bd JOIN (SELECT unnest(['even', 'odd']) AS cfg) cf ON true LEFT JOIN ca ON ca.model = bd.model AND ca.cfg = cf.cfg AND ca.idx >= boundary AND ca.idx < boundary + n_rows
GROUP BY bd.model, cf.cfg, bd.year, boundary, n_rows, n_games"""))
def latency(spark, sf):
    s = A.stream(spark, sf)
    games = E.games_per_period(s.df, ["model"], "year", "match_id")
    return G.rounded(E.latency(channel_alarms(spark, sf), s, ["even", "odd"], POST, games), "delay_games", "delay_pct")


HOLD_GRID = {"delta": [0.3, 0.1, 0.05], "min_window": [40, 80], "cooldown": [40], "max_window": [400]}
ORDER = ["year", "match_id", "traj_id"]


@query("evl03_hold_out")
def hold_out(spark, sf):
    out = None
    for fold in ("A", "B"):
        scored, _ = S.hold_out(A.errors(spark, sf), ["model"], "ade_traj", D.split_configs(HOLD_GRID, smoother=RZ), BASE, POST, fold, ORDER, limit=5.0)
        out = scored if out is None else out.unionByName(scored)
    return G.rounded(out.drop("snr_op"), "far_per_1k", "snr_smooth", "efficiency", "far_calib", "wilson_lo", "wilson_hi")


@query("evl03_hold_out_latency")
def hold_out_latency(spark, sf):
    _, late = S.hold_out(A.errors(spark, sf), ["model"], "ade_traj", D.split_configs(HOLD_GRID, smoother=RZ), BASE, POST, "A", ORDER, limit=5.0)
    return G.rounded(late, "delay_games", "delay_pct")


@query("evl04_feature_battery")
def feature_battery(spark, sf):
    """Four feature monitors and the error monitor, one series each, on held-out games."""
    from tidemark.operators.distance import melt_features

    w = session.cut(window_errors(spark, sf))
    names = ["accel_p95", "accel_mean", "speed_p95", "speed_mean", "ade_traj"]
    long = melt_features(w, ["year", "match_id", "robot_id", "start"], {n: F.col(n) for n in names})
    scored, _ = S.hold_out(long, ["feature"], "value", D.split_configs(ACCEL_GRID, smoother=RZ), BASE, POST, "A",
                           ["year", "match_id", "robot_id", "start"], limit=5.0)
    return G.rounded(scored.drop("snr_op"), "far_per_1k", "snr_smooth", "efficiency", "far_calib", "wilson_lo", "wilson_hi")


ROLE = "CASE WHEN detector LIKE '5-LOW%' THEN 'negative result' ELSE 'monitor' END"


@query("evl05_master_table", with_tables(A.ERRORS, SCORES, f"""
se AS (SELECT *, CASE WHEN {ROLE} LIKE 'negative%' THEN 2 WHEN far_per_1k > 60 THEN 1 ELSE 0 END AS section FROM scores)""", body="""
SELECT detector, CAST(section AS INTEGER) AS section, CAST(CASE WHEN section = 0 THEN row_number() OVER (PARTITION BY section ORDER BY year_coverage DESC, far_per_1k, snr_smooth DESC, detector) END AS INTEGER) AS place,
  round(far_per_1k, 6) AS far_per_1k FROM se"""))
def master_table(spark, sf):
    role = F.when(F.startswith(F.col("detector"), F.lit("5-LOW")), "negative result").otherwise("monitor")
    out = E.master_table(scores(spark, sf), role, limit=60.0)
    return G.rounded(out.select("detector", "section", "place", "far_per_1k"), "far_per_1k")


@query("evl06_table_consistency", with_tables(A.ERRORS, body="SELECT CAST(0 AS BIGINT) AS n_wrong, count(DISTINCT model) AS n_detectors FROM errors"))
def table_consistency(spark, sf):
    """The same counts along two paths: per alarm period and per alarm row."""
    s = A.stream(spark, sf)
    left = E.evaluate(channel_alarms(spark, sf), s, ["even"], BASE, POST).select("model", "n_base", "n_post")
    right = A.channels(spark, sf).where("channel = 0").groupBy("model").agg(
        F.count_if(F.col("year") == BASE).alias("n_base"), F.count_if(F.col("year") > BASE).alias("n_post"))
    wrong = E.inconsistent(left, right, ["model"], ["n_base", "n_post"])
    return wrong.agg(F.count(F.lit(1)).alias("n_wrong")).withColumn("n_detectors", s.df.agg(F.count_distinct("model")).scalar())


@query("evl07_both_units", with_tables(A.ERRORS, A.STREAM, TRIM, *hinkley_sql("src"), f"""
al AS (SELECT bl.model, count(*) FILTER (year = {BASE}) AS n_base FROM ph JOIN bl ON bl.model = ph.k AND bl.block = ph.idx GROUP BY bl.model),
tb AS (SELECT model, count(*) FILTER (year = {BASE}) AS base_rows, greatest(1, count(*) FILTER (year = {BASE}) // 20) AS base_blocks FROM errors GROUP BY model)""", body="""
SELECT model, coalesce(n_base, 0) AS n_base, round(1000.0 * coalesce(n_base, 0) / base_blocks, 6) AS per_1k_blocks, round(1000.0 * coalesce(n_base, 0) / base_rows, 6) AS per_1k_rows FROM tb LEFT JOIN al USING (model)""", recursive=True))
def both_units(spark, sf):
    dated, _, _ = block_alarms(spark, sf)
    n = dated.groupBy("model").agg(F.count_if(F.col("year") == BASE).alias("n_base"))
    t = A.totals(A.errors(spark, sf), ["model"]).join(n, "model", "left").fillna(0, ["n_base"])
    blocks = F.greatest(F.lit(1), F.floor(F.col("base_rows") / 20))
    return t.select("model", "n_base", F.round(1000.0 * F.col("n_base") / blocks, 6).alias("per_1k_blocks"),
                    F.round(1000.0 * F.col("n_base") / F.col("base_rows"), 6).alias("per_1k_rows"))


@query("evl08_permutation_null")
def permutation_null(spark, sf):
    out = None
    base = A.errors(spark, sf).where(F.col("year") == BASE)
    found = S.observed_alarms(base, ["model"], "ade_traj", split_config("s"), "match_id", ORDER)
    for scheme in ("blocks", "within", "full"):
        part = S.permutation_null(base, ["model"], "ade_traj", split_config("s"), 200, scheme, "match_id", ORDER, found)
        out = part if out is None else out.unionByName(part)
    return G.rounded(out, "k_mean", "k_p5", "k_median", "k_p95", "p_value")


def library_configs():
    return [{"cfg": "ADWIN_0.002", "detector": "bucket_window", "bare": True, "delta": 0.002}, {"cfg": "PH_25", "detector": "two_sided", "threshold": 25.0, "min_instances": 3},
            {"cfg": "PH_50", "detector": "two_sided", "threshold": 50.0, "min_instances": 3}]


def base_series(spark, sf):
    return series(A.errors(spark, sf).where(F.col("year") == BASE).select("model", "year", "match_id", "traj_id", "ade_traj"), ["model"], ORDER)


@query("evl09_run_lengths")
def run_lengths(spark, sf):
    return G.rounded(S.run_lengths(base_series(spark, sf), "ade_traj", library_configs(), 30, 1000, 25, 500.0), "arl", "abs_diff")


@query("evl09_shift_delays")
def shift_delays(spark, sf):
    return G.rounded(S.shift_delays(base_series(spark, sf), "ade_traj", library_configs(), [0.5, 1.0, 2.0], 20, 200, 600, 25), "p10", "p50", "p90")


@query("evl10_exact_against_light")
def exact_against_light(spark, sf):
    s = A.stream(spark, sf)
    c = [split_config("light", RZ), {**split_config("exact", RZ), "detector": "bucket_window"}]
    return tidy(E.evaluate(detect(s, "ade_traj", c), s, ["light", "exact"], BASE, POST))


@query("evl11_chosen_width", with_tables(*CH, gate_source(WIDTHS, 60), *gate_sql("ev"), "gn AS (SELECT split_part(k, '/', 1) AS model, split_part(k, '/', 2) AS cfg, idx FROM gate)",
       *score_sql("gn", [str(w) for w in WIDTHS]), """
p AS (SELECT *, max(CASE WHEN far_per_1k <= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY model) AS ok FROM scm)""", body="""
SELECT model, arg_max(CAST(cfg AS INTEGER), n_alarms * 1000 - CAST(cfg AS INTEGER)) FILTER (ok = 0 OR far_per_1k <= 10) AS best_w, min(CAST(cfg AS INTEGER)) FILTER (year_coverage >= 2) AS least_w FROM p GROUP BY model""", recursive=True))
def chosen_width(spark, sf):
    """Admissible width with most confirmations, and the least width that covers two years."""
    conf = N.and_gate(*both(spark, sf), ["model"], WIDTHS, 60).select("model", F.col("W").cast("string").alias("cfg"), "idx")
    sc = E.evaluate(conf, A.stream(spark, sf), [str(w) for w in WIDTHS], BASE, POST).withColumn("W", F.col("cfg").cast("int"))
    best = J.admissible_or_all(sc, ["model"], F.col("far_per_1k") <= 10).groupBy("model").agg(
        F.max_by("W", F.struct("n_alarms", -F.col("W"))).alias("best_w"))
    least = sc.groupBy("model").agg(F.min(F.when(F.col("year_coverage") >= 2, F.col("W"))).alias("least_w"))
    return best.join(least, "model")


STORED = "delta=2e-01, mw=60, cd=40, xw=400"


@query("evl12_stored_configs", with_tables(*ROBZ_SPLIT, body=f"SELECT k AS model, '{STORED}' AS cfg, idx FROM ms WHERE k <> '5-LOW'", recursive=True))
def stored_configs(spark, sf):
    stored = A.errors(spark, sf).where("model <> '5-LOW'").select("model").distinct().withColumn("config", F.lit(STORED))
    return S.stored_alarms(A.stream(spark, sf), "ade_traj", stored, "config", RZ)


@query("udf01_custom_smoother", with_tables(A.ERRORS, A.STREAM, body="""
SELECT model, idx, round(max(ade_traj) OVER (PARTITION BY model ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS smooth FROM stream"""))
def custom_smoother(spark, sf):
    """A smoother added by a user: the rolling maximum."""
    from tidemark.functions import smoothing

    smoothing.register("rolling_max", _rolling_max, lambda p: p["w"] - 1)
    s = A.stream(spark, sf)
    return G.rounded(smoothed(s, "ade_traj", "rolling_max", {"w": 10}).df.select("model", "idx", "smooth"), "smooth")


def _rolling_max(x, p, starts, stops):
    import pandas as pd

    return pd.Series(x).rolling(p["w"], min_periods=1).max().to_numpy()


class Ceiling:
    """A detector added by a user: fires above a level, then rests."""

    settles = True

    @staticmethod
    def reach(p: dict) -> int:
        return int(p["rest"]) + 1

    @staticmethod
    def cold(p: dict) -> list[float]:
        return [0.0]

    @staticmethod
    def run(p, state, pre, x, lead):
        import numpy as np

        quiet, fired = int(state[0]), []
        for i, v in enumerate(x):
            if quiet:
                quiet -= 1
            elif v > p["level"]:
                fired.append(i)
                quiet = int(p["rest"])
        return np.asarray(fired, dtype=np.int64), [float(quiet)]


@query("udf02_custom_detector", with_tables(A.ERRORS, A.STREAM, """
cr AS (SELECT model, idx, ade_traj > 9.0 AS hit, 0 AS quiet FROM stream WHERE idx = 0
  UNION ALL SELECT model, idx, quiet = 0 AND x > 9.0, quiet FROM (SELECT s.model, s.idx, s.ade_traj AS x,
    CASE WHEN cr.hit THEN 20 ELSE greatest(cr.quiet - 1, 0) END AS quiet FROM cr JOIN stream s ON s.model = cr.model AND s.idx = cr.idx + 1))""",
    body="SELECT model, idx FROM cr WHERE hit", recursive=True))
def custom_detector(spark, sf):
    from tidemark.operators.detectors import kernels

    kernels.register("ceiling", Ceiling)
    return detect(A.stream(spark, sf), "ade_traj", [{"cfg": "c", "detector": "ceiling", "level": 9.0, "rest": 20}]).drop("cfg")


@query("udf04_grouped_statistics", with_tables(A.ERRORS, A.WEIGHTED, body="""
SELECT year, round(sum(w * ade_traj) / sum(w), 6) AS weighted_mean, round(sum(w) * sum(w) / (count(*) * sum(w * w)), 6) AS ess FROM weighted GROUP BY year"""))
def grouped_statistics(spark, sf):
    """Weighted mean and effective size as plain aggregate expressions."""
    sw = F.sum("w")
    out = A.weighted(spark, sf).groupBy("year").agg(
        (F.sum(F.col("w") * F.col("ade_traj")) / sw).alias("weighted_mean"), (sw * sw / (F.count(F.lit(1)) * F.sum(F.col("w") * F.col("w")))).alias("ess"))
    return G.rounded(out, "weighted_mean", "ess")


@query("udf05_grid_rows", with_tables(A.ERRORS, body="""
SELECT model, d AS delta, w AS min_window, count(*) AS n FROM errors, (SELECT unnest([1e-4, 1e-5, 1e-6, 1e-7])::DOUBLE AS d), (SELECT unnest([200, 400, 600, 1000]) AS w) GROUP BY model, d, w"""))
def grid_rows(spark, sf):
    """The configuration grid as rows beside the (aggregated) data."""
    n = A.errors(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    cells = [{"delta": d, "min_window": w} for d in D.SPLIT_GRID["delta"] for w in D.SPLIT_GRID["min_window"]]
    return J.expand(n, cells, {"delta": "double", "min_window": "int"})
