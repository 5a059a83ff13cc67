"""Streams fed in several files and triggers, with late rows, give the batch results of the rows the watermark has passed."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import gates, ordered, tracks
from tidemark.operators.detectors.linked import detect
from tidemark.streaming import online

SCHEMA = "k string, o bigint, v double, ts timestamp"
START = pd.Timestamp("2024-01-01")
DELAY, LATE = "300 seconds", 300


def write_files(spark, pdf, path, files, late, seed=0):
    """Rows in files by a time of arrival that is up to ``late`` seconds after their own; rows of a file are shuffled."""
    arrival = pdf["ts"] + pd.to_timedelta(np.random.default_rng(seed).uniform(0, late, len(pdf)), unit="s")
    for i, rows in enumerate(np.array_split(np.argsort(arrival.to_numpy(), kind="stable"), files)):
        spark.createDataFrame(pdf.iloc[rows].sample(frac=1.0, random_state=i)).coalesce(1).write.mode("append").parquet(path)


def settled(pdf):
    """Rows that the last watermark has passed."""
    return pdf[pdf["ts"] < pdf["ts"].max().floor("ms") - pd.Timedelta(DELAY)]


@pytest.fixture(scope="module", params=[(1, 0), (4, 250)], ids=["one file", "late rows"])
def feed(spark, tmp_path_factory, request):
    """The same rows in one file, and in files in which rows come late by as much as the delay allows."""
    rng = np.random.default_rng(0)
    n = 1200
    x = rng.normal(size=n)
    x[n // 2:] += 1.0
    x[::97] = np.nan
    seconds = np.sort(rng.integers(0, 4000, n))  # with ties
    pdf = pd.DataFrame({"k": np.where(np.arange(n) % 3 == 0, "a", "b"), "o": rng.permutation(n), "v": x, "ts": START + pd.to_timedelta(seconds, unit="s")})
    path = str(tmp_path_factory.mktemp("feed"))
    write_files(spark, pdf, path, *request.param)
    return pdf, path


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)


CONFIGS = [
    {"cfg": "s", "detector": "mean_split", "delta": 0.05, "max_window": 200, "min_window": 40, "cooldown": 20},
    {"cfg": "h", "detector": "page_hinkley", "delta": 0.05, "threshold": 8.0, "min_instances": 40, "cooldown": 20, "warm": 50},
    {"cfg": "r", "detector": "recent_sample", "alpha": 0.05, "window_size": 100, "stat_size": 50},
    {"cfg": "b", "detector": "bucket_window", "delta": 0.3, "max_window": 400, "min_window": 40, "cooldown": 20},
]


@pytest.mark.parametrize("config", CONFIGS, ids=lambda c: c["detector"])
def test_online_detectors_equal_batch(spark, feed, tmp_path, config):
    pdf, path = feed
    got = online.run_to_table(online.online_alarms(stream(spark, path), "k", "ts", "o", "v", config, DELAY), str(tmp_path / "o"), str(tmp_path / "c"))
    finite = settled(pdf).dropna(subset=["v"])
    s = ordered.series(spark.createDataFrame(finite), ["k"], ["ts", "o"])
    want = {(r["k"], r["idx"]) for r in detect(s, "v", [config]).collect()}
    assert {(r["k"], r["idx"]) for r in got.collect()} == want and want
    place = finite.sort_values(["ts", "o"]).groupby("k")["o"].apply(list)
    assert all(place[r["k"]][r["idx"]] == r["at"] for r in got.collect())


@pytest.mark.parametrize("files, late", [(1, 0), (4, 250)])
def test_online_gate_equals_batch(spark, tmp_path, files, late):
    rng = np.random.default_rng(4)
    at = np.sort(rng.choice(5000, 200, False)) + 2**54  # positions that a double can't hold
    pdf = pd.DataFrame({"k": "a", "o": at, "v": rng.integers(0, 2, 200).astype(float), "ts": START + pd.to_timedelta(at - 2**54, unit="s")})
    path = str(tmp_path / "in")
    write_files(spark, pdf, path, files, late)
    s = stream(spark, path).withColumn("channel", F.col("v").cast("int"))
    got = online.run_to_table(online.online_gate(s, "k", "ts", "o", "channel", 30, 100, DELAY), str(tmp_path / "o"), str(tmp_path / "c"))
    low = settled(pdf).assign(idx=lambda d: d["o"] - 2**54)
    df = spark.createDataFrame(low[["k", "idx", "v"]])
    want = gates.and_gate(df.where("v = 0"), df.where("v = 1"), ["k"], [30], 100)
    assert sorted(r["at"] - 2**54 for r in got.collect()) == sorted(r["idx"] for r in want.collect())


@pytest.mark.parametrize("files, late", [(1, 0), (4, 250)])
def test_two_streams_equal_the_batch_gate(spark, tmp_path, files, late):
    """Two sources of alarms at whole seconds, which are their positions: pairs within 30, a hit more than 100 after the last."""
    rng = np.random.default_rng(4)
    second = rng.choice(6000, 500, replace=False)
    second[:2] = 6000, 6001  # the ends of the streams
    pdf = pd.DataFrame({"k": np.where(rng.random(500) < 0.6, "a", "b"), "o": second, "v": np.arange(500) % 2 * 1.0, "ts": START + pd.to_timedelta(second, unit="s")})
    sides = []
    for c in (0.0, 1.0):
        write_files(spark, pdf[pdf["v"] == c], str(tmp_path / f"in{c}"), files, late, int(c))
        sides.append(stream(spark, str(tmp_path / f"in{c}")))
    got = online.run_to_table(online.coincidences(*sides, "k", "ts", "o", "30 seconds", "100 seconds", DELAY), str(tmp_path / "o"), str(tmp_path / "c"))
    past = pdf[pdf["ts"] < pdf.groupby("v")["ts"].max().min() - pd.Timedelta(DELAY) - pd.Timedelta("30 seconds")]
    a, b = (spark.createDataFrame(past[past["v"] == c]).select("k", F.col("o").alias("idx")) for c in (0.0, 1.0))
    want = sorted((r["k"], r["idx"]) for r in gates.and_gate(a, b, ["k"], [30], 100).collect())
    assert len(want) > 20 and sorted((r["k"], r["at"]) for r in got.collect()) == want


def test_two_streams_order_equal_times_by_position(spark, tmp_path):
    at = [("k", o, (START + pd.Timedelta(seconds=t)).to_pydatetime()) for o, t in ((4, 10), (9, 50), (6, 50), (20, 9000))]
    partners = [("k", o, (START + pd.Timedelta(seconds=t)).to_pydatetime()) for o, t in ((5, 10), (7, 50), (8, 50), (21, 9000))]
    sides = []
    for name, rows in (("a", at), ("b", [*partners, partners[0], (None, 1, partners[0][2]), ("k", 3, None)])):
        spark.createDataFrame([(k, o, 0.0, t) for k, o, t in rows], SCHEMA).write.parquet(str(tmp_path / name))
        sides.append(stream(spark, str(tmp_path / name)))
    got = online.run_to_table(online.coincidences(*sides, "k", "ts", "o", "30 seconds", "30 seconds", DELAY), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(r["at"] for r in got.collect()) == [5, 7]


def test_blocks_span_triggers(spark, feed, tmp_path):
    pdf, path = feed
    s = stream(spark, path).na.fill(0.0, ["v"])
    got = online.run_to_table(online.count_blocks(s, "k", "ts", "o", "v", 70, DELAY), str(tmp_path / "o"), str(tmp_path / "c")).toPandas()
    for k, part in settled(pdf).fillna({"v": 0.0}).sort_values(["ts", "o"]).groupby("k"):
        v = part["v"].to_numpy()
        whole = len(v) // 70
        mine = got[got["k"] == k].sort_values("block")
        np.testing.assert_allclose(mine["block_mean"], v[:whole * 70].reshape(whole, 70).mean(1))
        assert (mine["closed"].to_numpy() == part["ts"].iloc[69:whole * 70:70].astype("datetime64[us]").astype("int64").to_numpy()).all()


def test_play_segments_equal_a_loop(spark, feed, tmp_path):
    pdf, path = feed
    command = F.when(F.col("o") % 11 == 0, 2).when(F.col("o") % 13 == 0, 0).otherwise(-1)
    s = stream(spark, path).withColumn("command", command)
    got = online.run_to_table(online.play_segments(s, "k", "ts", "o", "command", [2, 3], DELAY), str(tmp_path / "o"), str(tmp_path / "c"))
    want = set()
    for k, part in settled(pdf).sort_values(["ts", "o"]).groupby("k"):
        active, stop = False, 0
        for o in part["o"]:
            if o % 11 == 0:
                active = True
            elif o % 13 == 0:
                stop += active
                active = False
            elif active:
                want.add((k, o, stop))
    assert {(r["k"], r["at"], r["stop_id"]) for r in got.collect()} == want and want


def test_first_detections_are_appended_once(spark, feed, tmp_path):
    pdf, path = feed
    s = stream(spark, path).withColumn("frame", F.col("o") % 40)
    got = online.run_to_table(online.first_detections(s, ["k", "frame"], "ts", "o", DELAY, "1 day"), str(tmp_path / "o"), str(tmp_path / "c"))
    rows = settled(pdf).assign(frame=lambda d: d["o"] % 40).sort_values(["ts", "o"]).groupby(["k", "frame"]).first()
    assert sorted((r["k"], r["frame"], r["o"]) for r in got.collect()) == sorted((k, f, o) for (k, f), o in rows["o"].items())


def track(pdf, scale):
    return pdf.assign(t=(pdf["ts"] - START).dt.total_seconds() / scale, v=pdf["v"].fillna(0.0))


def test_clean_tracks_equal_gap_filling(spark, feed, tmp_path):
    pdf, path = feed
    repeated = pd.concat([pdf, pdf.iloc[::50]])  # repeated rows
    path2 = str(tmp_path / "in")
    write_files(spark, repeated, path2, 3, 250, 3)
    for folder, rows in ((path, pdf), (path2, repeated)):
        s = stream(spark, folder).na.fill(0.0, ["v"]).withColumn("t", (F.unix_micros("ts") - START.value // 1000) / 1e6 / 150)
        out = str(tmp_path / f"o{len(rows)}")
        got = online.run_to_table(online.clean_tracks(s, "k", "ts", "t", ["v"], DELAY, "1 day"), out, out + "-c")
        want = tracks.fill_gaps(spark.createDataFrame(track(settled(rows), 150)[["k", "t", "v"]]), ["k"], "t", ["v"])
        a, b = (sorted((r["k"], round(r["t"], 9), r["v"], r["mask"]) for r in d.collect()) for d in (got, want))
        assert a == b and len(a) > 400 and any(not r[3] for r in a)


@pytest.mark.parametrize("files", [1, 5])
def test_a_silent_track_starts_anew(spark, tmp_path, files):
    seconds = [0, 1, 2, 3, 5000, 5001, 5002, 9000, 9001, 9900]
    pdf = pd.DataFrame({"k": "a", "o": range(10), "v": np.arange(10.0), "ts": START + pd.to_timedelta(seconds, unit="s")})
    path = str(tmp_path / "in")
    write_files(spark, pdf, path, files, 0)
    s = stream(spark, path).withColumn("t", (F.unix_micros("ts") - START.value // 1000) / 1e6)
    got = online.run_to_table(online.clean_tracks(s, "k", "ts", "t", ["v"], DELAY, "1000 seconds"), str(tmp_path / "o"), str(tmp_path / "c"))
    rows = got.toPandas()
    assert sorted(rows[rows["mask"]]["v"]) == list(np.arange(9.0))  # the last row still waits
    assert sorted(rows[~rows["mask"]]["t"].astype(int).unique()) == [0, 1, 2, 5000, 5001, 9000]


def test_late_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    path, ts = str(tmp_path / "in"), lambda m: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)
    # the watermark of a trigger filters rows from the trigger after the next one
    for minutes in ([0, 1, 2], [120, 121], [130], [3], [300]):
        df = pd.DataFrame({"ts": [ts(m) for m in minutes], "k": "a", "v": 1.0})
        spark.createDataFrame(df).coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema("ts timestamp, k string, v double").option("maxFilesPerTrigger", 1).parquet(path)
    counts = online.window_counts(s, "ts", ["k"], "v", "1 hour", "10 minutes").select("window.start", "cnt")
    got = online.run_to_table(counts, str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted((r["start"].hour, r["cnt"]) for r in got.collect()) == [(0, 3), (2, 3)]


class Held:
    """The states of one key, as a processor sees them; counts the calls."""

    def __init__(self):
        self.calls, self.values, self.timers = 0, {}, set()

    def getValueState(self, name, *schema):  # noqa: N802
        return Cell(self, name)

    getMapState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.mark


class Cell:
    """A value or a map of a state."""

    def __init__(self, held, name):
        self.held, self.name = held, name

    def _all(self):
        self.held.calls += 1
        return self.held.values.setdefault(self.name, {})

    def get(self):
        return self._all().get(None)

    def update(self, value):
        self._all()[None] = value

    def clear(self):
        self._all().clear()

    def getValue(self, key):  # noqa: N802
        return self._all()[key]

    def updateValue(self, key, value):  # noqa: N802
        self._all()[key] = value

    def removeKey(self, key):  # noqa: N802
        del self._all()[key]

    def keys(self):
        return iter(list(self._all()))

    def iterator(self):
        return iter(list(self._all().items()))


def fed(processor, key, batches, marks, step=500):
    """Output of a processor that gets one batch of rows before each watermark (in milliseconds)."""
    held, out = Held(), []
    processor.init(held)
    for pdf, mark in zip(batches, marks):
        held.mark = mark
        processor.handleInputRows(key, iter([pdf.iloc[a:a + step] for a in range(0, len(pdf), step)]), held)
        while due := [t for t in held.timers if t < mark]:
            held.timers -= set(due)
            out += list(processor.handleExpiredTimer(key, held, None))
    return (pd.concat(out) if out else None), held


def sparse_rows(n, keys, seed=2):
    """Rows of many keys, hours apart, in any order."""
    rng = np.random.default_rng(seed)
    at = rng.integers(0, 700 * 3_600_000_000, n)
    return pd.DataFrame({"event_us": at, "o": np.arange(n), "command": rng.choice([-1, -1, -1, 2, 0], n), "key_text": rng.choice([f"k{i}" for i in range(keys)], n)})


@pytest.mark.parametrize("piece, taken, handed", [(1 << 20, 1 << 25, 1 << 23), (300, 4000, 900), (40, 40, 40)])
def test_keys_of_a_bucket_share_calls_to_the_state(piece, taken, handed):
    pdf = sparse_rows(4000, 150)
    parts, marks = [pdf.sample(frac=1.0, random_state=1).iloc[i::3] for i in range(3)], [1, 2, 1_800_000_000]
    gate = online.PlaySegments("o", "command", [2])
    gate.piece, gate.sorted, gate.handed = piece, taken, handed
    got, held = fed(gate, (0,), parts, marks)
    want = set()
    past = pdf[pdf["event_us"] < marks[-1] * 1000].sort_values(["event_us", "o"])
    for name, part in past.groupby("key_text"):
        active, stop = False, 0
        for o, c in zip(part["o"], part["command"]):
            if c == 2:
                active = True
            elif c == 0:
                stop += active
                active = False
            elif active:
                want.add((name, o, stop))
    assert set(zip(got["key_text"], got["at"], got["stop_id"])) == want and len(got) == len(want) > 500
    assert 0 < len(past) < len(pdf)
    if piece == 1 << 20:
        assert held.calls < 100  # 4,000 rows of 150 keys in some 700 hours


def test_silent_keys_of_a_bucket_are_let_go():
    hour = 3_600_000_000
    pdf = pd.DataFrame({"event_us": [0, hour, 20 * hour, 300 * hour, 400 * hour], "o": [1, 2, 3, 4, 5], "key_text": ["a", "a", "b", "a", "c"]})
    first = online.FirstRow("o", 100 * hour)
    got, held = fed(first, (0,), [pdf.iloc[:3], pdf.iloc[3:]], [30 * 3_600_000, 350 * 3_600_000])
    assert sorted(zip(got["key_text"], got["o"])) == [("a", 1), ("a", 4), ("b", 3)]
    assert sorted(first.known) == ["a", "c"]  # b is forgotten, c still waits


def test_dense_streams_meet_without_pairs():
    """Every row has hundreds of partners in reach; the gate sees each row once."""
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame({"event_us": np.sort(rng.integers(0, 3_000_000, n)), "o": rng.permutation(n), "channel": rng.integers(0, 2, n)})
    gate = online.PairGate(["k"], "o", "channel", 400_000, 90_000)
    seen, plain = [], gate.ready
    gate.ready = lambda rows: (seen.append(len(rows)), plain(rows))[1]
    got, held = fed(gate, ("a",), [pdf], [3_500])
    rows, last, want = sorted(zip(pdf["event_us"], pdf["o"], pdf["channel"])), None, []
    for i, (at, o, c) in enumerate(rows):
        if at >= 3_500_000 - 400_000:
            break
        before = max(((a, p) for a, p, d in rows[:i] if d != c and at - a <= 400_000), default=None)
        if before and (last is None or (before > last and at - last[0] > 90_000)):
            last = (at, o)
            want.append(o)
    assert got["at"].tolist() == want and len(want) > 20
    assert sum(seen) == n and held.calls < 60
