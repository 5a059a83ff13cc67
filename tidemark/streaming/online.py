"""Detectors, gates, blocks and segments as Structured Streaming state.

The state of a key is what the batch kernels keep between chunks: a few numbers
and, for windowed detectors, the last rows.  Rows reach a kernel in event-time order:
they wait until the watermark has passed them (see ``inorder``), so results do not
depend on files, triggers or the order of arrival within the delay.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

import tidemark
from tidemark import session
from tidemark.operators import gates  # noqa: F401  (registers the gate kernels)
from tidemark.operators.detectors import kernels
from tidemark.streaming.inorder import TIME, InOrder, ManyKeys

#: Buckets of keys that share their state, where keys have few rows each.
BUCKETS = 256
NUMBERS = T.StructType([T.StructField("v", T.ArrayType(T.DoubleType()))])


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", session.STATE_STORE)


class OnlineDetector(InOrder):
    """One detector per key; gives the position, time and tie-breaking column of each alarm."""

    def __init__(self, keys: list[str], tie: str, value: str, params: dict, kernel: type):
        super().__init__(keys, [(tie, "<i8"), (value, "<f8")], 2)
        self.tie, self.value, self.params, self.kernel = tie, value, params, kernel

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", NUMBERS)
        self.recent = handle.getValueState("recent", NUMBERS)
        self.seen = handle.getValueState("seen", NUMBERS)

    def numbers(self, rows: np.ndarray) -> np.ndarray:
        return rows[self.value]

    def ready(self, rows: np.ndarray) -> pd.DataFrame | None:
        x = self.numbers(rows)
        rows, x = rows[np.isfinite(x)], x[np.isfinite(x)]
        if not len(rows):
            return None
        start = list(self.state.get()[0]) if self.state.exists() else self.kernel.cold(self.params)
        pre = np.array(self.recent.get()[0], dtype=float) if self.recent.exists() else x[:0]
        count, total = self.seen.get()[0] if self.seen.exists() else (0.0, 0.0)
        hits, stop = self.kernel.run(self.params, start, pre, x, (count, total))
        keep = self.kernel.reach(self.params) if getattr(self.kernel, "settles", False) else 0
        held = np.concatenate([pre, x])[-keep:] if keep else x[:0]
        self.state.update(([float(v) for v in stop],))
        self.recent.update(([float(v) for v in held],))
        self.seen.update(([float(count + len(x)), float(total + x.sum())],))
        hits = np.asarray(hits, dtype=np.int64)
        return pd.DataFrame({"idx": int(count) + hits, "at": rows[self.tie][hits]})


class OnlineGate(OnlineDetector):
    """A gate over codes (twice the position plus the channel), counted from the first one so that they stay exact."""

    def start(self, handle: StatefulProcessorHandle) -> None:
        super().start(handle)
        self.origin = handle.getValueState("origin", "at bigint")

    def numbers(self, rows: np.ndarray) -> np.ndarray:
        if not self.origin.exists():
            self.origin.update((int(rows[self.tie][0]) // 2 * 2,))
        return (rows[self.tie] - int(self.origin.get()[0])).astype(float)


class PairGate(InOrder):
    """Hits among the rows of two channels: a row whose partner, the last row of the other channel, came at most
    ``within_us`` before and after the last hit, if that hit is more than ``pause_us`` ago. An earlier partner can't hit
    where the last one does not, so no pairs are formed: the last place of each channel and the last hit are all that is kept."""

    def __init__(self, keys: list[str], tie: str, channel: str, within_us: int, pause_us: int):
        super().__init__(keys, [(tie, "<i8"), (channel, "<i8")], 3, lag_us=within_us)
        self.tie, self.channel, self.within_us, self.pause_us = tie, channel, within_us, pause_us

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "name string", "at bigint, tie bigint")

    def ready(self, rows: np.ndarray) -> pd.DataFrame | None:
        seen = {k[0]: tuple(v) for k, v in self.seen.iterator()}
        last, latest, hits = seen.get("hit"), [seen.get("0"), seen.get("1")], []
        for at, tie, channel in rows.tolist():
            before = latest[1 - channel]
            if before is not None and at - before[0] <= self.within_us and (last is None or (before > last and at - last[0] > self.pause_us)):
                last = (at, tie)
                hits.append(tie)
            latest[channel] = (at, tie)
        for name, place in (("hit", last), ("0", latest[0]), ("1", latest[1])):
            if place is not None and place != seen.get(name):
                self.seen.updateValue((name,), place)
        return pd.DataFrame({"at": hits}) if hits else None


class CountBlocks(InOrder):
    """Means of N consecutive rows per key; the unfinished block waits in the state."""

    def __init__(self, keys: list[str], tie: str, value: str, size: int):
        super().__init__(keys, [(tie, "<i8"), (value, "<f8")], 2)
        self.value, self.size = value, size

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", NUMBERS)
        self.done = handle.getValueState("done", NUMBERS)

    def ready(self, rows: np.ndarray) -> pd.DataFrame | None:
        waiting = list(self.open.get()[0]) if self.open.exists() else []
        first = int(self.done.get()[0][0]) if self.done.exists() else 0
        x = np.concatenate([np.array(waiting, dtype=float), rows[self.value]])
        whole = len(x) // self.size
        self.open.update(([float(v) for v in x[whole * self.size:]],))
        self.done.update(([float(first + whole)],))
        if not whole:
            return None
        last = rows[TIME][np.arange(1, whole + 1) * self.size - len(waiting) - 1]
        return pd.DataFrame({"block": np.arange(first, first + whole, dtype="int64"), "block_mean": x[:whole * self.size].reshape(whole, self.size).mean(axis=1),
                             "closed": last.astype("int64")})


class PlaySegments(ManyKeys):
    """Rows between an opening and a closing command, with the segment number.

    Commands change the state, so it is known between two changes: the last command of
    all rows so far says whether play is open, and closings after an opening are counted.
    """

    def __init__(self, tie: str, command: str, opening: list[int]):
        super().__init__([(tie, "<i8"), (command, "<i8")], 2)
        self.tie, self.command, self.opening = tie, command, opening

    def turn(self, rows: np.ndarray, state: tuple | None) -> tuple[dict[str, np.ndarray], tuple]:
        active, stop = state or (False, 0)
        command = rows[self.command]
        at = np.flatnonzero(command >= 0)
        after = np.r_[active, np.isin(command[at], self.opening)]  # play is open behind each command
        closes = ~after[1:] & after[:-1]
        seen = np.searchsorted(at, np.arange(len(rows)), "right")  # commands up to each row
        stops = np.r_[0, np.cumsum(closes)][seen] + stop
        inside = (command < 0) & after[seen]
        return {"at": rows[self.tie][inside], "stop_id": stops[inside].astype("int64")}, (bool(after[-1]), stop + int(closes.sum()))


class FirstRow(ManyKeys):
    """The first row of a key by time and tie; a silent key is forgotten, and its next row counts as first again."""

    def __init__(self, tie: str, keep_us: int):
        super().__init__([(tie, "<i8")], 2)
        self.tie, self.keep_us = tie, keep_us

    def turn(self, rows: np.ndarray, state: tuple | None) -> tuple[dict[str, np.ndarray], tuple]:
        new = np.diff(rows[TIME], prepend=rows[TIME][0] if state is None else state[0]) > self.keep_us
        new[0] |= state is None
        return {self.tie: rows[self.tie][new]}, (int(rows[TIME][-1]),)

    def end(self, state: tuple) -> int | None:
        return state[0] + self.keep_us


class CleanTrack(ManyKeys):
    """A track at the frame rate: bursts are dropped, gaps are filled with the last values.

    A row at most ``shortest`` seconds after the last kept row goes. A gap of ``longest`` or more
    gets rows with mask false, as many as fit while the rest stays 0.6 frames long. After more than ``keep_us``
    of silence a new track begins: nothing is filled, and the state of the key is let go.
    """

    def __init__(self, time: str, values: list[str], limits: tuple[float, float, float], keep_us: int):
        super().__init__([(c, "<f8") for c in (time, *values)], 2 + len(values))
        self.time, self.values, self.limits, self.keep_us = time, values, limits, keep_us

    def turn(self, rows: np.ndarray, state: tuple | None) -> tuple[dict[str, np.ndarray], tuple]:
        shortest, longest, rate = self.limits
        names = [self.time, *self.values]
        table, event = np.column_stack([rows[c] for c in names]), rows[TIME]
        if state is not None:
            table, event = np.vstack([[state[1]], table]), np.r_[state[0], event]
        kept, last = [0], 0
        clear = (np.diff(table[:, 0]) > shortest).tolist()
        for i in range(1, len(table)):
            if clear[i - 1] or table[i, 0] - table[last, 0] > shortest:
                kept.append(i)
                last = i
        table, event = table[kept], event[kept]
        gap = np.diff(table[:, 0])
        fill = np.where((gap >= longest) & (np.diff(event) <= self.keep_us), np.maximum(np.floor(rate * gap - 0.6), 0), 0).astype(np.int64)
        k = np.arange(fill.sum()) - np.repeat(np.cumsum(fill) - fill, fill) + 1
        filled = np.repeat(table[:-1], fill, axis=0)
        filled[:, 0] += k / rate
        seen = table if state is None else table[1:]
        out = np.vstack([seen, filled])
        columns = {c: out[:, i] for i, c in enumerate(names)}
        columns["mask"] = np.r_[np.ones(len(seen), bool), np.zeros(len(filled), bool)]
        return columns, (int(event[-1]), table[-1].tolist())

    def end(self, state: tuple) -> int | None:
        return state[0] + self.keep_us


def _micros(length: str) -> int:
    return int(pd.Timedelta(length).value // 1000)


def _transform(
    df: DataFrame, keys: list[str], time: str, delay: str | None, columns: list[str], processor: StatefulProcessor, schema: str, keyed: bool = True
) -> DataFrame:
    """Attach an ordered processor behind a watermark; it is sent with its code, not by name. Rows without a time have no place and go.

    No ``delay`` means that ``time`` has its watermark already; ``keyed`` puts the keys in front of the output.

    The state schema is read in a helper process that does not see the files sent
    to the workers, so the processor must not need an import of this package.
    """
    use_state_store(df.sparkSession)
    session.ship(df.sparkSession)
    kinds = dict(df.dtypes)
    marked = df.where(F.col(time).isNotNull())
    marked = marked if delay is None else marked.withWatermark(time, delay)
    timed = marked.select(*keys, time, F.unix_micros(time).alias(TIME), *columns)
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " if keyed else ""
    cloudpickle.register_pickle_by_value(tidemark)
    try:
        return timed.groupBy(*keys).transformWithStateInPandas(
            statefulProcessor=processor, outputStructType=f"{named}{schema}", outputMode="Append", timeMode="EventTime")
    finally:
        cloudpickle.unregister_pickle_by_value(tidemark)


def _many_keys(
    df: DataFrame, keys: list[str], time: str, delay: str, columns: list[str], processor: ManyKeys, schema: str, buckets: int = BUCKETS
) -> DataFrame:
    """The same for processors of many keys with few rows each: the state is grouped by buckets of keys.

    A key goes through the state as JSON text, and comes back with its types.
    """
    kinds = dict(df.dtypes)
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket")
    told = F.to_json(F.struct(*keys)).alias(ManyKeys.KEY)
    rows = df.select(bucket, told, time, *columns)
    out = _transform(rows, ["_bucket"], time, delay, [ManyKeys.KEY, *[c for c in rows.columns[3:]]], processor, f"{ManyKeys.KEY} string, {schema}", False)
    given = [c for c in out.columns if c != ManyKeys.KEY]
    return out.withColumn(ManyKeys.KEY, F.from_json(ManyKeys.KEY, named)).select(*[F.col(f"{ManyKeys.KEY}.{k}").alias(k) for k in keys], *given)


def online_alarms(df: DataFrame, key: str, time: str, tie: str, value: str, config: dict, delay: str) -> DataFrame:
    """Alarms of the rows that the watermark has passed, by (time, tie): the same as one batch pass over them."""
    params = {k: v for k, v in config.items() if not callable(v)}
    if config["detector"] == "recent_sample":
        params.setdefault("step", kernels.ks_critical_step(
            float(config["alpha"]), int(config["window_size"]), int(config["stat_size"])))
    processor = OnlineDetector([key], tie, value, params, kernels.DETECTORS[config["detector"]])
    return _transform(df, [key], time, delay, [F.col(tie).cast("bigint").alias(tie), F.col(value).cast("double").alias(value)], processor, "idx bigint, at bigint")


def online_gate(df: DataFrame, key: str, time: str, position: str, channel: str, width: int, debounce: int, delay: str) -> DataFrame:
    """Coincidence of two alarm channels that arrive as one stream, in order of (time, position, channel)."""
    params = {"W": width, "debounce": debounce}
    processor = OnlineGate([key], "code", "heard", params, kernels.DETECTORS["coincidence"])
    code = F.col(position).cast("bigint") * 2 + F.col(channel).cast("bigint")
    alarms = _transform(df, [key], time, delay, [code.alias("code"), F.lit(0.0).alias("heard")], processor, "idx bigint, at bigint")
    return alarms.withColumn("at", F.shiftright("at", 1))


def coincidences(a: DataFrame, b: DataFrame, key: str, time: str, tie: str, within: str, pause: str, delay: str) -> DataFrame:
    """Coincidence of two alarm streams with a source each: rows (key, at) whose partner in the other stream came
    at most ``within`` before, debounced by ``pause``, as the queue gate over (time, tie) finds them.

    The streams are stacked, each behind its own watermark, and the gate follows the slower one by ``within``: rows are
    held that long and meet the last row of the other stream only, however many are near. Ties are
    positions over both streams: equal times are ordered by them. Rows without a key have no partner.
    """
    sides = []
    for channel, df in enumerate((a, b)):
        marked = df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, delay)
        sides.append(marked.select(key, time, F.col(tie).cast("bigint").alias(tie), F.lit(channel).cast("bigint").alias("channel")))
    gate = PairGate([key], tie, "channel", _micros(within), _micros(pause))
    return _transform(sides[0].unionByName(sides[1]), [key], time, None, [F.col(tie), F.col("channel")], gate, "at bigint")


def count_blocks(df: DataFrame, key: str, time: str, tie: str, value: str, size: int, delay: str) -> DataFrame:
    """Block number, mean and the event time at which the block was full (microseconds)."""
    columns = [F.col(tie).cast("bigint").alias(tie), F.col(value).cast("double").alias(value)]
    return _transform(df, [key], time, delay, columns, CountBlocks([key], tie, value, size), "block bigint, block_mean double, closed bigint")


def play_segments(df: DataFrame, key: str, time: str, tie: str, command: str, opening: list[int], delay: str) -> DataFrame:
    """``command`` is negative on detections and a referee command elsewhere."""
    columns = [F.col(tie).cast("bigint").alias(tie), F.col(command).cast("bigint").alias(command)]
    return _many_keys(df, [key], time, delay, columns, PlaySegments(tie, command, opening), "at bigint, stop_id bigint")


def first_detections(df: DataFrame, keys: list[str], time: str, tie: str, delay: str, keep: str) -> DataFrame:
    """The earliest row of every key, appended once; a key silent for ``keep`` starts anew."""
    return _many_keys(df, keys, time, delay, [F.col(tie).cast("bigint").alias(tie)], FirstRow(tie, _micros(keep)), f"`{tie}` bigint")


def clean_tracks(df: DataFrame, key: str, time: str, seconds: str, values: list[str], delay: str, keep: str) -> DataFrame:
    """Tracks without bursts and gaps, as ``tracks.fill_gaps`` gives them, appended once the watermark has passed."""
    from tidemark.operators.tracks import FRAME_RATE, LONGEST_STEP, SHORTEST_STEP

    names = [seconds, *values]
    processor = CleanTrack(seconds, values, (SHORTEST_STEP, LONGEST_STEP, FRAME_RATE), _micros(keep))
    schema = ", ".join(f"`{c}` double" for c in names) + ", mask boolean"
    return _many_keys(df, [key], time, delay, [F.col(c).cast("double").alias(c) for c in names], processor, schema)


def window_counts(df: DataFrame, time: str, keys: list[str], value: str, length: str, delay: str) -> DataFrame:
    """Counts of each value per closed time window: all that KS and WD need."""
    return df.withWatermark(time, delay).groupBy(F.window(time, length), *keys, value).agg(F.count(F.lit(1)).alias("cnt"))


def drift_per_window(counts: DataFrame, base: DataFrame, keys: list[str], value: str) -> DataFrame:
    """KS and Wasserstein of each closed window against a baseline sample."""
    from tidemark.operators.distance import shift_table

    rows = counts.select(F.col("window.start").alias("window_start"), *keys, value, F.explode(F.sequence(F.lit(1), F.col("cnt"))))
    return shift_table(rows.drop("col"), ["window_start", *keys], value, base, keys).drop("n")


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there, write parquet exactly once, and read it back."""
    q = (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_batches(df: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    q = df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
