"""Rows of a key in event-time order, whatever order they arrive in.

A row waits in the state until the watermark has passed its time; then all such rows of
the key are handed over by time and tie-breaking columns. Waiting rows are sorted where they
arrive and packed into pieces of bounded size, named by their first time; a hand-over merges the
pieces by these names, so that only pieces that overlap in time meet in memory, and the state holds no more than the
rows above the watermark. A key costs a few calls to the state for each piece, not for each stretch of time.
``ManyKeys`` is for keys with few rows each: all keys of a bucket share the pieces, the timer and one packed table of
their states, so that calls to the state are counted by buckets.
One event-time timer per key (or bucket), set to the first waiting row, asks for the next hand-over. Rows at or above the last
watermark (less ``lag_us``, where a processor asks for it) are still waiting when a stream ends;
rows behind the watermark were dropped before they got here.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TIME = "event_us"
#: Bytes of a piece of waiting rows, of rows that are sorted at once where they arrive, and of rows that are handed over at once.
PIECE, SORTED, HANDED = 1 << 20, 1 << 25, 1 << 23


class InOrder(StatefulProcessor):
    """Base of the ordered processors.

    ``fields`` are (column, NumPy type) pairs of a row, in microseconds of event time first; the first ``ordering`` of them
    order the rows. Subclasses give ``start`` (their own states) and ``ready`` (rows in order to output
    rows).
    """

    def __init__(self, keys: list[str], fields: list[tuple[str, str]], ordering: int, lag_us: int = 0):
        self.keys, self.ordering, self.lag_us = keys, ordering, lag_us
        self.fields = [(TIME, "<i8"), *fields]
        self.piece, self.sorted, self.handed = PIECE, SORTED, HANDED

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first bigint, number bigint", "data binary")
        self.due = handle.getValueState("due", "at bigint, pieces bigint")
        self.start(handle)

    def start(self, handle: StatefulProcessorHandle) -> None:
        """Open the states of the subclass."""

    def ready(self, rows: np.ndarray) -> pd.DataFrame | None:
        raise NotImplementedError

    def opened(self) -> None:
        """Called before rows are taken in or handed over."""

    def packed(self, pdf: pd.DataFrame) -> np.ndarray:
        """Rows as they wait in the state."""
        data = np.empty(len(pdf), dtype=self.fields)
        for name, kind in self.fields:
            data[name] = pdf[name].to_numpy(dtype=kind)
        return data

    def settled(self, passed: int) -> int | None:
        """Called after rows were handed over; the time in microseconds at which something may be let go next."""
        return None

    def closed(self) -> None:
        """Called after rows were taken in or handed over."""

    def _timer(self, first_us: int) -> int:
        """The watermark in milliseconds that hands a row of that time over."""
        return (first_us + self.lag_us) // 1000

    def _in_order(self, parts: list[np.ndarray]) -> np.ndarray:
        data = np.concatenate(parts) if len(parts) > 1 else parts[0]
        return data[np.lexsort([data[name] for name, _ in self.fields[:self.ordering][::-1]])]

    def _keep(self, data: np.ndarray, number: int) -> int:
        """Store sorted rows in pieces; the number of the next piece."""
        step = max(1, self.piece // data.itemsize)
        for at in range(0, len(data), step):
            part = data[at:at + step]
            self.waiting.updateValue((int(part[TIME][0]), number), (part.tobytes(),))
            number += 1
        return number

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.opened()
        held, number = self.due.get() or (None, 0)
        first, parts, size, began = None, [], 0, number
        for pdf in rows:
            if not len(pdf):
                continue
            data = self.packed(pdf)
            parts.append(data)
            size += data.nbytes
            first = int(data[TIME].min()) if first is None else min(first, int(data[TIME].min()))
            if size >= self.sorted:
                number, parts, size = self._keep(self._in_order(parts), number), [], 0
        if parts:
            number = self._keep(self._in_order(parts), number)
        if number == began:
            return iter(())
        at = self._timer(first)
        if held is None or at < held:
            if held is not None:
                self.handle.deleteTimer(held)
            self.handle.registerTimer(at)
            held = at
        self.due.update((held, number))
        self.closed()
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.opened()
        passed = timerValues.getCurrentWatermarkInMs() * 1000 - self.lag_us
        _, number = self.due.get() or (None, 0)
        pieces = sorted((int(k[0]), int(k[1])) for k in self.waiting.keys())
        due = [p for p in pieces if p[0] < passed]
        first = pieces[len(due)][0] if len(due) < len(pieces) else None
        pool, fresh = [], 0
        for i, piece in enumerate(due):
            pool.append(np.frombuffer(bytes(self.waiting.getValue(piece)[0]), dtype=self.fields))
            self.waiting.removeKey(piece)
            fresh += pool[-1].nbytes
            last = i + 1 == len(due)
            if fresh < self.handed and not last:
                continue
            data, fresh = self._in_order(pool), 0
            n = int(np.searchsorted(data[TIME], passed if last else due[i + 1][0]))  # no piece to come has an earlier row
            if n:
                out = self.ready(data[:n])
                if out is not None and len(out):
                    for j, name in enumerate(self.keys):
                        out.insert(j, name, key[j])
                    yield out
            pool = [data[n:]]
        if pool and len(pool[0]):
            first = int(pool[0][TIME][0]) if first is None else min(first, int(pool[0][TIME][0]))
            number = self._keep(pool[0], number)
        end = self.settled(passed)
        self.closed()
        at = self._timer(first) if first is not None else None if end is None else end // 1000
        if at is None:
            self.due.clear()
            return
        self.handle.registerTimer(at)
        self.due.update((at, number))

    def close(self) -> None:
        pass


class ManyKeys(InOrder):
    """Base of the ordered processors that work on buckets of keys, each with few rows; KEY names the key of a row.

    Subclasses give ``turn``: the rows of one key in order and its state to columns of output and the new state; and ``end``,
    the time in microseconds after which a key may be forgotten. A key is held as [number, rows waiting, state].
    """

    KEY = "key_text"

    def __init__(self, fields: list[tuple[str, str]], ordering: int):
        super().__init__([], [*fields, (self.KEY, "<i8")], ordering)

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.table = handle.getValueState("table", "next bigint, known binary")

    def turn(self, rows: np.ndarray, state: tuple | None) -> tuple[dict[str, np.ndarray], tuple]:
        raise NotImplementedError

    def end(self, state: tuple) -> int | None:
        return None

    def opened(self) -> None:
        held = self.table.get()
        self.next, self.known = (held[0], pickle.loads(bytes(held[1]))) if held else (0, {})

    def closed(self) -> None:
        if self.known:
            self.table.update((self.next, pickle.dumps(self.known)))
        else:
            self.table.clear()

    def packed(self, pdf: pd.DataFrame) -> np.ndarray:
        place, names = pd.factorize(pdf[self.KEY])
        numbers = np.empty(len(names), np.int64)
        for i, (name, n) in enumerate(zip(names, np.bincount(place).tolist())):
            if name not in self.known:
                self.known[name] = [self.next, 0, None]
                self.next += 1
            entry = self.known[name]
            numbers[i] = entry[0]
            entry[1] += n
        return super().packed(pdf.assign(**{self.KEY: numbers[place]}))

    def ready(self, rows: np.ndarray) -> pd.DataFrame | None:
        by_number = {entry[0]: (name, entry) for name, entry in self.known.items()}
        rows = rows[np.argsort(rows[self.KEY], kind="stable")]
        starts = np.flatnonzero(np.diff(rows[self.KEY], prepend=-1))
        names, lengths, columns = [], [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
            name, entry = by_number[int(rows[self.KEY][a])]
            out, entry[2] = self.turn(rows[a:b], entry[2])
            entry[1] -= b - a
            n = len(next(iter(out.values())))
            if n:
                names.append(name)
                lengths.append(n)
                columns.append(out)
        if not names:
            return None
        table = {c: np.concatenate([out[c] for out in columns]) for c in columns[0]}
        return pd.DataFrame({self.KEY: np.repeat(np.array(names, dtype=object), lengths), **table})

    def settled(self, passed: int) -> int | None:
        first = None
        for name, (_, waiting, state) in list(self.known.items()):
            end = None if waiting or state is None else self.end(state)
            if end is not None and end < passed:
                del self.known[name]
            elif end is not None:
                first = end if first is None else min(first, end)
        return first
