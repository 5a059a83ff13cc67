"""Detector kernels that advance a small state over one stretch of a series.

``run(p, state, pre, x, lead)`` returns the offsets in ``x`` where the detector
fires and the state after ``x``.  ``pre`` holds the rows just before ``x``; a
state refers to them by length, so it stays a few numbers.  ``lead`` is the
count and the sum of all earlier rows (used by the running mean).  ``settles``
says whether two runs from different states meet again on their own.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

FIRST_LOOK = 2048
LONGEST_LOOK = 65536
#: Two-halves test: rows looked at one by one after the rest of an alarm, and the first stretch behind them.
SINGLE_ROWS = 8
SPLIT_LOOK = 64


def _looks(start: int, end: int, size: int = FIRST_LOOK):
    """Stretches to test at once: short after an alarm, then growing."""
    while start < end:
        yield start, min(end, start + size)
        start += size
        size = min(LONGEST_LOOK, size * 2)


class MeanSplit:
    """Two halves of a growing window compared by a Welch z (light ADWIN)."""

    settles = True

    @staticmethod
    def reach(p: dict) -> int:
        return int(p["max_window"])

    @staticmethod
    def cold(p: dict) -> list[float]:
        return [0.0, 0.0]

    @staticmethod
    def critical(delta: float) -> float:
        return max(2.0, math.sqrt(2.0 * math.log(2.0 / delta)))

    @classmethod
    def run(cls, p, state, pre, x, lead):
        held, cool = int(state[0]), int(state[1])
        longest, shortest = int(p["max_window"]), int(p["min_window"])
        limit = cls.critical(float(p["delta"]))
        base = pre[len(pre) - held:] if held else pre[:0]
        full = np.concatenate([base, x])
        end = len(full)
        centred = full - (full.mean() if end else 0.0)
        s1 = np.concatenate([[0.0], np.cumsum(centred)])
        s2 = np.concatenate([[0.0], np.cumsum(centred * centred)])
        start, at, quiet = 0, held, held + cool
        fired, looks = [], cls._single(s1.tolist(), s2.tolist(), longest, limit)
        while longest >= shortest:
            begin = max(at, quiet, start + shortest - 1)
            singles = min(end, begin + SINGLE_ROWS)
            hit = next((i for i in range(begin, singles) if looks(i, start)), -1)
            for a, b in _looks(singles, end, SPLIT_LOOK) if hit < 0 else ():
                i = np.arange(a, b)
                length = np.minimum(i - start + 1, longest)
                left = i - length + 1
                cut = left + length // 2
                na, nb = length // 2, length - length // 2
                with np.errstate(divide="ignore", invalid="ignore"):
                    ma, mb = (s1[cut] - s1[left]) / na, (s1[i + 1] - s1[cut]) / nb
                    va = np.maximum((s2[cut] - s2[left]) - na * ma * ma, 0.0) / (na - 1)
                    vb = np.maximum((s2[i + 1] - s2[cut]) - nb * mb * mb, 0.0) / (nb - 1)
                    sd = np.sqrt(va / na + vb / nb)
                    over = (sd >= 1e-9) & (np.abs(ma - mb) > limit * sd)
                found = np.flatnonzero(over)
                if len(found):
                    hit = a + int(found[0])
                    break
            if hit < 0:
                break
            fired.append(hit - held)
            length = min(hit - start + 1, longest)
            start = hit - length + 1 + length // 2
            at, quiet = hit + 1, hit + 1 + int(p["cooldown"])
        return np.asarray(fired, dtype=np.int64), [
            float(min(end - start, longest)), float(max(0, quiet - end))]

    @staticmethod
    def _single(s1: list[float], s2: list[float], longest: int, limit: float):
        """The test of ``run`` at one row, with the same operations in the same order."""
        def over(i: int, start: int) -> bool:
            length = min(i - start + 1, longest)
            left, na = i - length + 1, length // 2
            if na < 2:
                return False
            cut, nb = left + na, length - na
            ma, mb = (s1[cut] - s1[left]) / na, (s1[i + 1] - s1[cut]) / nb
            va = max((s2[cut] - s2[left]) - na * ma * ma, 0.0) / (na - 1)
            vb = max((s2[i + 1] - s2[cut]) - nb * mb * mb, 0.0) / (nb - 1)
            sd = math.sqrt(va / na + vb / nb)
            return sd >= 1e-9 and abs(ma - mb) > limit * sd

        return over


class PageHinkley:
    """Excess of the running sum of deviations over its minimum."""

    settles = True

    @staticmethod
    def reach(p: dict) -> int:
        return int(p.get("warm", 20000))

    @staticmethod
    def cold(p: dict) -> list[float]:
        return [0.0, 0.0]

    @staticmethod
    def run(p, state, pre, x, lead):
        level, cool = float(state[0]), int(state[1])
        count, total = lead
        n = count + np.arange(1, len(x) + 1)
        step = x - (total + np.cumsum(x)) / n - float(p["delta"])
        limit, ready = float(p["threshold"]), int(p["min_instances"])
        at, quiet, end = 0, cool, len(x)
        fired = []
        while at < end:
            hit = -1
            for a, b in _looks(at, end):
                path = level + np.cumsum(step[a:b])
                low = np.minimum(np.minimum.accumulate(path), 0.0)
                excess = path - low
                i = np.arange(a, b)
                found = np.flatnonzero((excess > limit) & (n[a:b] >= ready) & (i >= quiet))
                if len(found):
                    hit = a + int(found[0])
                    break
                level = float(excess[-1])
            if hit < 0:
                break
            fired.append(hit)
            level, at, quiet = 0.0, hit + 1, hit + 1 + int(p["cooldown"])
        return np.asarray(fired, dtype=np.int64), [level, float(max(0, quiet - end))]


@lru_cache(maxsize=64)
def ks_critical_step(alpha: float, n: int, m: int) -> int:
    """Smallest h such that a two-sample distance of h/lcm(n, m) has p < alpha.

    The exact p-value counts lattice paths from (0, 0) to (n, m) that leave the
    band of width h around the diagonal; shares of paths are carried instead of
    counts so that nothing overflows.
    """
    unit = n * m // math.gcd(n, m)
    a, b = unit // n, unit // m

    def outside(h: int) -> float:
        # share of all paths that touch a point with distance >= h
        j = np.arange(m + 1)
        row = np.where(np.abs(j * b) < h, 1.0, 0.0)
        stopped = np.flatnonzero(row == 0.0)
        if len(stopped):
            row[stopped[0]:] = 0.0
        for i in range(1, n + 1):
            fresh = np.zeros(m + 1)
            keep = np.abs(i * a - j * b) < h
            for k in range(m + 1):
                if keep[k]:
                    left = fresh[k - 1] * k / (i + k) if k else 0.0
                    fresh[k] = row[k] * i / (i + k) + left
            row = fresh
        return 1.0 - row[m]

    low, high = 0, unit
    while low < high:
        mid = (low + high) // 2
        if outside(mid) < alpha:
            high = mid
        else:
            low = mid + 1
    return low


def ks_distance(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.sort(a), np.sort(b)
    at = np.concatenate([a, b])
    fa = np.searchsorted(a, at, side="right") / len(a)
    fb = np.searchsorted(b, at, side="right") / len(b)
    return float(np.max(np.abs(fa - fb)))


class RecentSample:
    """The newest rows against the rows before them by a KS test (KSWIN)."""

    settles = True

    @staticmethod
    def reach(p: dict) -> int:
        return int(p["window_size"]) + int(p["stat_size"])

    @staticmethod
    def cold(p: dict) -> list[float]:
        return [0.0, 0.0]

    @staticmethod
    def run(p, state, pre, x, lead):
        held, since = int(state[0]), int(state[1])
        ref, new = int(p["window_size"]), int(p["stat_size"])
        unit = ref * new // math.gcd(ref, new)
        limit = int(p["step"])  # found once on the driver, see ks_critical_step
        full = np.concatenate([pre[len(pre) - held:] if held else pre[:0], x])
        start, at, end = 0, held, len(full)
        fired = []
        while True:
            look = max(at + new - since - 1, at, start + ref + new - 1)
            if look >= end:
                break
            old = full[look - ref - new + 1: look - new + 1]
            fresh = full[look - new + 1: look + 1]
            if round(ks_distance(old, fresh) * unit) >= limit:
                fired.append(look - held)
                start = look - new + 1
            at, since = look + 1, 0
        return np.asarray(fired, dtype=np.int64), [
            float(min(end - start, ref + new)), float(since + end - at)]


class BucketWindow:
    """ADWIN with an exponential histogram and all cuts, rebuilt after an alarm."""

    settles = False

    @staticmethod
    def reach(p: dict) -> int:
        return 0

    @staticmethod
    def cold(p: dict) -> list[float]:
        return [0.0]

    @classmethod
    def run(cls, p, state, pre, x, lead):
        w = _Histogram(p, state)
        fired = []
        for i, v in enumerate(x):
            if w.update(float(v)):
                fired.append(i)
        return np.asarray(fired, dtype=np.int64), w.dump()


class _Histogram:
    """Buckets of 1, 2, 4, ... rows; at most ``max_buckets`` of one size stay apart."""

    def __init__(self, p: dict, state: list[float]):
        self.delta = float(p["delta"])
        self.clock = int(p.get("clock", 32))
        self.room = int(p.get("max_buckets", 5))
        bare = bool(p.get("bare", False))
        self.grace = int(p.get("grace", 10)) if bare else int(p["min_window"])
        self.side = int(p.get("side", 5)) if bare else max(5, min(int(p["min_window"]), 64))
        self.longest = math.inf if bare else int(p["max_window"])
        self.rest = 0 if bare else int(p["cooldown"])
        self.bare = bare
        self.clear()
        self.cool = int(state[0])
        if len(state) > 1:
            self.tick, self.width, self.total, self.spread = (
                int(state[1]), int(state[2]), state[3], state[4])
            at = 5
            while at < len(state):
                k = int(state[at])
                self.rows.append([(state[at + 1 + 2 * i], state[at + 2 + 2 * i]) for i in range(k)])
                at += 1 + 2 * k

    def clear(self) -> None:
        self.tick, self.width, self.total, self.spread = 0, 0, 0.0, 0.0
        self.rows: list[list[tuple[float, float]]] = []

    def dump(self) -> list[float]:
        out = [float(self.cool), float(self.tick), float(self.width), self.total, self.spread]
        for row in self.rows:
            out.append(float(len(row)))
            for s, v in row:
                out += [s, v]
        return out

    def add(self, x: float) -> None:
        if self.width:
            gap = x - self.total / self.width
            self.spread += gap * gap * self.width / (self.width + 1)
        self.width += 1
        self.total += x
        carry, level = (x, 0.0), 0
        while carry is not None:
            if level == len(self.rows):
                self.rows.append([])
            row = self.rows[level]
            row.append(carry)
            carry = None
            if len(row) > self.room:
                (s1, v1), (s2, v2) = row.pop(0), row.pop(0)
                carry = (s1 + s2, v1 + v2 + (s1 - s2) ** 2 / (2 << level))
            level += 1

    def drop_oldest(self) -> None:
        level = len(self.rows) - 1
        s, v = self.rows[level].pop(0)
        n = 1 << level
        self.width -= n
        self.total -= s
        if self.width:
            gap = s / n - self.total / self.width
            self.spread -= v + n * self.width * gap * gap / (n + self.width)
        else:
            self.spread = 0.0
        while self.rows and not self.rows[-1]:
            self.rows.pop()

    def changed(self) -> bool:
        found = False
        while self.width > self.side:
            sizes, sums = [], []
            for level in range(len(self.rows) - 1, -1, -1):
                for s, _ in self.rows[level]:
                    sizes.append(1 << level)
                    sums.append(s)
            n0 = np.cumsum(sizes)[:-1]
            if not len(n0):
                break
            u0 = np.cumsum(sums)[:-1]
            n1, u1 = self.width - n0, self.total - u0
            fit = (n0 >= self.side) & (n1 >= self.side)
            if not fit.any():
                break
            log_term = math.log(2.0 * math.log(self.width) / self.delta)
            inverse = 1.0 / (n0[fit] - self.side + 1) + 1.0 / (n1[fit] - self.side + 1)
            noise = max(self.spread, 0.0) / self.width
            bound = np.sqrt(2.0 * inverse * noise * log_term) + 2.0 / 3.0 * log_term * inverse
            if not (np.abs(u0[fit] / n0[fit] - u1[fit] / n1[fit]) > bound).any():
                break
            found = True
            self.drop_oldest()
        return found

    def update(self, x: float) -> bool:
        self.tick += 1
        self.add(x)
        drift = self.tick % self.clock == 0 and self.width > self.grace and self.changed()
        if self.bare:
            return bool(drift)
        fired = False
        if self.cool > 0:
            self.cool -= 1
            return False
        if drift:
            fired = True
            self.cool = self.rest
            self.clear()
        if self.width > self.longest:
            self.clear()
        return fired


class TwoSidedHinkley:
    """Page-Hinkley with forgetting, tested upwards and downwards, reset on alarm."""

    settles = False

    @staticmethod
    def reach(p: dict) -> int:
        return 0

    @staticmethod
    def cold(p: dict) -> list[float]:
        return [0.0, 0.0, 0.0, 0.0, math.inf, -math.inf]

    @classmethod
    def run(cls, p, state, pre, x, lead):
        keep, slack = float(p.get("alpha", 0.9999)), float(p.get("delta", 0.005))
        limit, ready = float(p["threshold"]), int(p.get("min_instances", 30))
        n, mean, up, down, low, high = state
        fired = []
        for i, v in enumerate(x):
            n += 1
            mean += (float(v) - mean) / n
            dev = float(v) - mean
            up, down = keep * up + dev - slack, keep * down + dev + slack
            low, high = min(low, up), max(high, down)
            if n >= ready and max(up - low, high - down) > limit:
                fired.append(i)
                n, mean, up, down, low, high = cls.cold(p)
        return np.asarray(fired, dtype=np.int64), [n, mean, up, down, low, high]


DETECTORS = {
    "mean_split": MeanSplit,
    "page_hinkley": PageHinkley,
    "recent_sample": RecentSample,
    "bucket_window": BucketWindow,
    "two_sided": TwoSidedHinkley,
}


def register(name: str, kernel) -> None:
    """Add a detector class with ``reach``, ``cold``, ``run`` and ``settles``."""
    DETECTORS[name] = kernel
