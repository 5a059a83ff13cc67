"""Change points of aggregated series: kernel costs, segmentation, run lengths.

The series here are aggregates (one point per game, month, ...).  Segmentation
with a kernel cost looks at every pair of points, so its time grows with the
square of the length; its memory grows with the length only, because the costs
of all segments ending at a point follow from those ending one point earlier.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.detectors import kernels
from tidemark.operators.detectors.linked import detect
from tidemark.operators.ordered import Series, series


def _count_within(x: np.ndarray, d: float) -> int:
    """Pairs of a sorted array at a distance of at most d."""
    return int((np.searchsorted(x, x + d, side="right") - np.arange(len(x)) - 1).sum())


def _pair_rank(x: np.ndarray, rank: int) -> float:
    """The rank-th smallest pair distance of a sorted array (first is 1), by bisection."""
    low, high = 0.0, float(x[-1] - x[0])
    if _count_within(x, 0.0) >= rank:
        return 0.0
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if _count_within(x, mid) >= rank:
            high = mid
        else:
            low = mid
    return high


def median_gamma(values: np.ndarray, ruled: bool = False) -> float:
    """1/(2 median) of the positive squared distances, or 1/median of all of them."""
    x = np.sort(np.asarray(values, dtype=float))
    total = len(x) * (len(x) - 1) // 2
    skip = 0 if ruled else _count_within(x, 0.0) if len(x) else 0
    n = total - skip
    if n <= 0:
        return 1.0
    a, b = _pair_rank(x, skip + (n + 1) // 2), _pair_rank(x, skip + n // 2 + 1)
    middle = (a * a + b * b) / 2
    if middle == 0.0:
        return 1.0
    return 1.0 / middle if ruled else 1.0 / (2.0 * middle)


def ending_costs(x: np.ndarray, gamma: float, ruled: bool = False):
    """For e = 1, 2, ...: the cost of every segment [s, e), as an array over s."""
    inside = np.zeros(0)
    for e in range(len(x)):
        d = gamma * (x[e] - x[:e]) ** 2
        k = np.exp(-np.clip(d, 1e-2, 1e2)) if ruled else np.exp(-d)
        tail = np.cumsum(k[::-1])[::-1]
        inside = np.append(inside + 2.0 * tail + 1.0, 1.0)
        length = np.arange(e + 1, 0, -1)
        yield e + 1, length - inside / length


def best_breaks(x: np.ndarray, most: int, gamma: float, least: int = 2, ruled: bool = False) -> list[tuple[int, float, list[int]]]:
    """(number of breaks, cost, break positions) of the best segmentations."""
    n = len(x)
    best = np.full((most + 1, n + 1), np.inf)
    back = np.zeros((most + 1, n + 1), dtype=np.int64)
    for e, cost in ending_costs(x, gamma, ruled):
        cost = np.where(np.arange(e, 0, -1) >= least, cost, np.inf)
        best[0, e] = cost[0]
        for k in range(1, most + 1):
            through = best[k - 1, :e] + cost
            b = int(np.argmin(through))
            best[k, e], back[k, e] = through[b], b
    out = []
    for k in range(most + 1):
        if not np.isfinite(best[k, n]):
            break
        at, cuts = n, []
        for j in range(k, 0, -1):
            at = int(back[j, at])
            cuts.append(at)
        out.append((k, float(best[k, n]), cuts[::-1]))
    return out


def penalised_breaks(x: np.ndarray, penalties: list[float], gamma: float, least: int = 2, ruled: bool = False) -> list[list[int]]:
    """Break positions that minimise cost + penalty per segment, per penalty."""
    n, pen = len(x), np.asarray(penalties, dtype=float)
    best = np.full((len(pen), n + 1), np.inf)
    best[:, 0] = 0.0
    back = np.zeros((len(pen), n + 1), dtype=np.int64)
    for e, cost in ending_costs(x, gamma, ruled):
        cost = np.where(np.arange(e, 0, -1) >= least, cost, np.inf)
        through = best[:, :e] + cost[None, :] + pen[:, None]
        b = np.argmin(through, axis=1)
        best[:, e], back[:, e] = through[np.arange(len(pen)), b], b
    out = []
    for p in range(len(pen)):
        at, cuts = n, []
        while at > 0:
            at = int(back[p, at])
            cuts.append(at)
        out.append([c for c in cuts[::-1] if c > 0])
    return out


def _per_key(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    names = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf)
        for k, v in zip(keys, key):
            out[k] = v
        return out

    full = ", ".join(f"`{k}` {names[k]}" for k in keys) + ", " + schema
    return df.groupBy(*keys).applyInPandas(run, full)


def break_curve(df: DataFrame, keys: list[str], order: str, value: str, most: int = 10) -> DataFrame:
    """Best cost for 0..K breaks with the modified BIC, per aggregated series."""

    def curve(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(dtype=float)
        rows = best_breaks(x, most, median_gamma(x))
        n = len(x)
        return pd.DataFrame({
            "n_breaks": [r[0] for r in rows], "cost": [r[1] for r in rows],
            "m_bic": [r[1] + (3 * r[0] + 1) * math.log(n) for r in rows], "length": n, "breaks": [r[2] for r in rows]})

    return _per_key(df.select(*keys, order, value), keys, curve,
                    "n_breaks int, cost double, m_bic double, length bigint, breaks array<bigint>")


def chosen_breaks(curve: DataFrame, keys: list[str]) -> DataFrame:
    return curve.groupBy(*keys).agg(F.min_by("n_breaks", F.struct("m_bic", "n_breaks")).alias("best_k"))


def penalty_table(df: DataFrame, keys: list[str], order: str, value: str, penalties: list[float], factors: list[float]) -> DataFrame:
    """Number of breaks per penalty and kernel width factor."""

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(dtype=float)
        gamma, rows = median_gamma(x), []
        for f in factors:
            for p, cuts in zip(penalties, penalised_breaks(x, penalties, f * gamma)):
                rows.append((f, f * gamma, p, len(cuts), cuts))
        return pd.DataFrame(rows, columns=["factor", "gamma", "penalty", "n_breaks", "breaks"])

    return _per_key(df.select(*keys, order, value), keys, table,
                    "factor double, gamma double, penalty double, n_breaks int, breaks array<bigint>")


def segment_costs(df: DataFrame, keys: list[str], order: str, value: str, segment: str) -> DataFrame:
    """Kernel cost of given segments (consecutive rows with one segment label)."""

    def costs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        gamma, rows = median_gamma(pdf[value].to_numpy(dtype=float)), []
        for name, part in pdf.groupby(segment, sort=False):
            *_, (e, cost) = ending_costs(part[value].to_numpy(dtype=float), gamma)
            rows.append((name, e, float(cost[0])))
        return pd.DataFrame(rows, columns=[segment, "length", "cost"])

    kind = dict(df.dtypes)[segment]
    return _per_key(df.select(*keys, order, value, segment), keys, costs, f"`{segment}` {kind}, length bigint, cost double")


class RunLength:
    """Bayesian online change point detection; fires when the likely run collapses.

    The state holds the posterior over run lengths with the mean and scale of
    each, so it grows with the series: only for aggregated series.
    """

    settles = False

    @staticmethod
    def reach(p: dict) -> int:
        return 0

    @staticmethod
    def cold(p: dict) -> list[float]:
        return [0.0, 0.0, float(p["mu"]), float(p["beta"])]

    @classmethod
    def run(cls, p, state, pre, x, lead):
        m, n = (len(state) - 1) // 3, (len(state) - 1) // 3 + len(x)
        likely, mu0, k0, a0, b0 = int(state[0]), *(float(p[c]) for c in ("mu", "kappa", "alpha", "beta"))
        stay, change = math.log(1.0 - p["hazard"]), math.log(p["hazard"])
        gap, fired = int(p.get("min_gap", 3)), []
        # runs stand in the order of their starts, so that a new one is put behind the others and nothing moves
        logr, mu, beta = (np.concatenate([np.array(state[1 + k * m:1 + (k + 1) * m])[::-1], np.zeros(len(x))]) for k in range(3))
        logb, work, fit = np.log(np.where(beta > 0, beta, 1.0)), np.empty(n), np.empty(n)
        # what depends on the length of a run alone is found once for all rows, for the longest run first
        kappas = (k0 + np.arange(n))[::-1]
        powers, ratios = (2 * (a0 + np.arange(n) / 2.0)[::-1] + 1) / 2, 2 * (kappas + 1) / kappas
        norms = np.array([math.lgamma(q) - math.lgamma(q - 0.5) for q in powers]) - 0.5 * np.log(np.pi * ratios)
        for i, v in enumerate(x):
            k = m + i
            own = slice(n - k, n)
            w, f, r, b = work[:k], fit[:k], logr[:k], beta[:k]
            np.subtract(v, mu[:k], out=w)
            mu[:k] += w / (kappas[own] + 1)
            np.multiply(w, w, out=w)
            w /= ratios[own]
            np.log1p(np.divide(w, b, out=f), out=f)
            b += w  # the scale grows by the factor whose logarithm is f
            r += norms[own]
            r -= np.multiply(logb[:k], 0.5, out=w)
            r -= np.multiply(powers[own], f, out=w)
            logb[:k] += f
            top = r.max()
            np.exp(np.subtract(r, top, out=w), out=w)
            r += stay - (top + math.log(w.sum()))  # stay and change add up to one, so this is the sum behind them too
            logr[k], mu[k], beta[k], logb[k] = change, mu0, b0, math.log(b0)
            now = int(np.argmax(logr[k::-1]))  # the shortest of equally likely runs
            if now < likely and likely > gap:
                fired.append(i)
            likely = now
        return np.asarray(fired, dtype=np.int64), [float(likely), *(float(u) for part in (logr, mu, beta) for u in part[:n][::-1])]


kernels.register("run_length", RunLength)


def run_length_breaks(s: Series, value: str, hazard: float = 0.004, min_gap: int = 3) -> DataFrame:
    """Break positions; the prior is centred on the series itself."""
    stats = s.df.groupBy(*s.keys).agg(F.avg(value).alias("_mu"), F.var_pop(value).alias("_var"))
    wide = s.using(s.df.join(stats, s.keys))
    config = {"cfg": "bocpd", "detector": "run_length", "hazard": hazard, "min_gap": min_gap, "kappa": 1.0, "alpha": 1.0,
              "mu": lambda f: float(f["_mu"]), "beta": lambda f: max(float(f["_var"]), 1e-12)}
    return detect(wide, value, [config], facts=["_mu", "_var"]).drop("cfg")


def game_series(df: DataFrame, keys: list[str], value: str, period: str, game: str) -> Series:
    """Mean per game in order of period and game."""
    means = df.groupBy(*keys, period, game).agg(F.avg(value).alias("ade"))
    return series(means, keys, [period, game])


def game_alarms(s: Series, value: str, configs: list[dict], meta: list[str]) -> DataFrame:
    """Library detectors on a per-game series, with the game of each alarm."""
    hits = detect(s, value, configs)
    return hits.join(s.df.select(*s.keys, s.idx, value, *meta), [*s.keys, s.idx])


def break_periods(breaks: DataFrame, s: Series, period: str, idx: str = "idx") -> DataFrame:
    """The period in which each break falls, once per period."""
    return breaks.join(s.df.select(*s.keys, s.idx, period), [*s.keys, idx]).select(*s.keys, period).distinct()
