"""Configuration grids and the detector studies built on them."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators.aggregates import blocks, robust_baseline
from tidemark.operators.detectors.linked import detect
from tidemark.operators.evaluate import score
from tidemark.operators.ordered import Series, largest_key
from tidemark.operators.smoothers import boundaries

# fixed values: the three grids of the detector study
SPLIT_GRID = {"delta": [1e-4, 1e-5, 1e-6, 1e-7], "min_window": [200, 400, 600, 1000],
              "cooldown": [200, 500, 1000], "max_window": [2000, 5000]}
BLOCK_GRID = {"size": [50, 100, 200, 500], "k_thr": [5, 10, 20, 30, 50], "k_delta": [0.5, 1.0, 2.0]}
RECENT_GRID = {"alpha": [0.001, 1e-4, 1e-5], "window_size": [200, 500, 1000], "stat_size": [50, 100]}
ROBZ = ("robz", {"w": 200})


def combos(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def split_configs(grid: dict[str, list] = SPLIT_GRID, detector: str = "mean_split", smoother=ROBZ) -> list[dict]:
    return [{"cfg": f"A_d{c['delta']:.0e}_mw{c['min_window']}_cd{c['cooldown']}_xw{c['max_window']}",
             "detector": detector, "smoother": smoother, **c} for c in combos(grid)]


def recent_configs(grid: dict[str, list] = RECENT_GRID, smoother=None) -> list[dict]:
    return [{"cfg": f"C_a{c['alpha']:.0e}_ws{c['window_size']}_ss{c['stat_size']}", "detector": "recent_sample",
             "smoother": smoother or ("none", {}), **c} for c in combos(grid)]


def _times_mad(k: float):
    return lambda facts: k * float(facts["mad"])


def _share(part: int, least: int):
    return lambda facts: max(least, int(facts["n_base"]) // part)


def hinkley_configs(k_thr: list[float], k_delta: list[float], min_instances=600, cooldown=200, prefix: str = "PH", smoother=None) -> list[dict]:
    """Page-Hinkley with limits in units of the baseline deviation of the series."""
    return [{"cfg": f"{prefix}_K{k}_d{d}", "detector": "page_hinkley", "threshold": _times_mad(k), "delta": _times_mad(d),
             "min_instances": min_instances, "cooldown": cooldown, "smoother": smoother or ("none", {})}
            for k, d in product(k_thr, k_delta)]


def with_baseline(s: Series, value: str, base: int, least: int = 100, period: str = "year") -> Series:
    """The series with its baseline deviation (``mad``) and baseline size on every row."""
    stats = session.cut(robust_baseline(s.df, s.keys, value, F.col(period) == base, least))
    return s.using(s.df.join(stats.select(*s.keys, "mad", "n_base"), s.keys))


def block_series(s: Series, value: str, size: int, trim: float = 0.0) -> Series:
    b = session.cut(blocks(s, value, size, trim))
    count, longest = largest_key(b, s.keys)
    return Series(b, s.keys, "block", count, longest)


def block_hinkley(s: Series, value: str, size: int, k_thr: list[float], k_delta: list[float], base: int, trim: float = 0.0) -> tuple[DataFrame, Series, list[str]]:
    """Page-Hinkley over block means; alarms carry the block and its centre row."""
    b = with_baseline(block_series(s, value, size, trim), "block_mean", base, least=5)
    configs = hinkley_configs(k_thr, k_delta, _share(5, 3), _share(20, 2), prefix=f"B_N{size}")
    hits = detect(b, "block_mean", configs, facts=["mad", "n_base"])
    dated = hits.join(b.df.select(*s.keys, "block", "centre", "year"), [*s.keys, "block"])
    return dated.withColumnRenamed("centre", s.idx), b, [c["cfg"] for c in configs]


def block_study(s: Series, value: str, grid: dict[str, list], base: int, post: list[int]) -> DataFrame:
    """Metrics of the block grid, with rows counted in whole blocks."""
    bounds = boundaries(s, "year")
    out = None
    for size in grid["size"]:
        dated, _, names = block_hinkley(s, value, size, grid["k_thr"], grid["k_delta"], base)
        part = score(dated, bounds, s.keys, names, base, post, per=size).withColumn("size", F.lit(size))
        out = part if out is None else out.unionByName(part)
    return out


# the smoothers of the first study: name -> (kind, numbers)
SMOOTHER_SWEEP = {
    "ctrl": ("none", {}),
    **{f"sma_w{w:03d}": ("sma", {"w": w}) for w in (20, 50, 100, 200, 500)},
    **{f"med_w{w:03d}": ("med", {"w": w}) for w in (20, 50, 100, 200)},
    **{f"ewma_a{a}": ("ewma", {"alpha": a}) for a in (0.01, 0.05, 0.1, 0.2, 0.3)},
    **{f"holt_a{a}_b{b}": ("holt", {"alpha": a, "beta": b}) for a in (0.05, 0.1) for b in (0.01, 0.05)},
    "savgol_w51_p3": ("savgol", {"w": 51, "degree": 3}),
    **{f"robz_w{w}": ("robz", {"w": w}) for w in (200, 500)},
}


def smoother_study(s: Series, value: str, split: dict, hinkley: dict) -> tuple[DataFrame, list[str]]:
    """Both detectors on every smoothed form of every series, in one job.

    The signal is smoothed inside the task that runs the detectors, so the 22
    forms are never stored.
    """
    configs = []
    for name, sm in SMOOTHER_SWEEP.items():
        configs.append({"cfg": f"{name}/adwin", "detector": "mean_split", "smoother": sm, **split})
        configs.append({"cfg": f"{name}/ph", "detector": "page_hinkley", "smoother": sm, **hinkley})
    return detect(s, value, configs, facts=["mad"]), [c["cfg"] for c in configs]
