"""Smoother kernels on one stretch of a series.

``apply(kind, params, values, starts, stops)`` smooths an array; ``reach`` says
how many rows before (after) a stretch make the result equal to that of the
whole series.  Exponential smoothers forget geometrically: their reach is the
number of steps after which the weight of older rows is below double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd

FORGET = 40.0  # exp(-40) is far below the precision of a double


def moving_mean(x: np.ndarray, w: int) -> np.ndarray:
    return pd.Series(x).rolling(w, min_periods=1).mean().to_numpy()


def moving_median(x: np.ndarray, w: int) -> np.ndarray:
    return pd.Series(x).rolling(w, min_periods=1).median().to_numpy()


def robust_z(x: np.ndarray, w: int) -> np.ndarray:
    """Distance to the rolling median in units of the rolling deviation.

    Every row is compared with its own median before the second rolling median
    is taken; a deviation that is missing or zero counts as one.
    """
    need = max(1, w // 2)
    raw = pd.Series(x)
    centre = raw.rolling(w, min_periods=need).median()
    scale = (raw - centre).abs().rolling(w, min_periods=need).median()
    scale = scale.where(scale.notna() & (scale != 0.0), 1.0)
    return ((raw - centre) / scale).fillna(0.0).to_numpy()


def exponential(x: np.ndarray, alpha: float) -> np.ndarray:
    return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def holt(x: np.ndarray, alpha: float, beta: float) -> np.ndarray:
    """Level of a level-and-trend filter started from the first two rows."""
    out = np.array(x, dtype=float)
    if len(out) == 0:
        return out
    level = float(out[0])
    trend = float(out[1] - out[0]) if len(out) > 1 else 0.0
    for i in range(1, len(out)):
        ahead = level + trend
        fresh = ahead + alpha * (float(x[i]) - ahead)
        trend += beta * ((fresh - level) - trend)
        level = fresh
        out[i] = level
    return out


def polynomial_weights(w: int, degree: int) -> np.ndarray:
    """Row r: weights that give the least-squares polynomial at offset r of w rows."""
    t = np.arange(w, dtype=float) - (w - 1) / 2
    basis = np.vander(t / max(1.0, (w - 1) / 2), degree + 1, increasing=True)
    return basis @ np.linalg.pinv(basis)


def local_polynomial(x: np.ndarray, w: int, degree: int, starts: bool, stops: bool) -> np.ndarray:
    """Savitzky-Golay filter; the first and last half window use the edge fit."""
    n = len(x)
    w = min(w, n)
    w -= 1 - w % 2
    if w <= degree or w < 3:
        return np.array(x, dtype=float)
    table = polynomial_weights(w, degree)
    half = w // 2
    out = np.array(x, dtype=float)
    out[half:n - half] = np.convolve(x, table[half][::-1], mode="valid")
    if starts:
        out[:half] = table[:half] @ x[:w]
    if stops:
        out[n - half:] = table[half + 1:] @ x[n - w:]
    return out


def _holt_reach(alpha: float, beta: float) -> int:
    step = np.array([[1 - alpha, 1 - alpha], [-alpha * beta, 1 - alpha * beta]])
    radius = float(max(abs(np.linalg.eigvals(step))))
    # a repeated eigenvalue adds a linear factor, hence the margin
    return int(math.ceil(1.5 * FORGET / -math.log(radius)))


# kind -> (kernel, rows needed before, rows needed after)
SMOOTHERS: dict[str, tuple[Callable, Callable, Callable]] = {
    "none": (lambda x, p, a, b: np.array(x, dtype=float), lambda p: 0, lambda p: 0),
    "sma": (lambda x, p, a, b: moving_mean(x, p["w"]), lambda p: p["w"] - 1, lambda p: 0),
    "med": (lambda x, p, a, b: moving_median(x, p["w"]), lambda p: p["w"] - 1, lambda p: 0),
    "robz": (lambda x, p, a, b: robust_z(x, p["w"]), lambda p: 2 * (p["w"] - 1), lambda p: 0),
    "ewma": (lambda x, p, a, b: exponential(x, p["alpha"]),
             lambda p: int(math.ceil(FORGET / -math.log1p(-p["alpha"]))), lambda p: 0),
    "holt": (lambda x, p, a, b: holt(x, p["alpha"], p["beta"]),
             lambda p: _holt_reach(p["alpha"], p["beta"]), lambda p: 0),
    "savgol": (lambda x, p, a, b: local_polynomial(x, p["w"], p["degree"], a, b),
               lambda p: p["w"], lambda p: p["w"]),
}


def register(kind: str, kernel: Callable, before: Callable, after: Callable = lambda p: 0) -> None:
    """Add a smoother: kernel(values, params, starts, stops) and its reach."""
    SMOOTHERS[kind] = (kernel, before, after)


def apply(kind: str, params: dict, values: np.ndarray, starts: bool, stops: bool) -> np.ndarray:
    return SMOOTHERS[kind][0](np.asarray(values, dtype=float), params, starts, stops)


def reach(kind: str, params: dict) -> tuple[int, int]:
    _, before, after = SMOOTHERS[kind]
    return before(params), after(params)
