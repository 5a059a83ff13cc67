"""Hash draws that any engine with 64-bit integers and md5 repeats exactly.

Row sampling sorts by the first eight hex digits of an md5.  Replicates use a
quadratic congruence modulo a prime; ids are reduced first, so every product
stays below 2**63 whatever the size of an id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 2147483647


def row_hash(row_id: Column | str, seed: int | Column = 42) -> Column:
    """A whole number in [0, 2**32) for one row id."""
    c = F.col(row_id) if isinstance(row_id, str) else row_id
    s = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.conv(F.substring(F.md5(F.concat(c.cast("string"), F.lit(":"), s)), 1, 8), 16, 10).cast("bigint")


def row_hash_sql(row_id: str, seed: str = "42") -> str:
    return f"('0x' || substr(md5({row_id} || ':' || {seed}), 1, 8))::BIGINT"


def uniform(row_id: Column, rep: Column) -> Column:
    """A draw in [0, 1) for a row and a replicate, both whole numbers."""
    i, r = F.pmod(row_id.cast("bigint"), F.lit(PRIME)), rep.cast("bigint")
    a = (i * 48271 + r * 69621 + 12345) % PRIME
    b = (a * a + a * 48271 + r) % PRIME
    return ((b * b + i) % PRIME) / PRIME


def uniform_array(row_id: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """The same draws for arrays; ids are given modulo the prime."""
    a = (row_id * 48271 + rep * 69621 + 12345) % PRIME
    b = (a * a + a * 48271 + rep) % PRIME
    return ((b * b + row_id) % PRIME) / PRIME


def uniform_sql(row_id: str, rep: str) -> str:
    p = PRIME
    a = f"((({row_id}) * 48271 + ({rep}) * 69621 + 12345) % {p})"
    b = f"(({a} * {a} + {a} * 48271 + ({rep})) % {p})"
    return f"((({b} * {b} + ({row_id}) % {p}) % {p}) / {p})"


#: Rounds of a shuffle; every round sends about half of the positions to their partners.
ROUNDS = 24
_STRETCH = 1 << 13  # pairs of a round that are drawn at once


def mixed(i: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """The whole number below the prime that ``uniform`` divides."""
    i = i % PRIME
    a = (i * 48271 + rep * 69621 + 12345) % PRIME
    b = (a * a + a * 48271 + rep) % PRIME
    return (b * b + i) % PRIME


def mixed_sql(i: str, rep: str) -> str:
    p = PRIME
    a = f"((({i}) % {p} * 48271 + ({rep}) * 69621 + 12345) % {p})"
    b = f"(({a} * {a} + {a} * 48271 + ({rep})) % {p})"
    return f"(({b} * {b} + ({i}) % {p}) % {p})"


def shuffled_array(place: np.ndarray, size: np.ndarray, start: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """A bijection of the places 0 .. size - 1 for each ``start`` and replicate, computed place by place without a sort.

    In every round a place x has the partner (k - x) mod size, k being a draw of the round; one bit, drawn for the larger
    of the two, says whether both swap.
    """
    x = place
    for r in range(ROUNDS):
        y = (mixed(start * ROUNDS + r, rep * 2 + 1) - x) % size
        swap = mixed((start + np.maximum(x, y)) * ROUNDS + r, rep * 2)
        x = np.where(swap // 1024 % 2 == 1, y, x)
    return x


def shuffled(df: DataFrame, place: str, size: str, start: str, rep: str, into: str) -> DataFrame:
    """The same bijection as a column, in Arrow batches."""

    @F.pandas_udf("long")
    def places(p: pd.Series, n: pd.Series, s: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(shuffled_array(*(c.to_numpy(np.int64) for c in (p, n, s, r))))

    return df.withColumn(into, places(place, size, start, rep))


def shuffle_values(x: np.ndarray, start: int, rep: int) -> None:
    """Moves every value (a double) of x from its place to the one of ``shuffled_array``, in place and all at once.

    The partners of a stretch are a stretch in reverse, so a round reads in order and draws once for a pair. Products
    are folded at 31 bits as in ``poisson_array``.
    """
    bits, n = x.view(np.int64), len(x)
    down = np.arange(_STRETCH) * -ROUNDS
    scratch = np.empty((3, _STRETCH), np.int64)
    for r in range(ROUNDS):
        k = int(mixed(np.int64(start * ROUNDS + r), np.int64(rep * 2 + 1))) % n
        for low, high in ((0, k), (k + 1, n - 1)):
            half = (high - low + 1) // 2
            for a in range(0, half, _STRETCH):
                b = min(half, a + _STRETCH)
                i, c, spare = scratch[:, :b - a]
                np.add(down[:b - a], (start + high - a) * ROUNDS + r, out=i)  # the larger places of the pairs
                if (start + high - a + 1) * ROUNDS > PRIME:
                    np.remainder(i, PRIME, out=i)
                np.multiply(i, 48271, out=c)
                np.add(c, rep * 2 * 69621 + 12345, out=c)
                _fold(c, spare)
                np.add(c, 48271, out=spare)
                np.multiply(c, spare, out=c)
                np.add(c, rep * 2, out=c)
                _fold(c, spare)
                _fold(c, spare)
                np.multiply(c, c, out=c)
                np.add(c, i, out=c)
                _fold(c, spare)
                _fold(c, spare)
                np.add(c, 1, out=spare)
                np.right_shift(spare, 31, out=spare)
                np.add(c, spare, out=c)  # now exact in the lower 31 bits
                np.right_shift(c, 10, out=c)
                np.bitwise_and(c, 1, out=c)
                np.negative(c, out=c)
                first, second = bits[low + a:low + b], bits[high - b + 1:high - a + 1][::-1]
                np.bitwise_xor(first, second, out=spare)
                np.bitwise_and(spare, c, out=spare)
                np.bitwise_xor(first, spare, out=first)
                np.bitwise_xor(second, spare, out=second)


def shuffled_sql(source: str, name: str, place: str, size: str, start: str, rep: str, into: str) -> str:
    """The same as a chain of common table expressions ending in ``name``."""
    steps = [f"{name}_0 AS (SELECT *, {place} AS x_ FROM {source})"]
    for r in range(ROUNDS):
        k = mixed_sql(f"({start}) * {ROUNDS} + {r}", f"({rep}) * 2 + 1")
        swap = mixed_sql(f"(({start}) + greatest(x_, y_)) * {ROUNDS} + {r}", f"({rep}) * 2")
        steps.append(f"{name}_{r + 1} AS (SELECT * EXCLUDE (x_, y_), CASE WHEN {swap} // 1024 % 2 = 1 THEN y_ ELSE x_ END AS x_ "
                     f"FROM (SELECT *, (({k} - x_) % ({size}) + ({size})) % ({size}) AS y_ FROM {name}_{r}))")
    return ", ".join([*steps, f"{name} AS (SELECT * EXCLUDE (x_), x_ AS {into} FROM {name}_{ROUNDS})"])


# fixed values: cumulative probabilities of a Poisson variable with mean one, down to the resolution of a draw
POISSON_STEPS = [
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
    0.999998874797402, 0.9999998885745217, 0.9999999899522336, 0.9999999991683892,
]


def poisson_sql(u: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {u} >= {s} THEN 1 ELSE 0 END" for s in POISSON_STEPS) + ")"


def _poisson_bounds() -> np.ndarray:
    """The smallest numerators of a draw that reach the steps."""
    out = []
    for step in POISSON_STEPS:
        k = int(step * PRIME) - 2
        while k / PRIME < step:
            k += 1
        out.append(k)
    return np.array(out, np.int64)


_BOUNDS = _poisson_bounds()
_CELL = 19  # low bits of a numerator that its cell leaves out
_FIRST = np.arange((PRIME >> _CELL) + 1, dtype=np.int64) << _CELL
#: Count of every cell of numerators, -1 where a step falls inside the cell.
_COUNTS = np.where(np.searchsorted(_BOUNDS, _FIRST, "right") == np.searchsorted(_BOUNDS, _FIRST + (1 << _CELL) - 1, "right"),
                   np.searchsorted(_BOUNDS, _FIRST, "right"), -1).astype(float)


def _fold(x: np.ndarray, spare: np.ndarray) -> None:
    """A smaller number that is equal modulo the prime, which is 2**31 - 1; in place."""
    np.right_shift(x, 31, out=spare)
    np.bitwise_and(x, PRIME, out=x)
    np.add(x, spare, out=x)


def poisson_array(row_id: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """How often each row is drawn in each replicate (rows by replicates, as doubles): the steps that ``uniform`` reaches.

    The same draws as ``uniform_array`` without divisions: products are folded at 31 bits, and cells
    of equal counts are looked up. Blocks that fit the cache are quickest. Ids are given modulo the prime.
    """
    x = ((row_id * 48271 + 12345) % PRIME)[:, None] + rep * 69621 % PRIME
    spare = np.empty_like(x)
    _fold(x, spare)
    np.add(x, 48271, out=spare)
    np.multiply(x, spare, out=x)
    np.add(x, rep, out=x)
    _fold(x, spare)
    _fold(x, spare)
    np.multiply(x, x, out=x)
    np.add(x, row_id[:, None], out=x)
    _fold(x, spare)
    _fold(x, spare)
    x[x == PRIME] = 0
    np.right_shift(x, _CELL, out=spare)
    drawn = _COUNTS.take(spare)
    split = np.flatnonzero(drawn < 0)
    drawn.ravel()[split] = np.searchsorted(_BOUNDS, x.ravel()[split], "right")
    return drawn
