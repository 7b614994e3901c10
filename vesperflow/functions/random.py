"""Seeded 32-bit generators, distributions of their numbers, seeded orders.

The generators are published algorithms and give the same numbers everywhere. Those that count can be asked for any
number of a sequence by a column; the others run in batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vesperflow.functions.mathx import col, let

_M32 = 0xFFFFFFFF


def _times(a: Column, b: int | Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, by halves of the second."""
    b = col(b).cast("long")
    low, high = b.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(b, 16)
    return (a * low + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_M32))


def _mixed(z: Column, shift: int) -> Column:
    return z.bitwiseXOR(F.shiftrightunsigned(z, shift))


def mulberry32_at(seed, i) -> Column:
    """Number i, from 1, of the generator of that name, in [0, 1)."""
    state = (col(seed).cast("long") + _times(col(i).cast("long"), 0x6D2B79F5)).bitwiseAND(F.lit(_M32))
    first = lambda z: _times(_mixed(z, 15), z.bitwiseOR(F.lit(1)))
    second = lambda z: z.bitwiseXOR((z + _times(_mixed(z, 7), z.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(_M32)))
    return let(let(let(state, first), second), lambda z: _mixed(z, 14)) / 4294967296.0


def splitmix32_at(seed, i) -> Column:
    """Number i, from 1, of the generator of that name, in [0, 1)."""
    state = (col(seed).cast("long") + _times(col(i).cast("long"), 0x9E3779B9)).bitwiseAND(F.lit(_M32))
    a = let(state, lambda z: _times(_mixed(z, 16), 0x21F0AAAD))
    b = let(a, lambda z: _times(_mixed(z, 15), 0x735A2D97))
    return let(b, lambda z: _mixed(z, 15)) / 4294967296.0


def xorshift32(seed: int, n: int) -> np.ndarray:
    """The first n numbers of the generator of that name; a seed of 0 stands for a fixed other one."""
    s, out = (seed & _M32) or 0x6D2B79F5, np.empty(n)
    for k in range(n):
        s ^= (s << 13) & _M32
        s ^= s >> 17
        s ^= (s << 5) & _M32
        out[k] = s
    return out / 4294967296.0


def sfc32(seed: int, n: int) -> np.ndarray:
    """The first n numbers of the small fast counter, its state the first four of splitmix32."""

    def split(z: int) -> int:
        z = ((z ^ z >> 16) * 0x21F0AAAD) & _M32
        z = ((z ^ z >> 15) * 0x735A2D97) & _M32
        return z ^ z >> 15

    a, b, c, d = (split((seed + 0x9E3779B9 * k) & _M32) for k in (1, 2, 3, 4))
    out = np.empty(n)
    for k in range(n):
        t = (a + b + d) & _M32
        a, b, c, d = b ^ b >> 9, (c + (c << 3)) & _M32, ((c << 21 | c >> 11) + t) & _M32, (d + 1) & _M32
        out[k] = t
    return out / 4294967296.0


def mt19937(seed: int, n: int) -> np.ndarray:
    """The first n numbers of the Mersenne Twister, seeded as its authors' init does."""
    return np.random.RandomState(seed & _M32).randint(0, 1 << 32, n, dtype=np.uint64).astype(float) / 4294967296.0


GENERATORS = {"xorshift32": xorshift32, "sfc32": sfc32, "mt19937": mt19937}


def draw(kind: str, seed, n: int) -> Column:
    """The first n numbers of a generator for each seed, as an array."""
    f = GENERATORS[kind]

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else f(int(v), n).tolist())

    return run(col(seed).cast("long"))


# ---- distributions: of a uniform number u in [0, 1) -----------------------------------------------------------------


def _tail(u) -> Column:
    return -F.log1p(-col(u))


def uniform(u, low: float = 0.0, high: float = 1.0) -> Column:
    return col(u) * (high - low) + low


def bernoulli(u, p: float = 0.5) -> Column:
    return F.when(col(u) < p, 1).otherwise(0)


def exponential(u, rate: float = 1.0) -> Column:
    return _tail(u) / rate if rate > 0 else F.lit(0.0)


def weibull(u, scale: float, shape: float) -> Column:
    return F.pow(_tail(u), F.lit(1 / shape)) * scale if scale > 0 and shape > 0 else F.lit(0.0)


def geometric(u, p: float = 0.5) -> Column:
    """The trials up to the first success."""
    return F.lit(1.0) if p >= 1 else F.lit(float("inf")) if p <= 0 else F.floor(-_tail(u) / math.log1p(-p)) + F.lit(1.0)


def pareto(u, alpha: float = 1.0) -> Column:
    return F.exp(_tail(u) / alpha) if alpha > 0 else F.lit(float("inf"))


def rayleigh(u, sigma: float = 1.0) -> Column:
    return F.sqrt(_tail(u)) * (math.sqrt(2) * sigma) if sigma > 0 else F.lit(0.0)


def cauchy(u, centre: float = 0.0, scale: float = 1.0) -> Column:
    return F.tan((F.greatest(col(u), F.lit(5e-324)) - 0.5) * math.pi) * scale + centre if scale > 0 else F.lit(centre)


def triangular(u, low: float = 0.0, high: float = 1.0, mode: float | None = None) -> Column:
    low, high = min(low, high), max(low, high)
    if high <= low:
        return F.lit(low)
    mode = (low + high) / 2 if mode is None else max(low, min(mode, high))
    return F.when(col(u) < (mode - low) / (high - low), F.sqrt(col(u) * ((high - low) * (mode - low))) + low).otherwise(F.lit(high) - F.sqrt((F.lit(1.0) - col(u)) * ((high - low) * (high - mode))))


def normal(u, v, mean: float = 0.0, sigma: float = 1.0) -> Column:
    """A normal number of two uniform ones, by their polar form."""
    return F.sqrt(F.log(F.greatest(col(u), F.lit(5e-324))) * -2) * F.cos(col(v) * (2 * math.pi)) * sigma + mean


def log_normal(u, v, mean: float = 0.0, sigma: float = 1.0) -> Column:
    return F.exp(normal(u, v, mean, sigma))


def shuffle_key(seed: int, key) -> Column:
    """What to order rows by for a seeded shuffle: the same for a seed and key wherever a row lies."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), col(key).cast("string")))
