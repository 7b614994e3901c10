"""Arithmetic, rounding, and validation columns. All are built-in expressions and stay within code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def let(value: Column, body) -> Column:
    """body(value) with value in the expression once, however often body uses it: nested steps do not multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pmod(a, b) -> Column:
    """The remainder in [0, |b|) whatever the signs."""
    return F.pmod(col(a), F.abs(col(b)))


def fmod(a, b: float) -> Column:
    """The remainder in [0, |b|) of doubles by a floor, as SQL engines agree on it."""
    a, b = col(a), abs(b)
    return a - F.floor(a / b) * F.lit(float(b))


def clamp(v, low, high) -> Column:
    """v within [low, high]; NaN gives low."""
    v, low, high = col(v), col(low), col(high)
    return F.when(F.isnan(v) | (v < low), low).when(v > high, high).otherwise(v)


def lerp(a, b, t) -> Column:
    a, b = col(a), col(b)
    return a + (b - a) * col(t)


def remap(v, from_low, from_high, to_low, to_high) -> Column:
    v, a, b, c, d = map(col, (v, from_low, from_high, to_low, to_high))
    return c + (v - a) / (b - a) * (d - c)


def fract(v) -> Column:
    return col(v) - F.floor(col(v))


def smoothstep(low, high, v) -> Column:
    low, high = col(low), col(high)
    t = clamp((col(v) - low) / (high - low), F.lit(0.0), F.lit(1.0))
    return t * t * (F.lit(3.0) - t * 2.0)


def round_whole(v) -> Column:
    """The nearest whole number, ties away from zero."""
    v = col(v)
    return F.signum(v) * F.floor(F.abs(v) + 0.5)


def round_decimals(v, digits: int) -> Column:
    """Rounded to decimals, ties away from zero, a tie missed by a rounding error included."""
    v, s = col(v), 10.0**digits
    return F.signum(v) * F.floor(F.abs(v) * s + 0.5 + 1e-9) / s


def two_sum(a, b) -> Column:
    """struct(sum, error): a + b without loss."""
    a, b = col(a), col(b)
    s = a + b
    bb = s - a
    return F.struct(s.alias("sum"), ((a - (s - bb)) + (b - bb)).alias("error"))


def two_product(a, b) -> Column:
    """struct(product, error): a * b without loss, by splitting the factors."""

    def halves(x: Column) -> tuple[Column, Column]:
        t = x * F.lit(134217729.0)
        hi = t - (t - x)
        return hi, x - hi

    a, b = col(a), col(b)
    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    return F.struct(p.alias("product"), (al * bl - (((p - ah * bh) - al * bh) - ah * bl)).alias("error"))


def signed(v, bits: int) -> Column:
    """The low bits of a whole number as two's complement."""
    v = col(v).cast("long").bitwiseAND(F.lit((1 << bits) - 1))
    return F.when(v >= (1 << (bits - 1)), v - (1 << bits)).otherwise(v)


def near(a, b, absolute: float = 1e-12, relative: float = 1e-12) -> Column:
    a, b = col(a), col(b)
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.greatest(F.abs(a), F.abs(b)) * relative)


def horner(x, coefficients: list[float]) -> Column:
    """c0 + x (c1 + x (c2 + ...))."""
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * col(x) + F.lit(float(c))
    return out


def finite(v) -> Column:
    """v, or null where it is NaN or infinite."""
    v = col(v)
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def require(condition: Column, value, message: str) -> Column:
    """value where the condition holds; else the row fails with the message."""
    return F.when(condition, col(value)).otherwise(F.raise_error(F.lit(message)).cast("double"))


def require_finite(v) -> Column:
    return require(finite(v).isNotNull(), v, "value must be finite")


def require_range(v, low: float, high: float) -> Column:
    return require(finite(v).isNotNull() & col(v).between(low, high), v, f"value must be within {low} and {high}")


def require_positive(v) -> Column:
    return require(finite(v).isNotNull() & (col(v) > 0), v, "value must be positive")


# ---- arrays ----------------------------------------------------------------------------------------------------------


def is_number_array(df, column: str) -> bool:
    """Whether a column holds arrays of numbers."""
    from pyspark.sql import types as T

    t = df.schema[column].dataType
    return isinstance(t, T.ArrayType) and isinstance(t.elementType, T.NumericType)


def binary_search(values, key, steps: int = 31) -> Column:
    """The place, from 0, of a key in a sorted array without repeats; -(insertion place + 1) where it is not there.

    By halving steps over the array's places, up to 2 ** steps of them.
    """
    a, k = col(values), col(key)
    n = F.size(a)

    def step(at: Column, by: Column) -> Column:
        return F.when((at + by <= n) & (F.get(a, (at + by - 1).cast("int")) < k), at + by).otherwise(at)

    low = F.aggregate(F.array(*(F.lit(1 << i).cast("long") for i in reversed(range(steps)))), F.lit(0).cast("long"), step)
    return let(low, lambda i: F.when(F.get(a, i.cast("int")) == k, i).otherwise(-(i + 1)))


def count_below(values, key, bits: int) -> Column:
    """How many of a sorted array's values, fewer than 2 ** bits, are less than a key."""
    a, k = col(values), col(key)
    return F.aggregate(F.array(*(F.lit(1 << i) for i in reversed(range(bits)))), F.lit(0), lambda n, by: n + F.when(F.get(a, n + by - 1) < k, by).otherwise(0))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cross(a, b) -> Column:
    a, b = col(a), col(b)
    return F.array(*(a[i] * b[j] - a[j] * b[i] for i, j in ((1, 2), (2, 0), (0, 1))))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def angle_between(a, b) -> Column:
    """The angle of two vectors, well behaved also where it is near 0 or pi."""
    return F.atan2(norm(cross(a, b)), dot(a, b))


def rotate_about(v, axis, angle) -> Column:
    """A vector turned about a unit axis by an angle, counterclockwise seen from its tip."""
    v, k, t = col(v), col(axis), col(angle)
    c, s, d = F.cos(t), F.sin(t), dot(k, v)
    x = cross(k, v)
    return F.array(*(v[i] * c + x[i] * s + k[i] * d * (F.lit(1.0) - c) for i in range(3)))


def solve3(m, y) -> Column:
    """The solution of three linear equations, rows of m against y; null where they have none or many."""
    m, y = col(m), col(y)
    det = dot(m[0], cross(m[1], m[2]))
    columns = [F.array(*(m[i][j] for i in range(3))) for j in range(3)]

    def with_(j: int) -> Column:
        c = [y if k == j else columns[k] for k in range(3)]
        return dot(c[0], cross(c[1], c[2])) / det

    return F.when(F.abs(det) > 1e-300, F.array(*(with_(j) for j in range(3))))
