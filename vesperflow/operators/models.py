"""Least squares by groups: weighted, ridge, robust reweighting, and the models built on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesperflow.session import materialize


def least_squares(a: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, ridge: float = 0.0) -> np.ndarray:
    """Coefficients that minimise the weighted squares plus ridge times the coefficients' squares."""
    s = np.ones(len(y)) if w is None else np.sqrt(w)
    if ridge:
        a, y, s = np.vstack([a, np.sqrt(ridge) * np.eye(a.shape[1])]), np.append(y, np.zeros(a.shape[1])), np.append(s, np.ones(a.shape[1]))
    return np.linalg.lstsq(a * s[:, None], y * s, rcond=None)[0]


def robust_least_squares(a: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, method: str = "huber", iterations: int = 50, tolerance: float = 1e-9, ridge: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, weights) by reweighting with Huber or Tukey weights of residuals in units of their scaled MAD."""
    base = np.ones(len(y)) if w is None else np.asarray(w, float)
    k = np.ones(len(y))
    x = least_squares(a, y, base, ridge)
    for _ in range(iterations):
        e = y - a @ x
        scale = 1.482602218505602 * np.median(np.abs(e - np.median(e)))
        if scale <= 1e-15:
            break
        u = np.abs(e) / scale
        new = np.minimum(1, 1.345 / np.maximum(u, 1e-15)) if method == "huber" else np.where(u < 4.685, (1 - (u / 4.685) ** 2) ** 2, 0)
        z = least_squares(a, y, base * new, ridge)
        done = np.abs(z - x).max() <= tolerance * max(1, np.abs(x).max()) and np.abs(new - k).max() <= 1e-6
        x, k = z, new
        if done:
            break
    return x, k


def fit_groups(df: DataFrame, by: str, terms: dict, y: str, weight: str | None = None, method: str | None = "huber", ridge: float = 0.0) -> DataFrame:
    """(by, coefficients map<string,double>, rms, n): y as a sum of terms (name to Column) for each group.

    The design columns are made by the engine; a group's rows, one model's samples, are solved by one task.
    """
    names = list(terms)
    kind = df.schema[by].dataType.simpleString()
    d = df.select(F.col(by), F.col(y).cast("double").alias("_y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"), *(c.cast("double").alias(f"_{i}") for i, c in enumerate(terms.values())))

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        a, t, w = p[[f"_{i}" for i in range(len(names))]].to_numpy(), p["_y"].to_numpy(), p["_w"].to_numpy()
        x = robust_least_squares(a, t, w, method, ridge=ridge)[0] if method else least_squares(a, t, w, ridge)
        return pd.DataFrame({by: [p[by].iloc[0]], "coefficients": [dict(zip(names, map(float, x), strict=True))], "rms": [float(np.sqrt(np.mean((t - a @ x) ** 2)))], "n": [len(p)]})

    return d.groupBy(by).applyInPandas(fit, f"{by} {kind}, coefficients map<string,double>, rms double, n long")


def fit_sums(df: DataFrame, by: list[str], terms: dict, y: str, weight: str | None = None, ridge: float = 0.0) -> DataFrame:
    """(by, coefficients map<string,double>, n): y as a sum of terms by weighted least squares, for groups of any size.

    Products of terms are summed, with partial sums through the exchange; what is left of a group, a matrix of its
    terms, is solved in Arrow batches. Normal equations: terms should be of about one size.
    """
    names = list(terms)
    w = (F.col(weight) if weight else F.lit(1.0)).cast("double")
    d = df.select(*by, w.alias("_w"), F.col(y).cast("double").alias("_y"), *(c.cast("double").alias(f"_{i}") for i, c in enumerate(terms.values())))
    n = len(names)
    upper = [(i, j) for i in range(n) for j in range(i, n)]
    s = d.groupBy(*by).agg(F.count("*").alias("n"), F.array(*(F.sum(F.col("_w") * F.col(f"_{i}") * F.col(f"_{j}")) for i, j in upper)).alias("_a"), F.array(*(F.sum(F.col("_w") * F.col(f"_{i}") * F.col("_y")) for i in range(n))).alias("_b"))

    @F.pandas_udf("map<string,double>")
    def solve(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for u, v in zip(a, b, strict=True):
            m = np.zeros((n, n))
            for (i, j), z in zip(upper, u, strict=True):
                m[i, j] = m[j, i] = z
            x = np.linalg.lstsq(m + ridge * np.eye(n), np.asarray(v, float), rcond=None)[0]
            out.append(dict(zip(names, map(float, x), strict=True)))
        return pd.Series(out)

    return s.select(*by, solve("_a", "_b").alias("coefficients"), "n")


def fit_robust_sums(df: DataFrame, by: list[str], terms: dict, y: str, weight: str | None = None, method: str = "huber", rounds: int = 8, ridge: float = 0.0) -> DataFrame:
    """(by, coefficients map<string,double>, rms, n): as `fit_groups`, for groups of any size.

    Each round takes the scale from a sketch of the residuals' sizes (to a thousandth of the ranks) and sums reweighted
    products, both with partial results through the exchange; between rounds only the coefficients are stored. Rounds
    are fixed: Huber's and Tukey's weights settle in a few.
    """
    w0 = (F.col(weight) if weight else F.lit(1.0)).cast("double")
    d = df.select(*by, F.col(y).cast("double").alias("_y"), w0.alias("_w0"), *(c.cast("double").alias(f"_t{i}") for i, c in enumerate(terms.values())))
    own = {n: F.col(f"_t{i}") for i, n in enumerate(terms)}
    now = materialize(fit_sums(d, by, own, "_y", "_w0", ridge), "coefficients")

    def residual(rows: DataFrame) -> DataFrame:
        e = F.col("_y") - sum((F.element_at("coefficients", n) * c for n, c in own.items()), F.lit(0.0))
        return rows.join(now.select(*by, "coefficients"), by).withColumn("_e", e)

    for _ in range(rounds):
        rows = residual(d)
        middle = rows.groupBy(*by).agg(F.percentile_approx("_e", 0.5, 1000).alias("_m"))
        scale = rows.join(middle, by).groupBy(*by).agg((F.percentile_approx(F.abs(F.col("_e") - F.col("_m")), 0.5, 1000) * 1.482602218505602).alias("_s"))
        u = F.abs("_e") / F.when(F.col("_s") > 1e-15, F.col("_s"))
        k = F.least(F.lit(1.0), F.lit(1.345) / F.greatest(u, F.lit(1e-15))) if method == "huber" else F.when(u < 4.685, F.pow(F.lit(1.0) - F.pow(u / 4.685, 2), 2)).otherwise(0.0)
        again = rows.join(scale, by).withColumn("_w", F.col("_w0") * F.coalesce(k, F.lit(1.0)))
        now = materialize(fit_sums(again, by, own, "_y", "_w", ridge), "coefficients")
    fit = residual(d).groupBy(*by).agg(F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rms"))
    return now.join(fit, by).select(*by, "coefficients", "rms", "n")


def leverage(a: np.ndarray, w: np.ndarray | None = None, ridge: float = 0.0) -> np.ndarray:
    """How much each row of a design draws the fit to itself: the diagonal of the hat matrix."""
    x = a if w is None else a * np.sqrt(w)[:, None]
    return np.einsum("ij,jk,ik->i", x, np.linalg.pinv(x.T @ x + ridge * np.eye(a.shape[1])), x)


def pointing_terms(hour_angle: str = "ha", dec: str = "decl", latitude: float = 0.0) -> dict:
    """Terms of the hour-angle error of an equatorial mount: index, collimation, axes, polar azimuth and altitude, flexure."""
    import math

    h, d = F.col(hour_angle), F.col(dec)
    return {"IH": F.lit(1.0), "CH": F.lit(1.0) / F.cos(d), "NP": F.tan(d), "MA": -F.cos(h) * F.tan(d), "ME": F.sin(h) * F.tan(d), "TF": F.sin(h) * math.cos(latitude) / F.cos(d)}


def apply_model(coefficients, terms: dict):
    """The model's value as a column, from a map of coefficients."""
    return sum((F.coalesce(F.element_at(coefficients, n), F.lit(0.0)) * c for n, c in terms.items()), F.lit(0.0))


def polynomial_surface(x: str = "x", y: str = "y", degree: int = 2) -> dict:
    return {f"x{i}y{j}": F.pow(F.col(x), F.lit(float(i))) * F.pow(F.col(y), F.lit(float(j))) for i in range(degree + 1) for j in range(degree + 1 - i)}
