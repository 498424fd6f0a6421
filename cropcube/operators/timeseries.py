"""Operators over one pixel's series: smoothing, spline interpolation, features.

A series is as long as a pixel has dates; each is one array, so these operators shuffle once, by pixel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropcube.session import ship


def gaussian_weights(sigma: float = 2.0, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def as_arrays(df: DataFrame, by: list[str], time: str = "time", value: str = "value") -> DataFrame:
    """(by..., s): a series' (time, value) in order of time, without missing values."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("v")))).alias("s"))


def smoothed(series: str = "s", sigma: float = 2.0) -> Column:
    """Gaussian mean over neighbouring samples (by place, not by days); the ends are mirrored with their own sample."""
    w = gaussian_weights(sigma)
    r = len(w) // 2
    weights = "array(" + ", ".join(f"{x!r}D" for x in w) + ")"
    # mirrored place of i + k - r in a series of n: m = pmod(., 2n), n - 1 - (m - n) from n on
    return F.expr(
        f"transform({series}, (p, i) -> named_struct('t', p.t, 'v', aggregate(transform({weights}, (w, k) -> w * {series}[cast(if(pmod(i + k - {r}, 2 * size({series})) >= size({series}),"
        f" 2 * size({series}) - 1 - pmod(i + k - {r}, 2 * size({series})), pmod(i + k - {r}, 2 * size({series}))) as int)].v), 0D, (a, x) -> a + x)))"
    )


def knot_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes at the knots of the cubic spline with not-a-knot ends; a line through 2 knots, a parabola through 3."""
    n = len(x)
    h = np.diff(x)
    m = np.diff(y) / h
    if n == 2:
        return np.array([m[0], m[0]])
    if n == 3:
        c = (m[1] - m[0]) / (x[2] - x[0])
        return np.array([m[0] - c * h[0], m[0] + c * h[0], m[1] + c * h[1]])
    a, b, c, d = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)  # lower, diagonal, upper, right side
    a[1:-1], c[1:-1] = h[1:], h[:-1]
    b[1:-1] = 2 * (h[:-1] + h[1:])
    d[1:-1] = 3 * (h[1:] * m[:-1] + h[:-1] * m[1:])
    s, e = x[2] - x[0], x[-1] - x[-3]
    b[0], c[0], d[0] = h[1], s, ((h[0] + 2 * s) * h[1] * m[0] + h[0] ** 2 * m[1]) / s
    a[-1], b[-1], d[-1] = e, h[-2], (h[-1] ** 2 * m[-2] + (2 * e + h[-1]) * h[-2] * m[-1]) / e
    for i in range(1, n):
        f = a[i] / b[i - 1]
        b[i] -= f * c[i - 1]
        d[i] -= f * d[i - 1]
    out = np.empty(n)
    out[-1] = d[-1] / b[-1]
    for i in range(n - 2, -1, -1):
        out[i] = (d[i] - c[i] * out[i + 1]) / b[i]
    return out


def polynomial_at(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and first derivative of the polynomial through all knots, Lagrange's sums term by term: what the spline is for up to 4 knots.

    Products of whole days are exact, so a result half way between two roundings is not moved by a solver's errors.
    """
    value, slope = np.zeros(len(at)), np.zeros(len(at))
    for i in range(len(x)):
        rest = [j for j in range(len(x)) if j != i]
        share, whole, sums = np.ones(len(at)), 1.0, np.zeros(len(at))
        for j in rest:
            share = share * ((at - x[j]) / (x[i] - x[j]))
            whole *= x[i] - x[j]
            product = np.ones(len(at))
            for k in rest:
                if k != j:
                    product = product * (at - x[k])
            sums = sums + product
        value = value + y[i] * share
        slope = slope + y[i] * sums / whole
    return value, slope


def spline_at(x: np.ndarray, y: np.ndarray, at: np.ndarray, terms: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Value and first derivative at days ``at``; NaN outside the knots, for fewer than 2 knots and for a day that is there twice.

    Up to ``terms`` knots (4 at most) they are summed as ``polynomial_at`` does.
    """
    none = np.full(len(at), np.nan)
    if len(x) < 2 or (np.diff(x) <= 0).any():
        return none, none
    inside = (at >= x[0]) & (at <= x[-1])
    if len(x) <= terms:
        return tuple(np.where(inside, p, np.nan) for p in polynomial_at(x, y, at))
    s = knot_slopes(x, y)
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    h = x[i + 1] - x[i]
    u = (at - x[i]) / h
    value = (1 + 2 * u) * (1 - u) ** 2 * y[i] + u * (1 - u) ** 2 * h * s[i] + u**2 * (3 - 2 * u) * y[i + 1] + u**2 * (u - 1) * h * s[i + 1]
    slope = 6 * u * (u - 1) / h * (y[i] - y[i + 1]) + (1 - u) * (1 - 3 * u) * s[i] + u * (3 * u - 2) * s[i + 1]
    return np.where(inside, value, np.nan), np.where(inside, slope, np.nan)


def interpolated(series: DataFrame, targets: Column, s: str = "s", terms: int = 0) -> DataFrame:
    """``series`` (from ``as_arrays``) with a row for each target date: ``time``, ``value`` and ``slope`` of one spline fit.

    ``targets`` is an array of dates, ``terms`` as in ``spline_at``. One Arrow pass computes both.
    """
    ship(series.sparkSession)

    @F.pandas_udf("array<struct<value: double, slope: double>>")
    def fit(days: pd.Series, values: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for d, v, t in zip(days, values, at, strict=True):
            a, b = spline_at(np.asarray(d, float), np.asarray(v, float), np.asarray(t, float), terms)
            out.append([{"value": None if np.isnan(p) else float(p), "slope": None if np.isnan(q) else float(q)} for p, q in zip(a, b, strict=True)])
        return pd.Series(out)

    zero = F.lit("1970-01-01").cast("date")
    day = lambda x: F.datediff(x, zero)
    df = series.withColumn("cc_at", targets)
    df = df.withColumn("cc_fit", fit(F.transform(s, lambda p: day(p["t"])), F.transform(s, lambda p: p["v"]), F.transform("cc_at", day)))
    df = df.withColumn("cc_row", F.explode(F.arrays_zip("cc_at", "cc_fit")))
    return df.select(*series.columns, F.col("cc_row.cc_at").alias("time"), F.col("cc_row.cc_fit.value").alias("value"), F.col("cc_row.cc_fit.slope").alias("slope"))


def features(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Amplitude, maximum, median, minimum, deviation (of the population) and mean of every series."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(
        ((F.max(v) - F.min(v)) / 2).alias("amplitude"),
        F.max(v).alias("maximum"),
        F.expr(f"percentile({value}, 0.5D)").alias("median"),
        F.min(v).alias("minimum"),
        F.stddev_pop(v).alias("std"),
        F.avg(v).alias("weighted_average"),
    )


def features_ext(series: DataFrame, by: list[str], s: str = "s") -> DataFrame:
    """From arrays: share beyond one deviation, steepest slope, median absolute deviation, share close to the median, skew."""
    v = f"transform({s}, p -> p.v)"
    median = "({0}[cast((size({0}) - 1) div 2 as int)] + {0}[cast(size({0}) div 2 as int)]) / 2D"
    df = series.withColumn("v", F.expr(v)).withColumn("o", F.sort_array("v")).withColumn("n", F.size("v").cast("double"))
    df = df.withColumn("mean", F.expr("aggregate(v, 0D, (a, x) -> a + x) / n"))
    # one pass with a running mean, and the mean of cubes over the cube of the deviation: what a series of two values has
    # at one deviation, and the sign of a skew of zero, hang on the last bit
    step = "named_struct('n', a.n + 1D, 'm', a.m + (x - a.m) / (a.n + 1D), 'd', a.d + (x - (a.m + (x - a.m) / (a.n + 1D))) * (x - a.m))"
    df = df.withColumn("sd", F.expr(f"aggregate(v, named_struct('n', 0D, 'm', 0D, 'd', 0D), (a, x) -> {step}, a -> sqrt(a.d / a.n))"))
    df = df.withColumn("m3", F.expr("aggregate(v, 0D, (a, x) -> a + power(x - mean, 3D)) / n"))
    df = df.withColumn("median", F.expr(median.format("o"))).withColumn("d", F.expr("sort_array(transform(v, x -> abs(x - median)))"))
    df = df.withColumn("amplitude", F.expr("(array_max(v) - array_min(v)) / 2D"))
    steps = f"transform(sequence(1, size({s}) - 1), i -> abs(({s}[i].v - {s}[i - 1].v) / datediff({s}[i].t, {s}[i - 1].t)))"
    return df.select(
        *by,
        F.expr("size(filter(v, x -> abs(x - mean) > sd)) / n").alias("percent_beyond_1_std"),
        F.expr(f"if(size({s}) > 1, array_max({steps}), NULL)").alias("max_slope"),
        F.expr(median.format("d")).alias("median_absolute_deviation"),
        F.expr("size(filter(v, x -> abs(x - median) < 0.1D * amplitude)) / n").alias("percent_close_to_median"),
        F.expr("if(sd > 0, m3 / power(sd, 3D), NULL)").alias("skew"),
    )


def speckle_filtered(df: DataFrame, by_time: list[str], place: list[str], local: str, value: str) -> DataFrame:
    """Multi-temporal filter: a date's local mean times the mean over dates of value / local mean at the place."""
    from pyspark.sql import Window

    ratio = F.try_divide(F.col(value), F.col(local))
    return df.withColumn("filtered", F.col(local) * F.avg(ratio).over(Window.partitionBy(*place)))
