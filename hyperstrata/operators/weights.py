"""Weights: sharpening, robust norms, tapers, and roots of quadratics as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperstrata.functions.header import Header
from hyperstrata.operators.grid import Grid, index_grid
from hyperstrata.operators.rank import kth_smallest

_EPS = 1.1920928955078125e-07  # the spacing of single-precision floats at 1
HUGE = 3.4028234663852886e38  # stands for "no solution"


def sharpen(grid: Grid, percent: float = 50.0, factor: float = 0.5) -> Grid:
    """Samples times w**2, w = exp(-factor q**2 / (|v| + least)**2).

    q is the order statistic of |v| at ``percent``, raised to the first that is over the
    rounding error of the largest. An empty grid stays empty.
    """
    size = grid.df.agg(F.count("v").alias("n"), F.max(F.abs("v")).alias("most")).first()
    if not size["n"]:
        return grid
    values, least = grid.df.select(F.abs("v").alias("v")), _EPS * size["most"]
    k = max(0, min(int(size["n"] * percent * 0.01), size["n"] - 2))
    q = kth_smallest(values, "v", k)
    if q <= least:  # the first greater one, if any
        q = values.where(F.col("v") > least).agg(F.min("v")).first()[0] or q
    w = F.exp(F.lit(-factor * q * q) / F.pow(F.abs("v") + F.lit(least), F.lit(2.0)))
    return grid.with_v(F.coalesce(F.col("v") * w * w, F.lit(0.0)))


def robust_weights(grid: Grid, norm: str = "l1") -> Grid:
    """Weights of residuals for reweighted least squares: norms ``l1`` and ``cauchy``, scaled by the median of |v|."""
    n = grid.df.count()
    if not n:
        return grid
    median = kth_smallest(grid.df.select(F.abs("v").alias("v")), "v", n // 2)
    h = F.hypot(F.lit(1.0), F.col("v") / F.lit(median))
    return grid.with_v(1 / F.sqrt(h) if norm == "l1" else 1 / h)


def tent(spark: SparkSession, header: Header) -> Grid:
    """A window of raised cosines along every axis longer than one sample."""
    w: Column = F.lit(1.0)
    for k, a in enumerate(header.axes, 1):
        if a.n > 1:
            w = w * F.greatest(F.lit(0.0), 0.5 * (1 - F.cos(F.lit(2 * math.pi) * (F.col(f"i{k}") + 1) / F.lit(a.n + 1.0))))
    return Grid(index_grid(spark, header).withColumn("v", w), header)


def smallest_root(a: Column, b: Column, c: Column) -> Column:
    """The smallest positive root of a x**2 + 2 b x + c, or HUGE."""
    d = b * b - a * c
    root = F.sqrt(F.greatest(d, F.lit(0.0))) + F.abs(b)
    linear = (F.abs(c) < _EPS) & (((b > _EPS) & (a < -_EPS)) | ((b < -_EPS) & (a > _EPS)))
    return (
        F.when(linear, F.try_divide(-2 * b, a))
        .when(d < 0, F.lit(HUGE))
        .when((b * c <= 0) & (root > _EPS) & (F.abs(c) > 0), F.try_divide(F.abs(c), root))
        .when((b * c > 0) & (b * a <= 0) & (F.abs(a) > _EPS) & (root > 0), F.try_divide(root, F.abs(a)))
        .otherwise(F.lit(HUGE))
    )


def weighted_components(grid: Grid, weights: DataFrame, axis: int) -> Grid:
    """Sum over an axis of samples times their weights: a table of the grid's indices and ``w``."""
    keep = grid.others(axis)
    df = grid.df.join(weights, grid.indices).groupBy(*keep).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    names = [F.col(c).alias(f"i{k}") for k, c in enumerate(keep, 1)]
    return Grid(df.select(*names, "v"), Header(tuple(grid.axis(int(c[1:])) for c in keep)))
