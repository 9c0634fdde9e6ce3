"""Reductions along an axis or over the whole grid. In folds, zero means missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperstrata.functions.header import Header
from hyperstrata.operators.grid import Grid


def _without(header: Header, axis: int) -> Header:
    axes = [a for k, a in enumerate(header.axes, 1) if k != axis]
    return Header(tuple(axes) if axes else (type(header.axes[0])(n=1),))


def _reduced(grid: Grid, axis: int, *values) -> Grid:
    keys = grid.others(axis)
    df = grid.df.groupBy(*keys).agg(*values) if keys else grid.df.agg(*values).withColumn("i1", F.lit(0).cast("long"))
    for k in range(axis + 1, grid.dims + 1):
        df = df.withColumnRenamed(f"i{k}", f"i{k - 1}")
    return Grid(df, _without(grid.header, axis))


def stack(grid: Grid, axis: int = 2, how: str = "mean") -> Grid:
    """sum, mean (over non-zero samples), rms, min, max or prod along an axis."""
    v = F.col("v").cast("double")
    live = F.when(v != 0, v)
    value = {
        "sum": F.sum(v),
        "mean": F.coalesce(F.avg(live), F.lit(0.0)),
        "rms": F.coalesce(F.sqrt(F.avg(live * live)), F.lit(0.0)),
        "min": F.min(v),
        "max": F.max(v),
        "prod": F.product(v),
    }[how]
    return _reduced(grid, axis, value.alias("v"))


def fold(grid: Grid, axis: int = 2) -> Grid:
    """The number of non-zero samples along an axis."""
    return _reduced(grid, axis, F.sum((F.col("v") != 0).cast("long")).alias("v"))


def semblance(grid: Grid, axis: int = 2) -> Grid:
    """Squared sum over fold times sum of squares, over non-zero samples."""
    v = F.col("v").cast("double")
    n = F.sum((v != 0).cast("double"))
    value = F.coalesce(F.try_divide(F.sum(v) * F.sum(v), n * F.sum(v * v)), F.lit(0.0))
    return _reduced(grid, axis, value.alias("v"))


def median(grid: Grid, axis: int = 2) -> Grid:
    """The middle sample, or the mean of the two middle ones."""
    return _reduced(grid, axis, F.median("v").alias("v"))


def attributes(df: DataFrame, column: str = "v") -> DataFrame:
    """Attributes of all samples in one row; variance divides by n - 1."""
    v = F.col(column).cast("double")
    return df.agg(
        F.avg(v).alias("mean"),
        F.sqrt(F.avg(v * v)).alias("rms"),
        F.sqrt(F.sum(v * v)).alias("norm2"),
        F.var_samp(v).alias("var"),
        F.stddev_samp(v).alias("std"),
        F.max(v).alias("max"),
        F.min(v).alias("min"),
        F.max(F.abs(v)).alias("amax"),
        F.count("*").alias("samples"),
        F.sum((v != 0).cast("long")).alias("nonzero"),
    )


def header_attributes(df: DataFrame, keys: list[str]) -> DataFrame:
    """key, minimum, maximum and mean of header keys, one row each."""
    wide = df.agg(*[f(k).cast("double").alias(f"{name}_{k}") for k in keys for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"min_{k}").alias("min"), F.col(f"max_{k}").alias("max"), F.col(f"mean_{k}").alias("mean")) for k in keys])
    return wide.select(F.inline(rows))


def line_fit(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least-squares intercept and slope of y against x for each group."""
    x_, y_ = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*by).agg(F.regr_intercept(y_, x_).alias("intercept"), F.regr_slope(y_, x_).alias("slope"))


def normalised_stack(df: DataFrame, by: list[str], v: str) -> DataFrame:
    """Signal-to-noise weights: squared mean over variance for each group (0 where it has none)."""
    x = F.col(v).cast("double")
    return df.groupBy(*by).agg(F.coalesce(F.try_divide(F.avg(x) * F.avg(x), F.var_samp(x)), F.lit(0.0)).alias("snr"))


def partial_sums(grid: Grid, axis: int, size: int) -> Grid:
    """Sums of every ``size`` neighbouring samples of an axis."""
    k = f"i{axis}"
    df = grid.df.withColumn(k, F.expr(f"{k} div {size}")).groupBy(*grid.indices).agg(F.sum("v").alias("v"))
    a = grid.axis(axis)
    return Grid(df, grid.header.with_axis(axis, n=None if a.n is None else -(-a.n // size), d=a.d * size))


def dot_by(grid_a: Grid, grid_b: Grid, axis: int) -> DataFrame:
    """Products of two grids summed along an axis."""
    from hyperstrata.operators.grid import inner

    return inner(grid_a, grid_b).groupBy(*grid_a.others(axis)).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def running_rank(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
