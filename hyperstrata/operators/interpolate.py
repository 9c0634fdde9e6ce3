"""Interpolation filters of four taps, in one and two dimensions, at any coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperstrata.operators.grid import Grid, every


def weights(kind: str, x: Column) -> list[Column]:
    """Weights of samples -1, 0, 1 and 2 for a place ``x`` (0 to 1) after sample 0.

    ``lagrange``: the cubic through all four; ``cubic``: cubic convolution;
    ``spline``: the cubic B-spline (of coefficients, not of data).
    """
    one, y = F.lit(1.0), F.lit(1.0) - x
    if kind == "lagrange":
        below, above = one + x, F.lit(2.0) - x
        return [-x * y * above / 6, below * y * above / 2, below * x * above / 2, -below * x * y / 6]
    if kind == "cubic":
        near = lambda t: (F.lit(1.5) * t - F.lit(2.5)) * t * t + one
        far = lambda t: ((F.lit(-0.5) * t + F.lit(2.5)) * t - F.lit(4.0)) * t + F.lit(2.0)
        return [far(one + x), near(x), near(y), far(F.lit(2.0) - x)]
    if kind == "spline":
        inner = lambda t: (F.lit(4.0) - F.lit(6.0) * t * t + F.lit(3.0) * t * t * t) / 6
        return [y * y * y / 6, inner(x), inner(y), x * x * x / 6]
    raise ValueError(f"no interpolation filter {kind}")


def _taps(kind: str, place: Column, name: str) -> Column:
    base = F.floor(place)
    return F.array(*[F.struct((base + k - 1).cast("long").alias(name), w.alias(f"_{name}")) for k, w in enumerate(weights(kind, place - base))])


def at_points(grid: Grid, points: DataFrame, x: str, kind: str, y: str | None = None) -> DataFrame:
    """points with v: the grid at fractional indices ``x`` (and ``y``) of axis 1 (and 2).

    Other axes of the grid are columns of the points. Taps outside the grid count 0; points
    need be different rows, and equal ones come back as one.
    """
    axes = {"i1": x} | ({"i2": y} if y else {})
    asked = points
    for name, place in axes.items():
        asked = asked.select(*asked.columns, F.inline(_taps(kind, F.col(place), name)))
    weight = F.col("_i1") * F.col("_i2") if y else F.col("_i1")
    found = asked.join(grid.df, grid.indices, "left").withColumn("_t", F.coalesce("v", F.lit(0.0)) * weight)
    return found.groupBy(*points.columns).agg(F.sum("_t").alias("v"))


def eno(grid: Grid, places: Column, n: int) -> Grid:
    """Lines of n samples, each on the parabola through its cell's ends and the neighbour that bends it less.

    ``places``: fractional indices of axis 1 as an expression of the output index (column
    i1); the cell of the first or last sample goes on beyond it. Ties take the neighbour before.
    """
    keys, size = grid.others(1), grid.axis(1).n
    outs = grid.dense().withColumn("i1", every(n)).withColumn("_p", places.cast("double"))
    outs = outs.withColumn("_cell", F.least(F.greatest(F.floor("_p"), F.lit(0)), F.lit(size - 2)).cast("int"))
    at = lambda k: F.get("trace", F.col("_cell") + k)
    outs = outs.select("i1", *keys, (F.col("_p") - F.col("_cell")).alias("_t"), *[at(k).alias(c) for k, c in enumerate(["_a", "_b", "_c", "_d"], -1)]).where("_c IS NOT NULL")
    before, after, t = F.col("_a") - 2 * F.col("_b") + F.col("_c"), F.col("_b") - 2 * F.col("_c") + F.col("_d"), F.col("_t")
    less = F.when(after.isNull() | (F.abs(before) <= F.abs(after)), before).otherwise(after)
    value = F.col("_b") + t * (F.col("_c") - F.col("_b")) + t * (t - 1) / 2 * F.coalesce(less, after, F.lit(0.0))
    return Grid(outs.select("i1", *keys, value.alias("v")), grid.header.with_axis(1, n=n))


def spline_values(grid: Grid, axes: tuple[int, ...] = (1,)) -> Grid:
    """Samples of cubic B-splines of given coefficients, mirrored about the end samples."""
    for axis in axes:
        w = grid.along(axis)
        before, after = F.lag("v").over(w), F.lead("v").over(w)
        side = F.coalesce(before, after, F.col("v")) + F.coalesce(after, before, F.col("v"))
        grid = grid.with_v((4 * F.col("v") + side) / 6)
    return grid


def spline_coefficients(grid: Grid) -> Grid:
    """Coefficients of the cubic B-spline through the samples of each line: the inverse of ``spline_values``."""
    import numpy as np

    from hyperstrata.operators import traces

    def kernel(x):
        n = len(x)
        if n < 2:
            return x
        off = np.full(n - 1, 1 / 6)
        upper, lower = off.copy(), off.copy()
        upper[0] = lower[-1] = 1 / 3
        return traces.tridiagonal(lower, np.full(n, 4 / 6), upper, x)

    return traces.apply(grid, kernel)
