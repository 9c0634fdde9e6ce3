"""Velocity: constant-velocity stacks, velocity transforms, and closed-form profiles.

Every output sample asks for input samples on a curve, read from its line at computed
indices; products are summed before the shuffle. Samples between two others are taken
linearly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis, Header
from hyperstrata.operators.grid import Grid, every, index_grid, sample


def _asked(grid: Grid, parameter: Axis, time) -> DataFrame:
    """_t0, _k, the input's other indices and the value v of the input at ``time(t, x, p)``.

    ``x`` is the coordinate of axis 2, ``p`` that of the parameter; times outside the
    axis (and null ones) give null.
    """
    a, rest = grid.axis(1), grid.others(1)
    t, p = F.lit(float(a.o)) + F.col("_t0") * F.lit(float(a.d)), F.lit(float(parameter.o)) + F.col("_k") * F.lit(float(parameter.d))
    asked = grid.dense().withColumn("_x", grid.x(2)).withColumn("_k", every(parameter.n)).withColumn("_t0", every(a.n))
    asked = asked.select("_t0", "_k", *rest, "trace", ((time(t, F.col("_x"), p) - F.lit(float(a.o))) / F.lit(float(a.d))).alias("_p"))
    inside = (F.col("_p") >= 0) & (F.col("_p") <= a.n - 1)
    return asked.select("_t0", "_k", *rest, F.when(inside, sample(F.col("trace"), F.col("_p"))).alias("v"))


def _summed(grid: Grid, asked: DataFrame, value: Column, parameter: Axis) -> Grid:
    """``value`` of what every output asked for, 0 where that is null."""
    extra = grid.others(1, 2)
    sums = asked.groupBy("_t0", "_k", *extra).agg(F.coalesce(value, F.lit(0.0)).alias("v"))
    df = sums.select(F.col("_t0").alias("i1"), F.col("_k").alias("i2"), *extra, "v")
    return Grid(df, grid.header.with_axis(2, n=parameter.n, o=parameter.o, d=parameter.d))


def constant_velocity_stacks(grid: Grid, velocities: Axis, half: bool = False, slowness: bool = False, stretch: float | None = None) -> Grid:
    """For each velocity the normal-moveout corrected gather's mean over non-zero samples (i2: velocity).

    Axis 2 of the input is the offset (half of it with ``half``); with ``stretch``,
    samples stretched by more than that share are left out.
    """
    factor = 2.0 if half else 1.0

    def time(t, x, v):
        h = x * factor * v if slowness else x * factor / v
        curve = F.sqrt(t * t + h * h)
        return curve if stretch is None else F.when(curve <= t * F.lit(1 + stretch), curve)

    return _summed(grid, _asked(grid, velocities, time), F.avg(F.when(F.col("v") != 0, F.col("v"))), velocities)


def velocity_model(scan: Grid, offsets: Axis, half: bool = True, slowness: bool = False) -> Grid:
    """A gather (i2: offset) from a velocity scan (i2: velocity): each offset sums the scan's samples at sqrt(t**2 - (h / v)**2)."""
    factor = 2.0 if half else 1.0

    def time(t, v, x):
        h = x * factor * v if slowness else x * factor / v
        return F.when(t * t - h * h >= 0, F.sqrt(F.greatest(F.lit(0.0), t * t - h * h)))

    scale = F.lit(1.0 / (scan.axis(1).n * offsets.n))
    return _summed(scan, _asked(scan, offsets, time), F.sum("v") * scale, offsets)


def hyperbolic_radon(grid: Grid, slowness: Axis) -> Grid:
    """Sums of a gather along t = sqrt(z**2 + s x**2), s the squared slowness, each weighted by z / t**1.5.

    No antialiasing and no half-derivative.
    """
    z = F.lit(float(grid.axis(1).o)) + F.col("_t0") * F.lit(float(grid.axis(1).d))
    s = F.lit(float(slowness.o)) + F.col("_k") * F.lit(float(slowness.d))
    hit = _asked(grid, slowness, lambda t, x, p: F.when((t > 0) & (t * t + p * x * x > 0), F.sqrt(F.greatest(F.lit(0.0), t * t + p * x * x))))
    t = F.sqrt(z * z + s * grid.x(2) * grid.x(2))
    return _summed(grid, hit, F.sum(F.try_divide(F.col("v") * z, t * F.sqrt(t))), slowness)


def interval_profile(t: Column, v0: float = 1.5, alpha: float = 0.5) -> Column:
    """Velocity at vertical time t where velocity is linear in depth."""
    at = F.lit(alpha) * t
    return F.when(at > 0, F.lit(v0) * F.sqrt(F.try_divide(F.exp(at) - 1, at))).otherwise(F.lit(v0))


def slowness_gradient(spark: SparkSession, n: int, g: float = -6.0, v0: float = 4.0, s: float = 0.5) -> Grid:
    """Velocity and the two branches of the traveltime from a surface point (i3: 0, 1, 2) where squared slowness is v0 + g z.

    -1 where no ray arrives.
    """
    d, g = 0.5 / n, 0.5 * g
    z, x = F.col("i1") * F.lit(d), F.col("i2") * F.lit(d) - F.lit(s)
    v, r = F.lit(v0) + F.lit(g) * z, z * z + x * x
    square = v * v - F.lit(g * g) * r
    w = F.sqrt(F.greatest(square, F.lit(0.0)))
    times = [
        F.when(square >= 0, F.sqrt(2 * r / (v + w)) * (2 * v + w) / 3).otherwise(-1.0),
        F.when(square >= 0, F.sqrt(2 * (v + w) / F.lit(g * g)) * (2 * v - w) / 3).otherwise(-1.0),
    ]
    header = Header((Axis(n + 1, 0.0, d), Axis(3 * n + 1, 0.0, d), Axis(3)))
    df = index_grid(spark, header)
    return Grid(df.withColumn("v", F.when(F.col("i3") == 0, 1 / F.sqrt(v + F.lit(g) * z)).when(F.col("i3") == 1, times[0]).otherwise(times[1])), header)
