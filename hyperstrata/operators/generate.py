"""Generators: grids from ranges and index arithmetic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis, Header
from hyperstrata.operators.grid import Grid, index_grid


def spike(spark: SparkSession, header: Header, spikes: list[dict] | None = None) -> Grid:
    """Zeros with spikes: each has ``mag`` and, by axis, first and last 1-based places ``k`` and ``l``.

    An axis without a place is filled; without spikes the grid is all ones.
    """
    v = F.lit(0.0) if spikes else F.lit(1.0)
    for s in spikes or []:
        inside = F.lit(True)
        for axis, k in s.get("k", {}).items():
            if k:
                inside &= F.col(f"i{axis}").between(k - 1, s.get("l", {}).get(axis, k) - 1)
        v = v + F.when(inside, F.lit(float(s.get("mag", 1.0)))).otherwise(F.lit(0.0))
    return Grid(index_grid(spark, header).withColumn("v", v), header)


def math_grid(spark: SparkSession, header: Header, output: str) -> Grid:
    """An SQL expression of the coordinates x1, x2, ..."""
    empty = Grid(index_grid(spark, header).withColumn("v", F.lit(0.0)), header)
    from hyperstrata.operators.select import math

    return math(output, empty)


def noise(grid: Grid, seed: int, variance: float | None = None, spread: float | None = None, mean: float = 0.0, uniform: bool = False, replace: bool = False) -> Grid:
    """Add (or put) normal or uniform noise; for a seed the same on every run and layout.

    Two hashes of the indices make each number, so it depends on its place alone.
    """
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *grid.indices), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    if variance is None:
        variance = (spread or 1.0) ** 2 / (12.0 if uniform else 9.0)
    if uniform:
        value = F.lit(mean) + F.lit((12.0 * variance) ** 0.5) * (u(1) - 0.5)
    else:
        value = F.lit(mean) + F.lit(variance**0.5) * F.sqrt(F.lit(-2.0) * F.log(u(1))) * F.cos(F.lit(6.283185307179586) * u(2))
    return grid.with_v(value if replace else F.col("v") + value)


def mandelbrot(spark: SparkSession, header: Header, iterations: int) -> Grid:
    """Escape counts over the complex plane."""
    empty = Grid(index_grid(spark, header), header)
    points = empty.df.withColumns({"_x": empty.x(1), "_y": empty.x(2)})

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            c = np.asarray(batch.column(2)) + 1j * np.asarray(batch.column(3))
            z, count = np.zeros_like(c), np.zeros(len(c), "i8")
            for _ in range(iterations):
                live = np.abs(z) <= 2
                z[live] = z[live] ** 2 + c[live]
                count += live
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count.astype("f8"))], names=["i1", "i2", "v"])

    return Grid(points.select("i1", "i2", "_x", "_y").mapInArrow(run, "i1 long, i2 long, v double"), header)


def layered(spark: SparkSession, header: Header, interfaces: list[tuple[float, float]], velocities: list[tuple[float, float, float]], x0: float = 0.0) -> Grid:
    """A layered model: interface k at depth a + b (x - x0); layer k has v + dvdx (x - x0) + dvdz (z - z_k).

    A sample's layer is the number of interfaces at or above its depth.
    """
    empty = Grid(index_grid(spark, header), header)
    z, x = empty.x(1), empty.x(2) - F.lit(x0) if len(header.axes) > 1 else F.lit(0.0)
    a1 = header.axis(1)
    v = F.lit(velocities[0][0]) + x * F.lit(velocities[0][1]) + z * F.lit(velocities[0][2])
    for (a, b), (v0, dvdx, dvdz) in zip(interfaces, velocities[1:], strict=True):
        depth = F.lit(a) + x * F.lit(b)
        at = F.floor(F.lit(0.5) + (depth - F.lit(a1.o)) / F.lit(a1.d))
        v = F.when(F.col("i1") >= at, F.lit(v0) + x * F.lit(dvdx) + (z - depth) * F.lit(dvdz)).otherwise(v)
    return Grid(empty.df.withColumn("v", v), header)


def layered3(spark: SparkSession, header: Header, interfaces: list[tuple[float, float, float]], velocities: list[tuple[float, float, float, float]]) -> Grid:
    """The 3-D layered model: interfaces at a + b x + c y, layers v + dvdx x + dvdy y + dvdz (z - z_k)."""
    empty = Grid(index_grid(spark, header), header)
    a1, z, x, y = header.axis(1), empty.x(1), empty.x(2), empty.x(3)
    value = lambda v0, vx, vy, vz, top: F.lit(v0) + x * F.lit(vx) + y * F.lit(vy) + (z - top) * F.lit(vz)
    v = value(*velocities[0], F.lit(0.0))
    for (a, b, c), layer in zip(interfaces, velocities[1:], strict=True):
        depth = F.lit(a) + x * F.lit(b) + y * F.lit(c)
        v = F.when(F.col("i1") >= F.floor(F.lit(0.5) + (depth - F.lit(a1.o)) / F.lit(a1.d)), value(*layer, depth)).otherwise(v)
    return Grid(empty.df.withColumn("v", v), header)


def lorenz(spark: SparkSession, n: int, dt: float = 0.01, sigma: float = 10.0, rho: float = 28.0, beta: float = 8 / 3, start: tuple[float, float, float] = (3.051522, 1.582542, 15.62388)) -> Grid:
    """A path of the Lorenz system by the midpoint rule: axis 1 is (x, y, z), axis 2 time."""
    flow = lambda p: np.array([sigma * (p[1] - p[0]), p[0] * (rho - p[2]) - p[1], p[0] * p[1] - beta * p[2]])
    p, rows = np.array(start), []
    for i in range(n):
        rows += [(k, i, float(p[k])) for k in range(3)]
        p = p + dt * flow(p + 0.5 * dt * flow(p))
    return Grid(spark.createDataFrame(rows, "i1 long, i2 long, v double"), Header((Axis(3), Axis(n, 0.0, dt))))
