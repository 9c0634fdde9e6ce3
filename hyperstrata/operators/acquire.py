"""Acquisition: lost shots, strike lines, points for triangulation, samples at header coordinates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis, Header
from hyperstrata.operators import resample
from hyperstrata.operators.grid import Grid, index_grid


def lost_shots(spark: SparkSession, midpoints: int, offsets: int, share: float = 0.75, seed: int = 2003) -> Grid:
    """1 where the shot of a midpoint (i1) and half-offset (i2) is kept, 0 where it is lost.

    A shot is kept if its draw, a hash of its number and the seed, is over ``share``.
    """
    shot = F.col("i1") - F.col("i2") + F.lit(offsets - 1)
    draw = F.pmod(F.xxhash64(shot, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    header = Header((Axis(midpoints), Axis(offsets)))
    return Grid(index_grid(spark, header).withColumn("v", (draw > share).cast("double")), header)


def strikes(spark: SparkSession, offsets: Axis, sources: Axis, every: tuple[int, int, int, int]) -> Grid:
    """0 on every so many-th offset, source, midpoint and receiver line, 1 elsewhere (i1: offset, i2: source)."""
    header = Header((offsets, sources))
    grid = Grid(index_grid(spark, header), header)
    h, s = grid.x(1), grid.x(2)
    mid = F.floor((s + h / 2 - F.lit(offsets.o / 2)) / F.lit(offsets.d / 2) + 0.5)
    receiver = F.floor((s + h - F.lit(sources.o + offsets.o)) / F.lit(float(offsets.d)) + 0.5)
    lines = [F.col("i1"), F.col("i2"), mid, receiver]
    on = F.lit(False)
    for place, step in zip(lines, every):
        on = on | (place % step == 0)
    return Grid(grid.df.withColumn("v", F.when(on, 0.0).otherwise(1.0)), header)


def thinned_points(points: DataFrame, x: str, y: str, priority: list[str], seed: int = 1) -> DataFrame:
    """One point of each place, the first by priority, in random order: a column ``place``, from a hash and the seed."""
    first = F.row_number().over(Window.partitionBy(x, y).orderBy(*priority))
    kept = points.withColumn("_n", first).where("_n = 1").drop("_n")
    return kept.withColumn("place", F.xxhash64(x, y, F.lit(seed)))


def sampled_at(grid: Grid, points: DataFrame, x: str, y: str, nearest: bool = False) -> DataFrame:
    """``points`` with v, the grid at their coordinates along axes 1 and 2: bilinear or nearest; 0 outside."""
    a, b = grid.axis(1), grid.axis(2)
    p = (F.col(x) - F.lit(float(a.o))) / F.lit(float(a.d))
    q = (F.col(y) - F.lit(float(b.o))) / F.lit(float(b.d))
    asked = points.withColumns({"_id": F.monotonically_increasing_id(), "_p": p, "_q": q})
    i, j = F.floor("_p").cast("long"), F.floor("_q").cast("long")
    f, g = F.col("_p") - i, F.col("_q") - j
    corner = lambda c, r, w: F.struct(c.alias("i1"), r.alias("i2"), w.alias("_w"))
    if nearest:
        ends = [corner(F.floor(F.col("_p") + 0.5).cast("long"), F.floor(F.col("_q") + 0.5).cast("long"), F.lit(1.0))]
    else:
        ends = [corner(i, j, (1 - f) * (1 - g)), corner(i + 1, j, f * (1 - g)), corner(i, j + 1, (1 - f) * g), corner(i + 1, j + 1, f * g)]
    hit = asked.select("_id", F.inline(F.array(*ends))).where("_w > 0").join(grid.df.select("i1", "i2", F.col("v").alias("_v")), ["i1", "i2"])
    sums = hit.groupBy("_id").agg(F.sum(F.col("_v") * F.col("_w")).alias("_v"))
    return asked.join(sums, "_id", "left").select(*points.columns, F.coalesce("_v", F.lit(0.0)).alias("v"))


def warped(grid: Grid, rule: str, n: int, inverse: bool = False, first: float | None = None) -> Grid:
    """Axis 1 on a regular axis of t**2 or log(t / first), or (``inverse``) back on n samples from t = first."""
    a = grid.axis(1)
    start = float(a.o) if first is None else float(first)
    if not inverse:
        low = max(start, float(a.d)) if rule == "log" else start
        top = float(a.o) + (a.n - 1) * float(a.d)
        span = (top * top - low * low) if rule == "t2" else math.log(top / low)
        d = span / (n - 1)
        y = F.col("i1") * F.lit(d)
        t = F.sqrt(F.lit(low * low) + y) if rule == "t2" else F.lit(low) * F.exp(y)
        out = resample.remapped(grid, F.least((t - F.lit(float(a.o))) / F.lit(float(a.d)), F.lit(a.n - 1.0)), n=n)
        return Grid(out.df, out.header.with_axis(1, o=low * low if rule == "t2" else 0.0, d=d))
    t = F.lit(start) + F.col("i1")
    y = t * t if rule == "t2" else F.log(t / F.lit(start))
    out = resample.remapped(grid, (y - F.lit(float(a.o))) / F.lit(float(a.d)), n=n)
    return Grid(out.df, out.header.with_axis(1, o=start, d=1.0))


def redatumed(grid: Grid, reference: DataFrame) -> Grid:
    """2 n - 1 samples around a reference time of each line: a table of the line's indices and ``ref``; 0 outside."""
    a = grid.axis(1)
    n = a.n
    lines = Grid(grid.df.join(reference, grid.others(1)), grid.header)
    shift = (F.col("ref") - F.lit(float(a.o))) / F.lit(float(a.d))
    # the input sample i stands at output place i - shift + n - 1; each output takes its two neighbours
    position = F.col("i1") - shift + F.lit(n - 1.0)
    low, part = F.ceil(position).cast("long"), F.ceil(position) - position
    ends = F.array(F.struct(low.alias("_o"), (1 - part).alias("_w")), F.struct((low - 1).alias("_o"), part.alias("_w")))
    asked = lines.df.select(*grid.others(1), "v", shift.alias("_s"), F.inline(ends)).where(f"_w > 0 and _o between 0 and {2 * n - 2}")
    f = F.col("_o") - F.lit(n - 1.0) + F.col("_s")
    sums = asked.where((f >= 0) & (f < n - 1)).groupBy(*grid.others(1), F.col("_o").alias("i1")).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))
    frame = reference.select(*grid.others(1)).withColumn("i1", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2 * n - 2).cast("long"))))
    df = frame.join(sums, grid.indices, "left").select(*grid.indices, F.coalesce("v", F.lit(0.0)).alias("v"))
    return Grid(df, grid.header.with_axis(1, n=2 * n - 1, o=-(n - 1) * float(a.d)))
