"""Interpolation, slices, moveout and sums along trajectories, read from lines at computed indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis
from hyperstrata.operators.grid import Grid, every, sample


def linear(knots: DataFrame, by: list[str], x: str, v: str, axis: Axis) -> DataFrame:
    """by, i1, v: values on a regular axis by linear interpolation between knots.

    The first value is held before the first knot and the last after the last. Each
    knot makes the outputs up to the next knot, so there is no range join.
    """
    w = Window.partitionBy(*by).orderBy(x)
    o, d, n = F.lit(float(axis.o)), F.lit(float(axis.d)), axis.n
    rows = knots.select(*by, F.col(x).cast("double").alias("_x"), F.col(v).cast("double").alias("_v"))
    w = Window.partitionBy(*by).orderBy("_x", "_v")
    rows = rows.withColumns({"_nx": F.lead("_x").over(w), "_nv": F.lead("_v").over(w), "_first": F.lag("_x").over(w).isNull()})
    start = F.when(F.col("_first"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil((F.col("_x") - o) / d)))
    stop = F.when(F.col("_nx").isNull(), F.lit(n - 1)).otherwise(F.least(F.lit(n - 1), F.ceil((F.col("_nx") - o) / d) - 1))
    rows = rows.withColumns({"_a": start.cast("long"), "_b": stop.cast("long")}).where("_a <= _b")
    out = rows.withColumn("i1", F.explode(F.sequence("_a", "_b")))
    at = o + F.col("i1") * d
    slope = F.try_divide(F.col("_nv") - F.col("_v"), F.col("_nx") - F.col("_x"))
    value = F.when((at <= F.col("_x")) | F.col("_nx").isNull(), F.col("_v")).otherwise(F.col("_v") + (at - F.col("_x")) * F.coalesce(slope, F.lit(0.0)))
    return out.select(*by, "i1", value.alias("v"))


def at_positions(grid: Grid, targets: DataFrame, position: str, keys: list[str], outside: float = 0.0) -> DataFrame:
    """targets with v: grid values between floor and floor + 1 of a fractional index of axis 1."""
    p = F.col(position)
    base = F.floor(p).cast("long")
    ends = targets.withColumn("_ends", F.array(F.struct(base.alias("i1"), (F.lit(1.0) - (p - F.floor(p))).alias("_w")), F.struct((base + 1).alias("i1"), (p - F.floor(p)).alias("_w"))))
    spread = ends.select(*targets.columns, F.inline("_ends")).join(grid.df.select("i1", *keys, "v"), ["i1", *keys], "left")
    total = F.sum(F.coalesce(F.col("v"), F.lit(outside)) * F.col("_w"))
    return spread.groupBy(*targets.columns).agg(total.alias("v"))


def slice_at(grid: Grid, picks: DataFrame, axis: int = 2) -> DataFrame:
    """For each line, the value at a picked fractional index of ``axis``; 0 outside.

    ``picks``: the other indices and ``pick``.
    """
    keys = grid.others(axis)
    p, n = F.col("pick"), grid.axis(axis).n
    base = F.floor(p).cast("long")
    part = p - F.floor(p)
    ends = picks.select(*keys, "pick", F.inline(F.array(F.struct(base.alias(f"i{axis}"), (F.lit(1.0) - part).alias("_w")), F.struct((base + 1).alias(f"i{axis}"), part.alias("_w")))))
    found = ends.join(grid.df, [f"i{axis}", *keys], "left")
    inside = (p >= 0) & (p <= n - 1)
    return found.groupBy(*keys, "pick").agg(F.sum(F.coalesce("v", F.lit(0.0)) * F.col("_w")).alias("v")).select(*keys, F.when(inside, F.col("v")).otherwise(0.0).alias("v"))


def remapped(grid: Grid, position: Column, axis: int = 1, n: int | None = None, along: bool = False) -> Grid:
    """New lines of ``n`` samples: the value at a fractional input index given for each output index.

    ``position`` is an expression of the output indices (columns i1, i2, ...); it may hold
    windows along the lines if ``along`` says so. 0 outside. A line is an array that its
    outputs are read from, so only whole lines are shuffled, if any.
    """
    i, keys, n_in = f"i{axis}", grid.others(axis), grid.axis(axis).n
    n = n or n_in
    lines, p = grid.dense(axis), F.col("_p")
    if along:
        places = lines.select(*keys).distinct().withColumn(i, every(n)).withColumn("_p", position.cast("double"))
        places = places.groupBy(*keys).agg(F.collect_list(F.struct(i, "_p")).alias("_places"))
        # the hint keeps the lines from being broadcast by way of the driver
        outs = places.hint("merge").join(lines, keys, "left").select(*keys, "trace", F.inline("_places")) if keys else places.crossJoin(lines).select("trace", F.inline("_places"))
    else:
        outs = lines.withColumn(i, every(n)).withColumn("_p", position.cast("double"))
    value = F.when((p >= 0) & (p <= n_in - 1), sample(F.col("trace"), p))
    return Grid(outs.select(*grid.indices, F.coalesce(value, F.lit(0.0)).alias("v")), grid.header.with_axis(axis, n=n))


def nmo(grid: Grid, offset: Column, velocity: Column | float, stretch_mute: float | None = None) -> Grid:
    """Normal moveout: out(t0) = in(sqrt(t0**2 + (offset / velocity)**2)).

    ``offset`` and ``velocity`` may use the output indices. With ``stretch_mute``,
    samples stretched by more than that factor are 0.
    """
    a = grid.axis(1)
    velocity = velocity if isinstance(velocity, Column) else F.lit(float(velocity))
    t0 = F.lit(float(a.o)) + F.col("i1") * F.lit(float(a.d))
    t = F.sqrt(t0 * t0 + (offset / velocity) * (offset / velocity))
    p = (t - F.lit(float(a.o))) / F.lit(float(a.d))
    if stretch_mute is not None:
        p = F.when(t <= t0 * F.lit(stretch_mute), p).otherwise(F.lit(-1.0))
    return remapped(grid, p)


def inverse_nmo(grid: Grid, offset: Column, velocity: float) -> Grid:
    """out(t) = in(sqrt(t**2 - (offset / velocity)**2)), 0 before the curve."""
    a = grid.axis(1)
    t = F.lit(float(a.o)) + F.col("i1") * F.lit(float(a.d))
    square = t * t - (offset / F.lit(velocity)) * (offset / F.lit(velocity))
    return remapped(grid, F.when(square >= 0, (F.sqrt(F.greatest(square, F.lit(0.0))) - F.lit(float(a.o))) / F.lit(float(a.d))).otherwise(F.lit(-1.0)))


def stretch(grid: Grid, rule: str, n: int, o: float, d: float) -> Grid:
    """Resample axis 1 on a regular axis of its logarithm, square, or root."""
    a = grid.axis(1)
    y = F.lit(float(o)) + F.col("i1") * F.lit(float(d))
    t = {"log": F.exp(y), "t2": F.sqrt(F.greatest(y, F.lit(0.0))), "sqrt": y * y}[rule]
    out = remapped(grid, (t - F.lit(float(a.o))) / F.lit(float(a.d)), n=n)
    return Grid(out.df, out.header.with_axis(1, o=o, d=d))


def trajectory_sum(grid: Grid, parameter: Axis, moveout, normalise: bool = False, semblance: bool = False) -> Grid:
    """Sum a panel (i1: time, i2: offset) along curves t(t0, x, p), one for each parameter.

    ``moveout(t0, x, p)`` is a column. Every output sample asks for the input sample
    nearest its curve, read from its line, then a sum over offsets that is
    pre-aggregated. Without a panel index i3 there is one panel.
    """
    a, extra = grid.axis(1), grid.others(1, 2)
    outs = grid.dense().withColumn("_x", grid.x(2)).withColumn("_k", every(parameter.n)).withColumn("_t0", every(a.n))
    p = F.lit(float(parameter.o)) + F.col("_k") * F.lit(float(parameter.d))
    t0 = F.lit(float(a.o)) + F.col("_t0") * F.lit(float(a.d))
    index = F.floor(F.lit(0.5) + (moveout(t0, F.col("_x"), p) - F.lit(float(a.o))) / F.lit(float(a.d))).cast("long")
    # samples asked for outside are null, so that every output has its group
    hit = outs.select("_t0", "_k", *extra, "trace", index.alias("_j")).select("_t0", "_k", *extra, F.when((F.col("_j") >= 0) & (F.col("_j") < a.n), F.get("trace", F.col("_j").cast("int"))).alias("v"))
    total, square, live = F.sum("v"), F.sum(F.col("v") * F.col("v")), F.sum((F.col("v") != 0).cast("double"))
    value = F.try_divide(total * total, live * square) if semblance else (F.try_divide(total, live) if normalise else total)
    sums = hit.groupBy("_t0", "_k", *extra).agg(F.coalesce(value, F.lit(0.0)).alias("v"))
    df = sums.select(F.col("_t0").alias("i1"), F.col("_k").alias("i2"), *extra, "v")
    return Grid(df, grid.header.with_axis(2, n=parameter.n, o=parameter.o, d=parameter.d))


def slant_stack(grid: Grid, slopes: Axis) -> Grid:
    """Sums along t = tau + p x."""
    return trajectory_sum(grid, slopes, lambda t0, x, p: t0 + p * x)


def velocity_scan(grid: Grid, velocities: Axis, semblance: bool = True) -> Grid:
    """Semblance (or sums) along t = sqrt(t0**2 + (x / v)**2)."""
    return trajectory_sum(grid, velocities, lambda t0, x, p: F.sqrt(t0 * t0 + (x / p) * (x / p)), semblance=semblance)


def linear_moveout(grid: Grid, velocity: float) -> Grid:
    """out(t) = in(t + x / velocity) for offsets x on axis 2; 0 outside."""
    a = grid.axis(1)
    return remapped(grid, F.col("i1") + grid.x(2) / F.lit(float(velocity) * float(a.d)))
