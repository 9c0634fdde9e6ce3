"""Moveout of gathers in offset, slope and angle, and fits of moveout.

Every correction is a position on an axis said as a column, so that resampling reads
each line at computed indices; what scatters samples instead of gathering them sums before
the shuffle. Positions outside the data give 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis
from hyperstrata.operators.grid import Grid
from hyperstrata.operators.resample import remapped
from hyperstrata.operators.seismic import warp


def moved(gather: Grid, time: Column, inverse: bool = False, along: bool = False) -> Grid:
    """out(t) = in(time(t)) along axis 1; the inverse puts each sample at its time (null: nowhere). ``along``: the time holds windows."""
    a = gather.axis(1)
    nowhere = F.lit(float(a.o) - 10 * float(a.d))
    time = F.coalesce(time, nowhere)
    if inverse:
        return warp(gather, gather.with_v(time), inverse=True)
    return remapped(gather, (time - F.lit(float(a.o))) / F.lit(float(a.d)), along=along)


def ellipse(gather: Grid, wx: Column, wy: Column, wxy: Column, half: bool = True, inverse: bool = False) -> Grid:
    """Moveout t**2 = t0**2 + wx x**2 + wy y**2 + 2 wxy x y of (time, x, y, ...); the squared slownesses may vary in time.

    With ``half`` the axes are half-offsets.
    """
    t0, scale = gather.x(1), F.lit(2.0 if half else 1.0)
    x, y = gather.x(2) * scale, gather.x(3) * scale
    square = t0 * t0 + wx * x * x + wy * y * y + F.lit(2.0) * wxy * x * y
    return moved(gather, F.when(square >= 0, F.sqrt(F.greatest(square, F.lit(0.0)))), inverse)


def slope_moveout(gather: Grid, velocity: Column, interval: bool = True, inverse: bool = False) -> Grid:
    """Moveout of (tau, p, ...): ellipses of an effective velocity, or the sums of those of interval velocities.

    Where a velocity is beyond the slope's critical one, its interval adds no time.
    """
    p = gather.x(2)
    part = F.lit(1.0) - p * p * velocity * velocity
    root = F.sqrt(F.greatest(part, F.lit(0.0)))
    if not interval:
        return moved(gather, F.when(part >= 0, root * gather.x(1)), inverse)
    a = gather.axis(1)
    before = Window.partitionBy(*gather.others(1)).orderBy("i1").rowsBetween(Window.unboundedPreceding, -1)
    return moved(gather, F.lit(float(a.o)) + F.coalesce(F.sum(root).over(before), F.lit(0.0)) * F.lit(float(a.d)), inverse, along=True)


def time_offset_slope(gather: Grid, velocity: Column) -> Grid:
    """Moveout of (time, offset, slope): out(t) = in(t + p x**2 / (x + t p v**2))."""
    t, x, p = gather.x(1), gather.x(2), gather.x(3)
    return moved(gather, t + F.coalesce(F.try_divide(p * x * x, x + t * p * velocity * velocity), F.lit(0.0)))


def _from_slope(gather: Grid, slope: Column) -> tuple[Column, Column, Column]:
    """(time, offset, apex part) of a sample with a local slope in samples per trace."""
    t, a2 = gather.x(1), gather.axis(2)
    h = gather.x(2) + F.lit(0.5 * float(a2.d))
    return t, h, t - slope * h * F.lit(float(gather.axis(1).d) / float(a2.d))


def slope_nmo(gather: Grid, slope: Column) -> Grid:
    """Moveout by local slopes alone: a sample goes to the root of t (t - p h); impossible slopes go nowhere."""
    t, _, apex = _from_slope(gather, slope)
    return moved(gather, F.when((apex >= 0) & (apex <= t), F.sqrt(F.greatest(t * apex, F.lit(0.0)))), inverse=True)


def slope_velocity(gather: Grid, slope: Column, eps: float = 2.0**-16) -> Grid:
    """The velocities that local slopes tell, at the times they are moved to."""
    t, h, apex = _from_slope(gather, slope)
    speed = h / F.sqrt(F.greatest(t * (t - apex), F.lit(0.0)) + F.lit(eps))
    return slope_nmo(gather.with_v(F.when((apex >= 0) & (apex <= t), speed).otherwise(0.0)), slope)


def lag_to_angle(gather: Grid, rule: str, angles: Axis, dip: Column, velocity: Column | None = None, ratio: Column | None = None) -> Grid:
    """Slant stacks (depth, slant, ...) of lags as angle gathers (degrees).

    ``time``: time lags of one wave; ``converted time`` and ``converted space``: lags of
    converted waves, ``ratio`` the P to S velocity ratio.
    """
    a2 = gather.axis(2)
    angle = F.radians(F.lit(float(angles.o)) + F.col("i2") * F.lit(float(angles.d)))
    along = F.sqrt(F.lit(1.0) + dip * dip)
    if rule == "time":
        slant = velocity * along / F.cos(angle)
    elif rule == "converted time":
        excess = (F.lit(1.0) - ratio) * (F.lit(1.0) - ratio) / (F.lit(4.0) * ratio)
        slant = velocity * along / F.sqrt(ratio * (F.cos(angle) * F.cos(angle) + excess))
    else:
        tan = F.tan(angle)
        below = tan * tan * (ratio - 1) * (ratio - 1) + (ratio + 1) * (ratio + 1)
        slant = (F.lit(4.0) * ratio * tan + dip * (ratio * ratio - 1) * (tan * tan + 1)) / below
    out = remapped(gather, (slant - F.lit(float(a2.o))) / F.lit(float(a2.d)), axis=2, n=angles.n)
    return Grid(out.df, out.header.with_axis(2, o=angles.o, d=angles.d))


def moveout_products(gather: Grid) -> DataFrame:
    """wx, wy, wxy: moveouts of (time, x, y, ...) times x**2, y**2 and 2 x y of full offsets, summed; the fit's adjoint."""
    x, y = gather.x(2) * 2, gather.x(3) * 2
    terms = {"wx": x * x, "wy": y * y, "wxy": 2 * x * y}
    return gather.df.groupBy("i1", *gather.others(1, 2, 3)).agg(*[F.sum(F.col("v") * c).alias(k) for k, c in terms.items()])


def isotropic_velocity(gather: Grid) -> DataFrame:
    """The squared velocity that fits t**2 - t0**2 of (time, x, y, ...) best; null where the fit is 0."""
    square = gather.x(2) * gather.x(2) + gather.x(3) * gather.x(3)
    return gather.df.groupBy("i1", *gather.others(1, 2, 3)).agg(F.try_divide(F.sum(square * square), F.sum(square * F.col("v"))).alias("v"))


def ellipse_by_parts(gather: Grid, mean: Column, difference: Column, cross: Column, half: bool = True, inverse: bool = False) -> Grid:
    """``ellipse`` with squared slownesses said by their mean over azimuth, half the difference of the axes, and the cross term."""
    return ellipse(gather, mean + difference, mean - difference, cross, half, inverse)


def moveout_slopes(spark, time: Axis, offset: Axis, velocity: Axis, reference: float = 0.0) -> Grid:
    """Slopes, in samples of time from one offset to the next, of hyperbolas: axes time, offset, velocity.

    ``reference`` stands for the step before the first offset; times under one sample count as one.
    """
    from hyperstrata.functions.header import Header
    from hyperstrata.operators.grid import index_grid

    header = Header((time, offset, velocity))
    empty = Grid(index_grid(spark, header), header)
    h, v = empty.x(2), empty.x(3)
    step = F.when(F.col("i2") == 0, F.lit(float(reference))).otherwise(F.lit(float(offset.d)))
    t = F.greatest(F.sqrt(empty.x(1) * empty.x(1) + h * h / (v * v)), F.lit(float(time.d)))
    return empty.with_v(h / (v * v) * step / (t * F.lit(float(time.d))))
