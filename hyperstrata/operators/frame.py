"""Stencils, running sums and moving frames along an axis, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hyperstrata.operators.grid import Grid


def causint(grid: Grid, axis: int = 1, adjoint: bool = False) -> Grid:
    """Inclusive prefix sum; the adjoint is the suffix sum."""
    w = grid.along(axis)
    frame = w.rowsBetween(Window.currentRow, Window.unboundedFollowing) if adjoint else w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.with_v(F.sum("v").over(frame))


def igrad(grid: Grid, axis: int = 1, adjoint: bool = False, square: bool = False) -> Grid:
    """Forward difference, 0 at the end; its adjoint; or the squared central difference."""
    w = grid.along(axis)
    before, after, v = F.lag("v").over(w), F.lead("v").over(w), F.col("v")
    if square:
        return grid.with_v(F.coalesce(F.pow(F.lit(0.5) * (after - before), F.lit(2.0)), F.lit(0.0)))
    if adjoint:
        return grid.with_v(F.when(after.isNull(), F.coalesce(before, F.lit(0.0))).when(before.isNull(), -v).otherwise(before - v))
    return grid.with_v(F.coalesce(after - v, F.lit(0.0)))


def running_extreme(grid: Grid, axis: int = 1, least: bool = True) -> Grid:
    w = grid.along(axis).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.with_v((F.min if least else F.max)("v").over(w))


def reflectivity(grid: Grid, eps: float = 0.0) -> Grid:
    """Contrast of neighbours (next - this) / (next + this + eps), 0 at the end."""
    after = F.lead("v").over(grid.along(1))
    return grid.with_v(F.coalesce(F.try_divide(after - F.col("v"), after + F.col("v") + F.lit(eps)), F.lit(0.0)))


def impedance(grid: Grid, first: float) -> Grid:
    """The inverse: the running product of (1 + r) / (1 - r) of the samples before, times ``first``."""
    w = grid.along(1).rowsBetween(Window.unboundedPreceding, -1)
    step = F.log((F.lit(1.0) + F.col("v")) / (F.lit(1.0) - F.col("v")))
    return grid.with_v(F.lit(float(first)) * F.exp(F.coalesce(F.sum(step).over(w), F.lit(0.0))))


def boxsmooth(grid: Grid, rect: int, axis: int = 1, repeat: int = 1) -> Grid:
    """Trailing mean of ``rect`` samples, zeros before the start."""
    w = grid.along(axis).rowsBetween(1 - rect, Window.currentRow)
    for _ in range(repeat):
        grid = grid.with_v(F.sum("v").over(w) / F.lit(float(rect)))
    return grid


def triangle(grid: Grid, rect: int, axis: int = 1, repeat: int = 1) -> Grid:
    """Weights (r - |k|) / r**2 with half-sample mirrors at the ends.

    The line is mirrored by ``rect`` samples as extra rows, so that the weighted sum
    is one moving frame, of places, not of rows: a place without a sample counts 0.
    Lines shorter than ``rect`` mirror again and again.
    """
    if rect <= 1:
        return grid
    i = f"i{axis}"
    for _ in range(repeat):
        n = grid.size(axis)
        with_n = grid.df.withColumn("_n", n)
        # a sample stands at every place p in [-rect, n + rect) whose mirror image it is
        period = 2 * F.col("_n")
        low, high = F.floor(F.lit(-rect) / period) - 1, F.ceil((F.col("_n") + rect) / period) + 1
        images = F.flatten(F.transform(F.sequence(low, high), lambda k: F.array(F.col(i) + k * period, period - 1 - F.col(i) + k * period)))
        spread = with_n.withColumn("_p", F.explode(images)).where((F.col("_p") >= -rect) & (F.col("_p") < F.col("_n") + rect))
        line = Window.partitionBy(*grid.others(axis)).orderBy("_p") if grid.others(axis) else Window.partitionBy(F.lit(0)).orderBy("_p")
        known = F.when(F.col("v").isNotNull(), F.struct("_p", "v"))
        near = spread.withColumn("_near", F.collect_list(known).over(line.rangeBetween(1 - rect, rect - 1)))
        weight = lambda x: (F.lit(rect) - F.abs(x["_p"] - F.col("_p"))) / F.lit(float(rect**2))
        value = F.when(F.size("_near") > 0, F.aggregate("_near", F.lit(0.0), lambda a, x: a + weight(x) * x["v"]))
        smooth = near.withColumn("_s", value).where((F.col("_p") >= 0) & (F.col("_p") < F.col("_n")))
        df = smooth.select(*[F.col("_p").alias(i) if c == i else F.col(c) for c in grid.indices], F.col("_s").alias("v"))
        grid = Grid(df, grid.header)
    return grid


def moving(grid: Grid, length: int, how: str, axis: int = 1, boundary: str = "zero") -> Grid:
    """Centred moving mean or median of an odd length; beyond the ends zeros, the
    edge value (``edge``), or the frame slid inward (``slide``)."""
    w, half, n = grid.along(axis), length // 2, grid.size(axis)
    i = F.col(f"i{axis}")
    keys = grid.others(axis)
    if boundary == "slide":
        whole = F.collect_list("v").over(w.rowsBetween(1 - length, length - 1))
        start = F.greatest(F.lit(0), F.least(i - half, n - length)) - F.greatest(F.lit(0), i - (length - 1))
        values = F.slice(whole, start.cast("int") + 1, F.lit(length))
    else:
        inside = F.collect_list("v").over(w.rowsBetween(-half, half))
        before = F.greatest(F.lit(0), F.lit(half) - i).cast("int")
        after = F.greatest(F.lit(0), i + half - (n - 1)).cast("int")
        edge = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        first = F.lit(0.0) if boundary == "zero" else F.min_by("v", f"i{axis}").over(edge)
        last = F.lit(0.0) if boundary == "zero" else F.max_by("v", f"i{axis}").over(edge)
        values = F.concat(F.array_repeat(first, before), inside, F.array_repeat(last, after))
    value = F.get(F.array_sort(values), F.lit(half)) if how == "median" else F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.lit(float(length))
    return grid.with_v(value)


def despike(grid: Grid, wide: int, axis: int = 1) -> Grid:
    """Moving median whose frame slides inward at the ends."""
    return moving(grid, wide, "median", axis, "slide")


def laplacian(grid: Grid, axes: tuple[int, ...] = (1, 2)) -> Grid:
    """Sum over the neighbours that exist of this minus the neighbour."""
    total: Column = F.lit(0.0)
    for k in axes:
        w = grid.along(k)
        for other in (F.lag("v").over(w), F.lead("v").over(w)):
            total = total + F.coalesce(F.col("v") - other, F.lit(0.0))
    return grid.with_v(total)


def variogram(grid: Grid, lags: int, axis: int = 1):
    """lag, value: half the mean squared difference at each lag, over all lines.

    One pass: each sample is sent to the pairs it may be in along its own line.
    """
    i = f"i{axis}"
    right = grid.df.select(*grid.others(axis), F.col(i).alias("_j"), F.col("v").alias("_w"))
    left = grid.df.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).withColumn("_j", F.col(i) + F.col("lag"))
    pairs = left.join(right, [*grid.others(axis), "_j"])
    return pairs.groupBy("lag").agg((F.sum(F.pow(F.col("v") - F.col("_w"), F.lit(2.0))) / (F.lit(2.0) * F.count("*"))).alias("value"))


def sobel(grid: Grid) -> Grid:
    """Smoothed 2-D gradient squared; 0 on the border."""
    w1, w2 = grid.along(1), grid.along(2)
    smooth = lambda c, w: F.lag(c).over(w) + 2 * F.col(c) + F.lead(c).over(w)
    diff = lambda c, w: F.lead(c).over(w) - F.lag(c).over(w)
    df = grid.df.withColumns({"_s1": smooth("v", w1), "_d1": diff("v", w1)})
    df = df.withColumns({"_g1": smooth("_d1", w2), "_g2": diff("_s1", w2)})
    return Grid(df.withColumn("v", F.coalesce(F.col("_g1") * F.col("_g1") + F.col("_g2") * F.col("_g2"), F.lit(0.0))).select(grid.df.columns), grid.header)


def sobel3(grid: Grid, axis: int | None = None) -> Grid:
    """Smoothed 3-D derivative along an axis, or the squared gradient; 0 on the border.

    The 3 x 3 weights across the derivative are 1 at the corners and 4 elsewhere, that is
    four times a box less three times the corners, so windows along each axis do.
    """
    def ends(c, w):
        return F.lag(c).over(w) + F.lead(c).over(w)

    df, total = grid.df, F.lit(0.0)
    for k in (1, 2, 3):
        a, b = (grid.along(j) for j in (1, 2, 3) if j != k)
        df = df.withColumn("_d", F.lead("v").over(grid.along(k)) - F.lag("v").over(grid.along(k)))
        df = df.withColumn("_e", ends("_d", a)).withColumn("_e2", ends("_e", b)).withColumn("_d2", ends("_d", b))
        df = df.withColumn(f"_g{k}", 4 * (F.col("_d") + F.col("_e") + F.col("_d2") + F.col("_e2")) - 3 * F.col("_e2")).drop("_d", "_e", "_e2", "_d2")
        total = total + F.col(f"_g{k}") * F.col(f"_g{k}")
    whole = F.when((F.col("_g1") + F.col("_g2") + F.col("_g3")).isNull(), 0.0)
    value = whole.otherwise(total if axis is None else F.col(f"_g{axis}"))
    return Grid(df.withColumn("v", value).select(grid.df.columns), grid.header)


def forward_gradient(grid: Grid) -> DataFrame:
    """The indices and g1, g2: differences to the next sample of axes 1 and 2, 0 on the last of either."""
    g1, g2 = F.lead("v").over(grid.along(1)) - F.col("v"), F.lead("v").over(grid.along(2)) - F.col("v")
    both = grid.df.withColumns({"_1": g1, "_2": g2})
    inside = F.col("_1").isNotNull() & F.col("_2").isNotNull()
    return both.select(*grid.indices, F.when(inside, F.col("_1")).otherwise(0.0).alias("g1"), F.when(inside, F.col("_2")).otherwise(0.0).alias("g2"))


def gain_control(grid: Grid, rect: int = 125) -> Grid:
    """Divide by the triangle-smoothed absolute value where it is over 0."""
    gain = triangle(grid.with_v(F.abs("v")), rect)
    df = grid.df.join(gain.df.withColumnRenamed("v", "_g"), grid.indices)
    return Grid(df.withColumn("v", F.when(F.col("_g") > 0, F.try_divide("v", "_g")).otherwise(F.col("v"))).select(grid.df.columns), grid.header)


def derivative(grid: Grid, axis: int = 1) -> Grid:
    """Central difference, one-sided at the ends."""
    w = grid.along(axis)
    before, after, v = F.lag("v").over(w), F.lead("v").over(w), F.col("v")
    return grid.with_v(F.coalesce((after - before) / F.lit(2.0), after - v, v - before, F.lit(0.0)))


def shift(grid: Grid, by: int, axis: int = 1) -> Grid:
    """Move samples along an axis, zeros coming in."""
    w = grid.along(axis)
    return grid.with_v(F.coalesce(F.lag("v", by).over(w) if by >= 0 else F.lead("v", -by).over(w), F.lit(0.0)))


def smooth_axes(grid: Grid, rects: dict[int, int], repeat: int = 1) -> Grid:
    """Triangle smoothing over several axes, one after another."""
    for axis, rect in rects.items():
        grid = triangle(grid, rect, axis, repeat)
    return grid


def smooth_complex(grid: Grid, rects: dict[int, int], repeat: int = 1) -> Grid:
    """Triangle smoothing of complex samples: the parts are smoothed apart."""
    from hyperstrata.operators.select import cmplx, part

    return cmplx(*[smooth_axes(part(grid, k), rects, repeat) for k in ("re", "im")])


def grid_derivative(grid: Grid, axis: int = 1, adjoint: bool = False) -> Grid:
    """Forward differences over the step, 0 at the last sample; and the adjoint of that."""
    w, d = grid.along(axis), F.lit(float(grid.axis(axis).d))
    v, last = F.col("v"), F.lead("v").over(grid.along(axis)).isNull()
    if adjoint:
        return grid.with_v((F.coalesce(F.lag("v").over(w), F.lit(0.0)) - F.when(last, F.lit(0.0)).otherwise(v)) / d)
    return grid.with_v(F.coalesce(F.lead("v").over(w) - v, F.lit(0.0)) / d)
