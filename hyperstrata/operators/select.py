"""Selection by position, by header mask and by value."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperstrata.functions.header import Header
from hyperstrata.operators.grid import Grid


def _range(grid: Grid, axis: int, f=None, n=None, j=None, start=None, end=None, step=None) -> tuple[int, int | None, int]:
    """First index, number and jump along an axis from indices or coordinates.

    A negative first index counts from the end.
    """
    a = grid.axis(axis)
    j = max(1, int(0.5 + step / a.d)) if j is None and step is not None else (j or 1)
    f = a.index(start) if f is None and start is not None else (f or 0)
    if f < 0:
        f += a.n
    if n is None:
        last = a.index(end) if end is not None else (None if a.n is None else a.n - 1)
        n = None if last is None else 1 + (last - f) // j
    if a.n is not None and n is not None and f + (n - 1) * j >= a.n:
        raise ValueError(f"window of axis {axis} ends at {f + (n - 1) * j}, the axis at {a.n - 1}")
    return f, n, j


def _inside(axis: int, f: int, n: int | None, j: int) -> Column:
    i = F.col(f"i{axis}")
    keep = i >= f
    if n is not None:
        keep &= i < f + n * j
    return keep & ((i - f) % j == 0) if j > 1 else keep


def window(grid: Grid, **axes: dict) -> Grid:
    """A part of the grid: ``window(g, axis1={"f": 2, "n": 10, "j": 2}, axis2={"start": 0.5})``."""
    df, header = grid.df, grid.header
    for name, spec in axes.items():
        k = int(name.removeprefix("axis"))
        f, n, j = _range(grid, k, **spec)
        a = grid.axis(k)
        df = df.where(_inside(k, f, n, j)).withColumn(f"i{k}", F.expr(f"(i{k} - {f}) div {j}"))
        header = header.with_axis(k, n=n, o=a.coordinate(f), d=a.d * j)
    return Grid(df, header)


def squeeze(grid: Grid) -> Grid:
    """Axes of one sample go last."""
    order = [k for k in range(1, grid.dims + 1) if grid.axis(k).n != 1] + [k for k in range(1, grid.dims + 1) if grid.axis(k).n == 1]
    rest = [c for c in grid.df.columns if c not in grid.indices]
    df = grid.df.select(*[F.col(f"i{k}").alias(f"i{p}") for p, k in enumerate(order, 1)], *rest)
    return Grid(df, Header(tuple(grid.axis(k) for k in order), grid.header.kind, grid.header.extra))


def cut(grid: Grid, **axes: dict) -> Grid:
    """Zero the part that ``window`` would keep."""
    inside = F.lit(True)
    for name, spec in axes.items():
        k = int(name.removeprefix("axis"))
        inside &= _inside(k, *_range(grid, k, **spec))
    return grid.with_v(F.when(inside, F.lit(0.0)).otherwise(F.col("v")))


def mask(v: Column, low: float | None = None, high: float | None = None) -> Column:
    """1 within [low, high], ends included, else 0; NaN gives 0."""
    keep = ~F.isnan(v.cast("double"))
    if low is not None:
        keep &= v >= low
    if high is not None:
        keep &= v <= high
    return F.coalesce(keep, F.lit(False)).cast("int")


def header_window(grid: Grid, masks: DataFrame, axis: int = 2, inverse: bool = False) -> Grid:
    """Keep the traces whose mask is not 0, numbered anew; the inverse puts them back with zeros between.

    ``masks``: i<axis> and mask. New numbers are made on the mask table, which is as
    small as the number of traces.
    """
    from hyperstrata.operators.rank import global_rank

    key = f"i{axis}"
    kept = global_rank(masks.where("mask <> 0").select(key), [key], "_new")
    if not inverse:
        df = grid.df.join(kept, key).drop(key).withColumnRenamed("_new", key)
        return Grid(df.select(grid.df.columns), grid.header.with_axis(axis, n=None))
    a1 = grid.axis(1)
    frame = masks.select(key).join(kept, key, "left").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(a1.n - 1).cast("long"))).alias("i1"))
    data = grid.df.select("i1", F.col(key).alias("_new"), "v")
    df = frame.join(data, ["i1", "_new"], "left").select("i1", key, F.coalesce("v", F.lit(0.0)).alias("v"))
    return Grid(df, grid.header.with_axis(axis, n=None))


def header_cut(grid: Grid, masks: DataFrame, axis: int = 2) -> Grid:
    """Zero the traces whose mask is 0."""
    key = f"i{axis}"
    df = grid.df.join(masks.select(key, "mask"), key, "left").withColumn("v", F.when(F.coalesce("mask", F.lit(0)) != 0, F.col("v")).otherwise(0.0))
    return replace(grid, df=df.select(grid.df.columns))


def clip(v: Column, limit: float, value: float | None = None) -> Column:
    """Two-sided clip; a value that is not finite becomes plus ``value``, NaN minus it."""
    value = limit if value is None else value
    v = v.cast("double")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(odd, F.when(~F.isnan(v) & (v > 0), F.lit(float(value))).otherwise(F.lit(-float(value)))).when(v > limit, F.lit(float(value))).when(v < -limit, F.lit(-float(value))).otherwise(v)


def clip2(v: Column, lower: float | None = None, upper: float | None = None) -> Column:
    if lower is not None:
        v = F.greatest(v, F.lit(float(lower)))
    return v if upper is None else F.least(v, F.lit(float(upper)))


def threshold_clip(v: Column, lower: float, upper: float) -> Column:
    """0 under ``lower``, 1 over ``upper``."""
    return F.when(v < lower, 0.0).when(v > upper, 1.0).otherwise(v)


def soft_threshold(grid: Grid, keep_percent: float) -> Grid:
    """Shrink towards 0 by the k-th smallest absolute value, k = int(0.5 + n (1 - percent/100))."""
    from hyperstrata.operators.rank import kth_smallest

    magnitude = grid.df.select(F.abs("v").alias("x"))
    n = magnitude.count()
    k = min(max(int(0.5 + n * (1 - keep_percent / 100)), 0), n - 1)
    t = kth_smallest(magnitude, "x", k)
    return grid.with_v(F.signum("v") * F.greatest(F.abs("v") - t, F.lit(0.0)))


def mutter(grid: Grid, offset: Column, slope0: float = 0.0, slopep: float | None = None, t0: float = 0.0, tp: float = 0.0, inner: bool = False) -> Grid:
    """Mute with a sine-squared ramp between t0 + |x| slope0 and t0 + tp + |x| slopep."""
    slopep = slope0 if slopep is None else slopep
    t = grid.x(1) - F.lit(t0)
    late, early = t - F.abs(offset) * F.lit(slopep) - F.lit(tp), t - F.abs(offset) * F.lit(slope0)
    outside, inside = (early < 0, late > 0) if not inner else (late > 0, early < 0)
    part = F.try_divide(early, early - late)
    ramp = F.pow(F.sin(F.lit(1.5707963267948966) * (part if not inner else F.lit(1.0) - part)), F.lit(2.0))
    return grid.with_v(F.when(outside, F.lit(0.0)).when(inside, F.col("v")).otherwise(F.col("v") * F.coalesce(ramp, F.lit(1.0))))


def cosine_taper(grid: Grid, widths: dict[int, int]) -> Grid:
    """Sine-squared weights on the ``widths[k]`` samples at both ends of axis k."""
    v = F.col("v")
    for k, w in widths.items():
        i, n = F.col(f"i{k}"), grid.size(k)
        weight = lambda p, w=w: F.pow(F.sin(F.lit(0.5 * 3.141592653589793) * (p + 1) / F.lit(w + 1.0)), F.lit(2.0))
        v = v * F.when(i < w, weight(i)).otherwise(F.lit(1.0)) * F.when(n - 1 - i < w, weight(n - 1 - i)).otherwise(F.lit(1.0))
    return grid.with_v(v)


def polygon_mask(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """1 inside a polygon, by the parity of the edges crossed."""
    crossed = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if y1 != y2:
            hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < F.lit(x1) + (y - F.lit(y1)) * F.lit((x2 - x1) / (y2 - y1)))
            crossed = crossed + hit.cast("int")
    return (crossed % 2).cast("int")


def compare(a: Grid, b: Grid | float, sign: str, eps: float = 0.0) -> Grid:
    """1 or 0 of a comparison: eq, ne, gt, ge, lt, lq, and, or; equality within ``eps``."""
    if isinstance(b, Grid):
        df = a.df.join(b.df.select(*b.indices, F.col("v").alias("_w")), a.indices)
    else:
        df = a.df.withColumn("_w", F.lit(float(b)))
    v, w = F.col("v"), F.col("_w")
    near = F.abs(v - w) <= eps
    test = {"eq": near, "ne": ~near, "gt": v > w, "ge": v >= w, "lt": v < w, "lq": v <= w, "and": (v != 0) & (w != 0), "or": (v != 0) | (w != 0)}[sign]
    return replace(a, df=df.withColumn("v", test.cast("int")).select(a.df.columns))


def power_gain(grid: Grid, powers: dict[int, float]) -> Grid:
    """Multiply by (o + (i+1) d) ** p along each axis of ``powers``."""
    v = F.col("v")
    for k, p in powers.items():
        a = grid.axis(k)
        v = v * F.pow(F.lit(float(a.o)) + (F.col(f"i{k}") + 1) * F.lit(float(a.d)), F.lit(float(p)))
    return grid.with_v(v)


def scale_axis(grid: Grid, axes: int) -> Grid:
    """Divide each block of the first ``axes`` axes by its largest absolute value."""
    from pyspark.sql import Window

    keys = [f"i{k}" for k in range(axes + 1, grid.dims + 1)]
    block = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    peak = F.max(F.abs("v")).over(block)
    return grid.with_v(F.when(peak > 0, F.try_divide("v", peak)).otherwise(F.col("v")))


def math(output: str, grid: Grid, **named: Grid) -> Grid:
    """A pointwise SQL expression over ``input``, named grids, coordinates x1.. and complex parts."""
    df = grid.df.withColumnRenamed("v", "input")
    for name, g in named.items():
        df = df.join(g.df.select(*g.indices, F.col("v").alias(name)), grid.indices)
    for k in range(1, grid.dims + 1):
        df = df.withColumn(f"x{k}", grid.x(k))
    return Grid(df.select(*grid.indices, F.expr(output).alias("v")), grid.header)


def cmplx(re: Grid, im: Grid) -> Grid:
    re.header.check_like(im.header)
    df = re.df.join(im.df.select(*im.indices, F.col("v").alias("_im")), re.indices)
    return Grid(df.select(*re.indices, F.struct(F.col("v").alias("re"), F.col("_im").alias("im")).alias("v")), replace(re.header, kind="complex"))


def part(grid: Grid, which: str) -> Grid:
    """``re``, ``im``, ``abs`` or ``arg`` of a complex grid."""
    re, im = F.col("v.re"), F.col("v.im")
    v = {"re": re, "im": im, "abs": F.hypot(re, im), "arg": F.atan2(im, re)}[which]
    return Grid(grid.df.withColumn("v", v), replace(grid.header, kind="float"))


def to_complex(grid: Grid, pair: bool = False) -> Grid:
    """Zero imaginary parts, or even and odd samples of axis 1 as real and imaginary parts."""
    header = replace(grid.header, kind="complex")
    if not pair:
        return Grid(grid.df.withColumn("v", F.struct(F.col("v").alias("re"), F.lit(0.0).alias("im"))), header)
    odd = F.col("i1") % 2 == 1
    value = F.struct(F.max(F.when(~odd, F.col("v"))).alias("re"), F.max(F.when(odd, F.col("v"))).alias("im"))
    df = grid.df.withColumn("_h", F.expr("i1 div 2")).groupBy("_h", *grid.others(1)).agg(value.alias("v")).withColumnRenamed("_h", "i1")
    a = grid.axis(1)
    return Grid(df.select(*grid.indices, "v"), header.with_axis(1, n=None if a.n is None else a.n // 2, d=a.d * 2))





def byte(grid: Grid, clip: float | None = None, percent: float = 99.0, bias: float = 0.0) -> Grid:
    """Amplitudes as whole numbers 0 .. 255: ``bias`` is the middle, ``clip`` away from it the ends.

    Without a clip it is the percentile of the absolute values.
    """
    if clip is None:
        from hyperstrata.operators.rank import kth_smallest, quantile_rank

        sizes = grid.df.select(F.abs(F.col("v") - bias).alias("v"))
        clip = kth_smallest(sizes, "v", quantile_rank(sizes.count(), percent)) or 1.0
    level = F.floor(F.lit(127.5) + F.lit(127.5) * (F.col("v") - F.lit(bias)) / F.lit(clip) + 0.5)
    return grid.with_v(F.greatest(F.lit(0), F.least(F.lit(255), level)).cast("int"))


def outside_values(v: Column, lower: float, upper: float, lower_value: float, upper_value: float) -> Column:
    """Other values under ``lower`` and over ``upper``."""
    return F.when(v > upper, F.lit(float(upper_value))).when(v < lower, F.lit(float(lower_value))).otherwise(v)
