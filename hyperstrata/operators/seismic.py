"""Acquisition geometry, moveout families, migration, angle and amplitude formulas."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis, Header
from hyperstrata.operators import panel, resample
from hyperstrata.operators.grid import Grid, index_grid


def cmp_to_shot(gathers: Grid, shots: int, positive: bool = True) -> Grid:
    """CMP gathers (time, offset, midpoint) to shot gathers of regular 2-D geometry; missing traces are zero.

    With sources and offsets at one spacing and ``kind`` offsets steps per midpoint
    step 1: midpoint = shot + offset (counted from the far end for positive offsets).
    """
    nh = gathers.axis(2).n
    a1, a2 = gathers.axis(1), gathers.axis(2)
    header = Header((a1, a2, Axis(shots, gathers.axis(3).o, gathers.axis(3).d)))
    frame = index_grid(gathers.spark, header)
    midpoint = F.col("i3") + F.col("i2") - (nh - 1) if positive else F.col("i3") - F.col("i2")
    source = gathers.df.select("i1", "i2", F.col("i3").alias("_m"), "v")
    df = frame.withColumn("_m", midpoint).join(source, ["i1", "i2", "_m"], "left").select("i1", "i2", "i3", F.coalesce("v", F.lit(0.0)).alias("v"))
    return Grid(df, header)


def shot_to_cmp(gathers: Grid, midpoints: int, positive: bool = True) -> Grid:
    """The inverse index map: shot = midpoint - offset, counted alike; missing traces are zero."""
    nh = gathers.axis(2).n
    header = Header((gathers.axis(1), gathers.axis(2), Axis(midpoints, gathers.axis(3).o, gathers.axis(3).d)))
    shot = F.col("i3") - F.col("i2") + (nh - 1) if positive else F.col("i3") + F.col("i2")
    source = gathers.df.select("i1", "i2", F.col("i3").alias("_s"), "v")
    df = index_grid(gathers.spark, header).withColumn("_s", shot).join(source, ["i1", "i2", "_s"], "left").select("i1", "i2", "i3", F.coalesce("v", F.lit(0.0)).alias("v"))
    return Grid(df, header)


def header_math(headers: DataFrame, output: str, name: str, order: list[str], start: float = 0.0, step: float = 1.0) -> DataFrame:
    """A new header key from an expression of the keys, the trace number N and its coordinate T."""
    from hyperstrata.functions.expr import parse
    from hyperstrata.operators.rank import global_rank

    df = global_rank(headers, order, "N")
    names = {c: F.col(c) for c in df.columns} | {"T": F.lit(start) + F.col("N") * F.lit(step)}
    return df.withColumn(name, parse(output, names)).drop("N")


def _cumulative(velocity: Grid, slow: bool) -> Grid:
    """One-way vertical time at the top of each cell: exclusive prefix sums of d / v."""
    from pyspark.sql import Window

    w = velocity.along(1).rowsBetween(Window.unboundedPreceding, -1)
    step = F.col("v") if slow else F.lit(1.0) / F.col("v")
    return velocity.with_v(F.coalesce(F.sum(step * F.lit(float(velocity.axis(1).d))).over(w), F.lit(0.0)))


def depth_to_time(data: Grid, velocity: Grid, time: Axis, slow: bool = False) -> DataFrame:
    """Depth traces on a regular axis of two-way time in a V(z) medium."""
    t = _cumulative(velocity, slow)
    knots = data.df.join(t.df.select(*t.indices, (F.lit(2.0) * F.col("v")).alias("_t")), data.indices)
    return resample.linear(knots, data.others(1), "_t", "v", time)


def time_to_depth(data: Grid, velocity: Grid, slow: bool = False) -> Grid:
    """Two-way time traces at the depths of the velocity: values between time samples, 0 beyond."""
    a, keys = data.axis(1), data.others(1)
    t = _cumulative(velocity, slow).df.select(*velocity.indices, ((F.lit(2.0) * F.col("v") - F.lit(float(a.o))) / F.lit(float(a.d))).alias("_p"))
    base, part = F.floor("_p").cast("long"), F.col("_p") - F.floor("_p")
    ends = t.select(*velocity.indices, F.inline(F.array(F.struct(base.alias("_j"), (F.lit(1.0) - part).alias("_w")), F.struct((base + 1).alias("_j"), part.alias("_w"))))).where("_w > 0")
    source = data.df.select(F.col("i1").alias("_j"), *keys, F.col("v").alias("_v"))
    df = ends.join(source, ["_j", *keys], "left").groupBy(*velocity.indices).agg(F.sum(F.coalesce("_v", F.lit(0.0)) * F.col("_w")).alias("v"))
    return Grid(df, velocity.header)


def elliptical_nmo(gather: Grid, wx: float, wxy: float, wy: float) -> Grid:
    """3-D moveout t**2 = t0**2 + wx x**2 + 2 wxy x y + wy y**2; axes are time, x, y."""
    a = gather.axis(1)
    t0 = F.lit(float(a.o)) + F.col("i1") * F.lit(float(a.d))
    x, y = gather.x(2), gather.x(3)
    t = F.sqrt(F.greatest(F.lit(0.0), t0 * t0 + F.lit(wx) * x * x + F.lit(2 * wxy) * x * y + F.lit(wy) * y * y))
    return resample.remapped(gather, (t - F.lit(float(a.o))) / F.lit(float(a.d)))


def moveout_fit(picks: DataFrame, by: list[str], t: str, t0: str, x: str, y: str) -> DataFrame:
    """Least squares of t**2 - t0**2 on (x**2, 2xy, y**2): wx, wxy, wy of each group.

    The nine sums of the normal equations are pre-aggregated; a 3 by 3 system is solved
    by its determinants.
    """
    c = {k: F.col(v).cast("double") for k, v in (("t", t), ("t0", t0), ("x", x), ("y", y))}
    a = [c["x"] * c["x"], 2 * c["x"] * c["y"], c["y"] * c["y"]]
    d = c["t"] * c["t"] - c["t0"] * c["t0"]
    sums = {f"a{i}{j}": F.sum(a[i] * a[j]) for i in range(3) for j in range(i, 3)} | {f"b{i}": F.sum(a[i] * d) for i in range(3)}
    df = picks.groupBy(*by).agg(*[v.alias(k) for k, v in sums.items()])
    m = [[F.col(f"a{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    b = [F.col(f"b{i}") for i in range(3)]
    det = lambda q: q[0][0] * (q[1][1] * q[2][2] - q[1][2] * q[2][1]) - q[0][1] * (q[1][0] * q[2][2] - q[1][2] * q[2][0]) + q[0][2] * (q[1][0] * q[2][1] - q[1][1] * q[2][0])
    solve = lambda k: F.try_divide(det([[b[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]), det(m))
    return df.select(*by, solve(0).alias("wx"), solve(1).alias("wxy"), solve(2).alias("wy"))


def kirchhoff_time(section: Grid, velocity: float, aperture: int, adjoint: bool = False) -> Grid:
    """Zero-offset Kirchhoff time migration (or modelling): sums along diffraction curves.

    Output (t0, x) gathers input (sqrt(t0**2 + 4 (x - y)**2 / v**2), y) for traces y at
    most ``aperture`` traces away; modelling spreads along the same curves. Every sample
    makes at most 2 * aperture + 1 requests, joined by index and summed.
    """
    a1, a2, extra = section.axis(1), section.axis(2), section.others(1, 2)
    shift = F.explode(F.sequence(F.lit(-aperture).cast("long"), F.lit(aperture).cast("long")))
    t0 = F.lit(float(a1.o)) + F.col("i1") * F.lit(float(a1.d))
    h = F.col("_s") * F.lit(float(a2.d)) * F.lit(2.0 / velocity)
    index = F.floor(F.lit(0.5) + (F.sqrt(t0 * t0 + h * h) - F.lit(float(a1.o))) / F.lit(float(a1.d))).cast("long")
    curves = section.df.withColumn("_s", shift).withColumns({"_j": index, "_y": F.col("i2") + F.col("_s")}).where((F.col("_j") < a1.n) & (F.col("_y") >= 0) & (F.col("_y") < a2.n))
    if adjoint:
        sums = curves.groupBy(F.col("_j").alias("i1"), F.col("_y").alias("i2"), *extra).agg(F.sum("v").alias("v"))
        frame = index_grid(section.spark, Header((a1, a2)))
        panels = section.df.select(*extra).distinct().withColumn("_one", F.lit(1)) if extra else section.spark.range(1).select(F.lit(1).alias("_one"))
        # every panel has every place of axes 1 and 2, a bounded table
        places = frame.agg(F.collect_list(F.struct("i1", "i2")).alias("_all")).withColumn("_one", F.lit(1))
        full = panels.join(F.broadcast(places), "_one").select(*extra, F.inline("_all"))
        df = full.join(sums, section.indices, "left").select(*section.indices, F.coalesce("v", F.lit(0.0)).alias("v"))
        return Grid(df, section.header)
    source = section.df.select(F.col("i1").alias("_j"), F.col("i2").alias("_y"), *extra, F.col("v").alias("_v"))
    df = curves.select("i1", "i2", *extra, "_j", "_y").join(source, ["_j", "_y", *extra]).groupBy(*section.indices).agg(F.sum("_v").alias("v"))
    return Grid(df, section.header)


def stolt(section: Grid, velocity: float) -> Grid:
    """Post-stack Stolt migration: a remap of frequency for each wavenumber of a panel."""
    d1, d2 = section.axis(1).d, section.axis(2).d

    def kernel(u):
        n2, n1 = u.shape
        nt = 2 * n1
        spectrum = np.fft.fft2(u, (n2, nt))
        w = np.fft.fftfreq(nt, d1)
        k = np.fft.fftfreq(n2, d2)[:, None] * velocity / 2
        source = np.sign(w) * np.sqrt(w * w + k * k)
        place = source * nt * d1
        base = np.floor(place).astype(int)
        part = place - base
        row = np.arange(n2)[:, None]
        ok = np.abs(place) < nt // 2 - 1
        value = np.where(ok, spectrum[row, base % nt] * (1 - part) + spectrum[row, (base + 1) % nt] * part, 0)
        jacobian = np.where(np.abs(source) > 0, np.abs(w) / np.where(source == 0, 1, np.abs(source)), 1)
        return np.fft.ifft2(value * jacobian).real[:, :n1]

    return panel.apply(section, kernel)


def radial(gather: Grid, velocities: Axis, tp: float = 0.0, xp: float = 0.0) -> Grid:
    """Radial traces: out(t, v) = in(t, xp + v (t - tp)), between neighbouring traces; 0 outside."""
    a2 = gather.axis(2)
    extra = gather.others(1, 2)
    outs = gather.df.select("i1", *extra).distinct().withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(velocities.n - 1).cast("long"))))
    v = F.lit(float(velocities.o)) + F.col("_k") * F.lit(float(velocities.d))
    p = (F.lit(xp) + v * (gather.x(1) - F.lit(tp)) - F.lit(float(a2.o))) / F.lit(float(a2.d))
    outs = outs.withColumn("_p", p)
    base, part = F.floor("_p").cast("long"), F.col("_p") - F.floor("_p")
    ends = outs.select("i1", "_k", *extra, F.inline(F.array(F.struct(base.alias("i2"), (F.lit(1.0) - part).alias("_w")), F.struct((base + 1).alias("i2"), part.alias("_w")))))
    hit = ends.join(gather.df.select("i1", "i2", *extra, "v"), ["i1", "i2", *extra], "left")
    df = hit.groupBy("i1", F.col("_k").alias("i2"), *extra).agg(F.sum(F.coalesce("v", F.lit(0.0)) * F.col("_w")).alias("v"))
    return Grid(df.select(*gather.indices, "v"), gather.header.with_axis(2, n=velocities.n, o=velocities.o, d=velocities.d))


def shifts(panel_: Grid, dips: Axis) -> Grid:
    """The next trace moved by each of several dips (in samples): a new axis 3; the last trace is zero."""
    n1 = panel_.axis(1).n
    following = panel_.df.select("i1", (F.col("i2") - 1).alias("i2"), "v")
    frame = panel_.df.select("i1", "i2").withColumn("i3", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(dips.n - 1).cast("long"))))
    p = F.col("i1") + F.lit(float(dips.o)) + F.col("i3") * F.lit(float(dips.d))
    base, part = F.floor(p).cast("long"), p - F.floor(p)
    inside = (p >= 0) & (p <= n1 - 1)
    ends = frame.select("i1", "i2", "i3", inside.alias("_in"), F.inline(F.array(F.struct(base.alias("_j"), (F.lit(1.0) - part).alias("_w")), F.struct((base + 1).alias("_j"), part.alias("_w")))))
    hit = ends.join(following.withColumnRenamed("i1", "_j"), ["_j", "i2"], "left")
    df = hit.groupBy("i1", "i2", "i3").agg(F.sum(F.when(F.col("_in"), F.coalesce("v", F.lit(0.0)) * F.col("_w")).otherwise(0.0)).alias("v"))
    return Grid(df, Header((*panel_.header.axes, dips)))


def remap_angle(gather: Grid, rule: str, angles: Axis) -> Grid:
    """Axis 1 from tan, cos, sin, -1/cos (``inverse cos``) or 1/sin of an angle to the angle in degrees."""
    a = gather.axis(1)
    angle = F.radians(F.lit(float(angles.o)) + F.col("i1") * F.lit(float(angles.d)))
    value = {"tan": F.tan, "cos": F.cos, "sin": F.sin, "inverse cos": lambda x: -1 / F.cos(x), "inverse sin": lambda x: 1 / F.sin(x)}[rule](angle)
    out = resample.remapped(gather, (value - F.lit(float(a.o))) / F.lit(float(a.d)), n=angles.n)
    return Grid(out.df, out.header.with_axis(1, o=angles.o, d=angles.d, label="Angle", unit="deg"))


def converted_angle(gather: Grid, ratio: float, inverse: bool = False) -> Grid:
    """Axis 1, tan of an angle, of PP gathers to that of PS gathers for a ratio of velocities, or back; linear between samples."""
    a, r = gather.axis(1), ((1 - ratio) / (1 + ratio)) ** 2 * (-1 if inverse else 1)
    t = F.pow(F.lit(float(a.o)) + F.col("i1") * F.lit(float(a.d)), F.lit(2.0))
    at = F.try_divide(t + F.lit(r), 1 + F.lit(r) * t)
    position = (F.sqrt(F.greatest(at, F.lit(0.0))) - F.lit(float(a.o))) / F.lit(float(a.d))
    return resample.remapped(gather, F.when(at >= 0, position).otherwise(-1.0))


def partition_velocity(velocity: Grid, cuts: list[float]) -> DataFrame:
    """The part of v**2 t in each interval between cut times: cut number, and the velocity of that part."""
    t = velocity.x(1)
    edges = [0.0, *cuts, float("inf")]
    parts = [F.greatest(F.lit(0.0), F.least(t, F.lit(b)) - F.lit(a)) for a, b in zip(edges, edges[1:])]
    return velocity.df.select(*velocity.indices, F.posexplode(F.array(*[F.sqrt(F.col("v") * F.col("v") * F.coalesce(F.try_divide(p, t), F.lit(0.0))) for p in parts])).alias("part", "v"))


def linear_velocity_time(z: Column, v0: float, alpha: float) -> Column:
    """Vertical time to depth z where velocity is v0 + alpha z."""
    return F.log(F.lit(1.0) + F.lit(alpha / v0) * z) / F.lit(alpha) if alpha else z / F.lit(v0)


def linear_velocity_rms(t: Column, v0: float, alpha: float) -> Column:
    """Root-mean-square velocity at vertical time t (one way) for v0 + alpha z."""
    at = F.lit(alpha) * t
    growth = F.when(F.abs(at) < 1e-12, F.lit(1.0)).otherwise(F.try_divide(F.exp(F.lit(2.0) * at) - 1.0, F.lit(2.0) * at))
    return F.lit(v0) * F.sqrt(growth)


def gradient_time(x: Column, z: Column, v0: float, g: float) -> Column:
    """Two-point traveltime from the surface where velocity is v0 + g z."""
    v = F.lit(v0) + F.lit(g) * z
    argument = F.lit(1.0) + F.lit(g * g) * (x * x + z * z) / (F.lit(2.0 * v0) * v)
    return F.acosh(F.greatest(argument, F.lit(1.0))) / F.lit(g)


def zoeppritz_pp(angle: Column, vp1: float, vs1: float, rho1: float, vp2: float, vs2: float, rho2: float) -> Column:
    """Exact plane-wave PP reflection coefficient (real part, before the critical angle)."""
    p = F.sin(angle) / F.lit(vp1)
    cos = lambda v: F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - p * p * F.lit(v * v)))
    i1, i2, j1, j2 = cos(vp1) / vp1, cos(vp2) / vp2, cos(vs1) / vs1, cos(vs2) / vs2
    g1, g2 = F.lit(1.0) - F.lit(2 * vs1 * vs1) * p * p, F.lit(1.0) - F.lit(2 * vs2 * vs2) * p * p
    a = F.lit(rho2) * g2 - F.lit(rho1) * g1
    b = F.lit(rho2) * g2 + F.lit(2 * rho1 * vs1 * vs1) * p * p
    c = F.lit(rho1) * g1 + F.lit(2 * rho2 * vs2 * vs2) * p * p
    d = F.lit(2.0 * (rho2 * vs2 * vs2 - rho1 * vs1 * vs1))
    e, f = b * i1 + c * i2, b * j1 + c * j2
    g, h = a - d * i1 * j2, a - d * i2 * j1
    return ((b * i1 - c * i2) * f - (a + d * i1 * j2) * h * p * p) / (e * f + g * h * p * p)


def reflectivity_series(layers: Grid, density: Grid) -> Grid:
    """Normal-incidence reflectivity of velocity times density, 0 at the last sample."""
    from hyperstrata.operators import frame
    from hyperstrata.operators.grid import combine

    return frame.reflectivity(combine([layers, density], "mul"))


def moveout_spikes(times: Grid, axis: Axis) -> Grid:
    """Unit spikes at given times (a grid without a time axis), split over the two nearest samples."""
    p = (F.col("v") - F.lit(float(axis.o))) / F.lit(float(axis.d))
    base, part = F.floor(p).cast("long"), p - F.floor(p)
    names = [F.col(f"i{k}").alias(f"i{k + 1}") for k in range(1, times.dims + 1)]
    spikes = times.df.select(*names, F.inline(F.array(F.struct(base.alias("i1"), (F.lit(1.0) - part).alias("v")), F.struct((base + 1).alias("i1"), part.alias("v")))))
    header = Header((axis, *times.header.axes))
    keys = [f"i{k}" for k in range(1, times.dims + 2)]
    found = spikes.groupBy(*keys).agg(F.sum("v").alias("v"))
    df = index_grid(times.spark, header).join(found, keys, "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    return Grid(df, header)


def warp(grid: Grid, positions: Grid, n: int | None = None, inverse: bool = False, eps: float = 1e-9) -> Grid:
    """Move samples along axis 1 by a warp of coordinates: out(i) = in(warp(i)), or the scatter back.

    The inverse spreads each sample over the two outputs nearest to its place and divides
    by the summed weights.
    """
    a, keys = grid.axis(1), grid.others(1)
    n = n or a.n
    at = positions.df.select(*positions.indices, ((F.col("v") - F.lit(float(a.o))) / F.lit(float(a.d))).alias("_p"))
    base, part = F.floor("_p").cast("long"), F.col("_p") - F.floor("_p")
    ends = at.select(*positions.indices, F.inline(F.array(F.struct(base.alias("_j"), (F.lit(1.0) - part).alias("_w")), F.struct((base + 1).alias("_j"), part.alias("_w"))))).where("_w > 0")
    if not inverse:
        source = grid.df.select(F.col("i1").alias("_j"), *keys, F.col("v").alias("_v"))
        df = ends.join(source, ["_j", *keys], "left").groupBy(*positions.indices).agg(F.sum(F.coalesce("_v", F.lit(0.0)) * F.col("_w")).alias("v"))
        return Grid(df, positions.header)
    spread = ends.join(grid.df, positions.indices).where((F.col("_j") >= 0) & (F.col("_j") < n)).groupBy(F.col("_j").alias("i1"), *keys).agg(F.sum(F.col("v") * F.col("_w")).alias("_s"), F.sum("_w").alias("_f"))
    lines = grid.df.select(*keys).distinct() if keys else grid.spark.range(1).drop("id")
    full = lines.withColumn("i1", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    df = full.join(spread, ["i1", *keys], "left").select("i1", *keys, F.when(F.col("_f") > eps, F.try_divide("_s", "_f")).otherwise(0.0).alias("v"))
    return Grid(df.select(*grid.indices, "v"), grid.header.with_axis(1, n=n))


def automatic_pick(scan: Grid, gate: int = 3, weight: float = 1.0) -> Grid:
    """The best path through a panel (axis 1 time, axis 2 velocity): at most ``gate`` steps per sample.

    Dynamic programming over one panel: largest sum of values less ``weight`` times the
    squared steps; ties go to the smaller step. One fractional-free pick (an index of
    axis 2) per sample.
    """

    def kernel(u):
        scores = u.T  # time by velocity
        total, back = scores[0].copy(), []
        steps = sorted(range(-gate, gate + 1), key=abs)
        for row in scores[1:]:
            best, origin = np.full(len(row), -np.inf), np.zeros(len(row), int)
            for s in steps:
                came = np.full(len(row), -np.inf)
                lo, hi = max(0, s), len(row) + min(0, s)
                came[lo:hi] = total[lo - s : hi - s] - weight * s * s
                better = came > best
                best, origin = np.where(better, came, best), np.where(better, np.arange(len(row)) - s, origin)
            total = best + row
            back.append(origin)
        path = [int(total.argmax())]
        for origin in reversed(back):
            path.append(int(origin[path[-1]]))
        return np.array(path[::-1], "f8")[None]

    out = panel.apply(scan, kernel, out=[scan.axis(1), Axis(1)])
    return out


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371.0) -> Column:
    """Distance on a sphere between points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * radius) * F.asin(F.sqrt(a))


__all__ = [n for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__]


def layer_reflections(layers: DataFrame, time: Axis, model: str = "model", layer: str = "layer") -> Grid:
    """PP (i2 = 0) and PS (i2 = 1) reflectivity at normal incidence of stacks of layers, in two-way time.

    ``layers``: model, layer (in order), thickness, vp, vs, rho. A reflection is shared by
    the two samples next to its time.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(model).orderBy(layer)
    after = {c: F.lead(c).over(w) for c in ("vp", "vs", "rho")}
    down = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    z, a, b = F.col("thickness"), F.col("vp"), F.col("vs")
    plus, density = after["vp"] + a, (after["rho"] - F.col("rho")) / (after["rho"] + F.col("rho"))
    pp = F.struct(F.lit(0).cast("long").alias("i2"), F.sum(2 * z / a).over(down).alias("t"), ((after["vp"] - a) / plus + density).alias("r"))
    ps = F.struct(F.lit(1).cast("long").alias("i2"), F.sum(z / a + z / b).over(down).alias("t"), (4 * (after["vs"] - b) / plus + (1 + 2 * (after["vs"] + b) / plus) * density).alias("r"))
    spikes = layers.select(F.col(model).alias("i3"), F.array(pp, ps).alias("_s")).select("i3", F.inline("_s")).where("r IS NOT NULL")
    p = (F.col("t") - F.lit(float(time.o))) / F.lit(float(time.d))
    part = p - F.floor(p)
    ends = F.array(F.struct(F.floor(p).cast("long").alias("i1"), ((1 - part) * F.col("r")).alias("v")), F.struct((F.floor(p) + 1).cast("long").alias("i1"), (part * F.col("r")).alias("v")))
    found = spikes.select("i2", "i3", F.inline(ends)).groupBy("i1", "i2", "i3").agg(F.sum("v").alias("v"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    frame = layers.select(F.col(model).alias("i3")).distinct().withColumn("i2", every(2)).withColumn("i1", every(time.n))
    df = frame.join(found, ["i1", "i2", "i3"], "left").select("i1", "i2", "i3", F.coalesce("v", F.lit(0.0)).alias("v"))
    return Grid(df, Header((time, Axis(2), Axis())))


def phase_shift_migration(section: Grid, velocities: list[float]) -> Grid:
    """Post-stack time migration by phase shifts through layers: one velocity for each sample of axis 1.

    A wave that cannot travel in a layer is not seen below its top.
    """
    d1, d2 = float(section.axis(1).d), float(section.axis(2).d)

    def kernel(u):
        n2, n1 = u.shape
        nt = 2 * n1
        spectrum = np.fft.fft2(u, (n2, nt))
        f, k = np.fft.fftfreq(nt, d1)[None], np.fft.fftfreq(n2, d2)[:, None]
        phase, image = np.zeros((n2, nt)), np.empty((n2, n1), complex)
        for j, v in enumerate(velocities):
            image[:, j] = (spectrum * np.exp(2j * np.pi * np.sign(f) * phase)).sum(1) / nt
            square = f * f - (v * k / 2) ** 2
            spectrum[square < 0] = 0
            phase += d1 * np.sqrt(np.maximum(square, 0))
        return np.fft.ifft(image, axis=0).real

    return panel.apply(section, kernel)


def source_traces(headers: DataFrame, wavelet: list[float], coordinates: dict[str, str]) -> DataFrame:
    """Source traces of a survey: a row for each header and sample i1 of the wavelet, receiver coordinates set from the named columns."""
    samples = F.posexplode(F.array(*[F.lit(float(x)) for x in wavelet])).alias("i1", "v")
    return headers.withColumns({new: F.col(old) for new, old in coordinates.items()}).select("*", samples)


def plane_wave(spark: SparkSession, receivers: Axis, slopes: Axis, wavelet: list[float], dt: float) -> Grid:
    """Plane-wave sources: the wavelet at times p x, between samples, for each receiver (axis 2) and slope (axis 3); before time 0 nothing."""
    base = spark.range(receivers.n * slopes.n).select((F.col("id") % receivers.n).alias("i2"), F.expr(f"id div {receivers.n}").alias("i3"))
    at = (F.lit(float(receivers.o)) + F.col("i2") * float(receivers.d)) * (F.lit(float(slopes.o)) + F.col("i3") * float(slopes.d)) / F.lit(dt)
    taps = base.withColumn("_t", at).select("i2", "i3", "_t", F.posexplode(F.array(*[F.lit(float(x)) for x in wavelet])).alias("_k", "_v"))
    part = F.col("_t") - F.floor("_t")
    ends = F.array(F.struct((F.floor("_t") + F.col("_k")).cast("long").alias("i1"), ((1 - part) * F.col("_v")).alias("v")), F.struct((F.floor("_t") + F.col("_k") + 1).cast("long").alias("i1"), (part * F.col("_v")).alias("v")))
    found = taps.select("i2", "i3", F.inline(ends)).where("i1 >= 0").groupBy("i1", "i2", "i3").agg(F.sum("v").alias("v"))
    return Grid(found, Header((Axis(None, 0.0, dt), receivers, slopes)))
