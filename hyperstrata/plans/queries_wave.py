"""Queries on finer interpolation, lifting, phase-shift migration, sources and small solvers."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis, Header
from hyperstrata.operators import frame, interpolate, inverse, resample, seismic, traces
from hyperstrata.operators.grid import Grid
from hyperstrata.plans.adapters import VECTORS, panels, panels_sql, table, vectors
from hyperstrata.plans.catalog import query, rounded
from hyperstrata.plans.queries_extra import _taps
from hyperstrata.plans.queries_kernel import dft_sql
from hyperstrata.plans.queries_select import R


@query(f"""WITH {VECTORS}, b AS (SELECT i1, i2, v, lead(v) OVER w AS w, lag(v) OVER w - 2 * v + lead(v) OVER w AS b FROM g WINDOW w AS (PARTITION BY i2 ORDER BY i1)), c AS (SELECT *, lead(b) OVER (PARTITION BY i2 ORDER BY i1) AS c FROM b),
q AS (SELECT i.i AS i1, -0.7 + i.i * 0.43 AS p FROM range(150) AS i(i)), t AS (SELECT i1, p - least(greatest(floor(p), 0), 62) AS t, least(greatest(floor(p), 0), 62) AS cell FROM q)
SELECT t.i1, c.i2, {R("v + t * (w - v) + t * (t - 1) / 2 * CASE WHEN b IS NULL THEN c WHEN c IS NULL THEN b WHEN abs(b) <= abs(c) THEN b ELSE c END")} AS v FROM t JOIN c ON c.i1 = t.cell""")
def remap1(spark, sf):
    """Essentially non-oscillating interpolation on a new axis."""
    return rounded(interpolate.eno(vectors(spark, sf), F.lit(-0.7) + F.col("i1") * F.lit(0.43), 150).df)


def _values(name: str, source: str, axis: str, others: str) -> str:
    w = f"OVER (PARTITION BY {others} ORDER BY {axis})"
    return f"{name} AS (SELECT i1, i2, i3, (4 * v + coalesce(lag(v) {w}, lead(v) {w}) + coalesce(lead(v) {w}, lag(v) {w})) / 6 AS v FROM {source})"


@query(f"WITH {panels_sql(20)}, {_values('a', 'g', 'i1', 'i2, i3')}, {_values('b', 'a', 'i2', 'i1, i3')} SELECT i1, i2, i3, {R('v')} AS v FROM b")
def postfilter2(spark, sf):
    return rounded(interpolate.spline_values(panels(spark, sf, 20), (1, 2)).df)


@query(f"WITH {VECTORS} SELECT i1, i2, {R('v', 5)} AS v FROM g")
def splinefilter(spark, sf):
    """The spline of the coefficients goes through the samples."""
    return rounded(interpolate.spline_values(interpolate.spline_coefficients(vectors(spark, sf))).df, 5)


@query(f"WITH {VECTORS} SELECT i1, i2, {R('v', 5)} AS v FROM g")
def lifting_round_trip(spark, sf):
    return rounded(traces.lifting(traces.lifting(vectors(spark, sf)), inverse=True).df, 5)


@query(f"WITH {VECTORS}, e AS (SELECT i2, i1 // 2 AS i1, max(CASE WHEN i1 % 2 = 0 THEN v END) AS e, max(CASE WHEN i1 % 2 = 1 THEN v END) AS o FROM g GROUP BY 1, 2) SELECT i1 + 32 AS i1, i2, {R('o - (e + coalesce(lead(e) OVER (PARTITION BY i2 ORDER BY i1), e)) / 2')} AS v FROM e")
def lifting_details(spark, sf):
    """The finest details of the linear lifting."""
    return rounded(traces.lifting(vectors(spark, sf)).df.where("i1 >= 32"))


@query(f"WITH {panels_sql(20)} SELECT i1, i2, i3, {R('v')} AS v FROM ({_taps('SELECT i1, i2, i3, i1 + (0.1 + i2 * 0.03) / (2.0 * 0.01) AS p FROM g', 'i2, i3')})")
def lmostretch(spark, sf):
    return rounded(resample.linear_moveout(panels(spark, sf, 20, 0.01).put(o2=0.1, d2=0.03), 2.0).df)


_LAYERS = [1.3 + 0.01 * j for j in range(64)]
_GAZDAG = ", ".join([
    panels_sql(20), dft_sql("a", "g", 1, 128, real=True), dft_sql("b", "a", 2, 20),
    "s AS (SELECT f.f AS i1, k.k AS i2, j.j, sign(CASE WHEN f.f < 64 THEN f.f ELSE f.f - 128 END) AS side, pow((CASE WHEN f.f < 64 THEN f.f ELSE f.f - 128 END) / 1.28, 2) - pow((1.3 + 0.01 * j.j) * (CASE WHEN k.k < 10 THEN k.k ELSE k.k - 20 END) / 1.46 / 2, 2) AS s FROM range(128) AS f(f), range(20) AS k(k), range(64) AS j(j))",
    "p AS (SELECT i1, i2, j, side, coalesce(sum(0.01 * sqrt(greatest(s, 0))) OVER w, 0) AS p, coalesce(min(s) OVER w, 0) AS least FROM s WINDOW w AS (PARTITION BY i1, i2 ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
    "m AS (SELECT CAST(p.j AS BIGINT) AS i1, p.i2, b.i3, sum(re * cos(2 * pi() * side * p) - im * sin(2 * pi() * side * p)) / 128 AS re, sum(re * sin(2 * pi() * side * p) + im * cos(2 * pi() * side * p)) / 128 AS im FROM p JOIN b USING (i1, i2) WHERE least >= 0 GROUP BY ALL)",
    dft_sql("n", "m", 2, 20, inverse=True),
])


@query(f"WITH {_GAZDAG} SELECT i1, i2, i3, {R('re', 5)} AS v FROM n")
def gazdag(spark, sf):
    return rounded(seismic.phase_shift_migration(panels(spark, sf, 20, 0.01, 0.073), _LAYERS).df, 5)


@query(f"WITH {panels_sql(20)} SELECT i1, i2, i3, {R('coalesce(lead(v) OVER (PARTITION BY i1, i3 ORDER BY i2) - v, 0) / 0.25')} AS v FROM g")
def grid_derivative(spark, sf):
    return rounded(frame.grid_derivative(panels(spark, sf, 20, 1.0, 0.25), 2).df)


@query("SELECT * FROM (VALUES (1, true), (2, true)) AS t(axis, adjoint)")
def grid_derivative_adjoint(spark, sf):
    """<D x, y> = <x, D' y> along both axes."""
    x, rows = panels(spark, sf, 20, 0.5, 0.25), []
    y = x.with_v(F.col("v") * F.cos(F.col("i1") + 2 * F.col("i2")))
    for axis in (1, 2):
        a, b = frame.grid_derivative(x, axis).dot(y), x.dot(frame.grid_derivative(y, axis, adjoint=True))
        rows.append((axis, abs(a - b) <= 1e-9 * max(abs(a), abs(b), 1.0)))
    return spark.createDataFrame(rows, "axis int, adjoint boolean")


_PULSE = [0.2, 1.0, -0.7, 0.1]


@query("SELECT o_orderkey, o_custkey, o_custkey AS gx, CAST(o_orderkey AS BIGINT) AS gelev, k.k AS i1, CASE k.k WHEN 0 THEN 0.2 WHEN 1 THEN 1.0 WHEN 2 THEN -0.7 ELSE 0.1 END::DOUBLE AS v FROM orders, range(4) AS k(k)")
def towed_array(spark, sf):
    headers = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return seismic.source_traces(headers, _PULSE, {"gx": "o_custkey", "gelev": "o_orderkey"}).withColumn("i1", F.col("i1").cast("long"))


@query(f"""WITH t AS (SELECT r.r AS i2, p.p AS i3, (0.1 + r.r * 0.037) * (-0.1 + p.p * 0.053) / 0.004 AS t FROM range(30) AS r(r), range(8) AS p(p)), k AS (SELECT *, CASE k WHEN 0 THEN 0.2 WHEN 1 THEN 1.0 WHEN 2 THEN -0.7 ELSE 0.1 END AS v FROM t, range(4) AS k(k))
SELECT CAST(floor(t) AS BIGINT) + k + e.e AS i1, i2, i3, {R("sum(v * CASE e.e WHEN 0 THEN 1 - (t - floor(t)) ELSE t - floor(t) END)")} AS v FROM k, range(2) AS e(e) WHERE floor(t) + k + e.e >= 0 GROUP BY ALL""")
def planewave(spark, sf):
    return rounded(seismic.plane_wave(spark, Axis(30, 0.1, 0.037), Axis(8, -0.1, 0.053), _PULSE, 0.004).df.select("i1", "i2", "i3", "v"))


def _mapped(df, kernel, schema):
    """Rows through ``kernel(pandas frame) -> pandas frame``, batch by batch."""

    def run(frames):
        for f in frames:
            yield kernel(f)

    return df.mapInPandas(run, schema)


@query(f"SELECT o_orderkey, {R('(o_custkey % 300) / 100.0', 6)} AS mean FROM orders")
def fzero(spark, sf):
    """Kepler's equation for each order: the root's mean anomaly is the one asked for."""
    asked = table(spark, sf, "orders").select("o_orderkey", ((F.col("o_custkey") % 300) / F.lit(100.0)).alias("mean"))

    def kernel(f):
        import numpy as np

        from hyperstrata.functions import solve

        m = f["mean"].to_numpy()
        x = solve.zeros(lambda e: e - 0.4 * np.sin(e) - m, m - 1, m + 1)
        return f[["o_orderkey"]].assign(mean=x - 0.4 * np.sin(x))

    return rounded(_mapped(asked, kernel, "o_orderkey long, mean double"), 6)


@query(f"WITH {VECTORS}, s AS (SELECT i2, max(CASE WHEN i1 % 2 = 0 THEN v END) AS x, max(CASE WHEN i1 % 2 = 1 THEN v END) AS u, i1 // 2 AS i1 FROM g GROUP BY i2, i1 // 2) SELECT i1, i2, {R('x * cos(1.0) + u * sin(1.0)', 4)} AS x, {R('u * cos(1.0) - x * sin(1.0)', 4)} AS u FROM s")
def runge(spark, sf):
    """An oscillator from each pair of samples turns by one radian in unit time."""
    pairs = vectors(spark, sf).df.groupBy(F.expr("i1 div 2").alias("i1"), "i2").agg(F.max(F.when(F.col("i1") % 2 == 0, F.col("v"))).alias("x"), F.max(F.when(F.col("i1") % 2 == 1, F.col("v"))).alias("u"))

    def kernel(f):
        import numpy as np

        from hyperstrata.functions import solve

        out = solve.integrate(lambda y: np.stack([y[1], -y[0]]), np.stack([f["x"], f["u"]]), 1.0, 200)
        return f.assign(x=out[0], u=out[1])

    return rounded(_mapped(pairs, kernel, "i1 long, i2 long, x double, u double"), 4)


_UNDONE = f"WITH {VECTORS}, w AS (SELECT i1 % 4 AS i1, i2 * 16 + i1 // 4 AS i2, v + 1.0 AS d FROM g) SELECT i1, i2, {R('d - coalesce(lag(d) OVER (PARTITION BY i2 ORDER BY i1), 0)', 4)} AS v FROM w"


def _integrated(spark, sf):
    """Short lines, to be found again from their causal integrals."""
    short = vectors(spark, sf).df.select(F.expr("i1 % 4").alias("i1"), F.expr("i2 * 16 + i1 div 4").alias("i2"), (F.col("v") + 1.0).alias("v"))
    return Grid(short, Header((Axis(4), Axis())))


@query(_UNDONE)
def conjugate_directions(spark, sf):
    data = _integrated(spark, sf)
    return rounded(inverse.conjugate_directions(inverse.causal_integration, data, data.with_v(F.lit(0.0)), 5).df, 4)


@query(_UNDONE)
def preconditioned(spark, sf):
    data = _integrated(spark, sf)
    return rounded(inverse.preconditioned(inverse.causal_integration, inverse.convolution([1.0, -0.5]), data, data.with_v(F.lit(0.0)), 5).df, 4)
