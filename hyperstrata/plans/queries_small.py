"""Queries on smoothing, interpolation filters, helices, adaptive filters, spectra and small systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyperstrata.functions import extend
from hyperstrata.functions.header import Axis, Header
from hyperstrata.operators import algebra, frame, helix, interpolate, panel, seismic, traces
from hyperstrata.operators import select as S
from hyperstrata.operators.grid import Grid
from hyperstrata.plans.adapters import VECTORS, panels, panels_sql, table, vectors
from hyperstrata.plans.catalog import query, rounded
from hyperstrata.plans.queries_kernel import dft_sql
from hyperstrata.plans.queries_select import R


def _smooth(name: str, source: str, axis: str, n: int, rect: int, others: str, columns: tuple[str, ...] = ("v",)) -> str:
    """CTE: triangle smoothing of an axis of n samples, edges mirrored."""
    at = f"s.{axis} + m.m"
    near = f"CASE WHEN {at} < 0 THEN -1 - ({at}) WHEN {at} > {n - 1} THEN {2 * n - 1} - ({at}) ELSE {at} END"
    keys = ", ".join(f"s.{c}" for c in others.split(", "))
    same = " AND ".join(f"x.{c} = s.{c}" for c in others.split(", "))
    sums = ", ".join(f"sum(({rect} - abs(m.m)) / {rect * rect}.0::DOUBLE * x.{c}) AS {c}" for c in columns)
    return f"{name} AS (SELECT s.{axis}, {keys}, {sums} FROM {source} s, range({1 - rect}, {rect}) AS m(m), {source} x WHERE x.{axis} = {near} AND {same} GROUP BY ALL)"


_PAIRS = "z AS (SELECT i1 // 2 AS i1, i2, max(CASE WHEN i1 % 2 = 0 THEN v END) AS re, max(CASE WHEN i1 % 2 = 1 THEN v END) AS im FROM g GROUP BY 1, 2)"


@query(f"WITH {VECTORS}, {_PAIRS}, {_smooth('s', 'z', 'i1', 32, 4, 'i2', ('re', 'im'))} SELECT i1, i2, {R('re')} AS re, {R('im')} AS im FROM s")
def csmooth(spark, sf):
    out = frame.smooth_complex(S.to_complex(vectors(spark, sf), pair=True), {1: 4})
    return rounded(out.df.select("i1", "i2", "v.re", "v.im"))


@query(f"WITH {panels_sql(20)}, {_smooth('a', 'g', 'i1', 64, 5, 'i2, i3')}, {_smooth('b', 'a', 'i2', 20, 3, 'i1, i3')} SELECT i1, i2, i3, {R('v')} AS v FROM b")
def smooth_axes(spark, sf):
    return rounded(frame.smooth_axes(panels(spark, sf, 20), {1: 5, 2: 3}).df)


@query(f"WITH {VECTORS}, {_PAIRS} SELECT i1, i2, {R('re')} AS re, {R('im')} AS im FROM z")
def real_imag(spark, sf):
    """The parts of a complex grid, taken apart and joined again."""
    z = S.to_complex(vectors(spark, sf), pair=True)
    return rounded(S.cmplx(S.part(z, "re"), S.part(z, "im")).df.select("i1", "i2", "v.re", "v.im"))


@query(f"""WITH RECURSIVE {VECTORS}, u AS (SELECT 0 AS n, i1, i2, v AS x, v AS y FROM g UNION ALL
SELECT n + 1, i1, i2, x, y + (x - y - 0.2 * (coalesce(lag(d) OVER w, 0) - 2 * d + coalesce(lead(d) OVER w, 0))) / 2.6
FROM (SELECT *, CASE WHEN i1 BETWEEN 1 AND 62 THEN lag(y) OVER q - 2 * y + lead(y) OVER q ELSE 0 END AS d FROM u WHERE n < 50 WINDOW q AS (PARTITION BY i2 ORDER BY i1)) WINDOW w AS (PARTITION BY i2 ORDER BY i1)),
f AS (SELECT i1, i2, lead(y) OVER (PARTITION BY i2 ORDER BY i1) - y AS d FROM u WHERE n = 50)
SELECT i1, i2, {R("coalesce(d, lag(d) OVER (PARTITION BY i2 ORDER BY i1)) / 0.5", 5)} AS v FROM f""")
def smoothder(spark, sf):
    return rounded(traces.smooth_derivative(vectors(spark, sf).put(d1=0.5)).df, 5)


_PLACES = "q AS (SELECT i2, k.k, 0.37 + k.k * 1.53 AS x FROM (SELECT DISTINCT i2 FROM g) _, range(42) AS k(k))"


def _four(kind: str, t: str) -> list[str]:
    near, far = (lambda x: f"(1.5 * pow({x}, 3) - 2.5 * pow({x}, 2) + 1)"), (lambda x: f"(-0.5 * pow({x}, 3) + 2.5 * pow({x}, 2) - 4 * {x} + 2)")
    if kind == "lagrange":
        return [f"{t} * ({t} - 1) * ({t} - 2) / -6", f"({t} + 1) * ({t} - 1) * ({t} - 2) / 2", f"({t} + 1) * {t} * ({t} - 2) / -2", f"({t} + 1) * {t} * ({t} - 1) / 6"]
    if kind == "cubic":
        return [far(f"(1 + {t})"), near(t), near(f"(1 - {t})"), far(f"(2 - {t})")]
    return [f"pow(1 - {t}, 3) / 6", f"(3 * pow({t}, 3) - 6 * pow({t}, 2) + 4) / 6", f"(-3 * pow({t}, 3) + 3 * pow({t}, 2) + 3 * {t} + 1) / 6", f"pow({t}, 3) / 6"]


def _weight(kind: str, t: str, tap: str = "m.m") -> str:
    return f"(CASE {tap} " + " ".join(f"WHEN {k - 1} THEN {w}" for k, w in enumerate(_four(kind, t))) + " END)"


def _inttest1(kind: str) -> str:
    return f"WITH {VECTORS}, {_PLACES}, p AS (SELECT *, x - floor(x) AS t FROM q), w AS (SELECT i2, k, x, CAST(floor(x) AS BIGINT) + m.m AS i1, {_weight(kind, 't')} AS w FROM p, range(-1, 3) AS m(m)) SELECT w.i2, w.k, {R('sum(w * coalesce(v, 0))')} AS v FROM w LEFT JOIN g USING (i1, i2) GROUP BY 1, 2"


def _places(spark, sf):
    lines = vectors(spark, sf).df.select("i2").distinct()
    return lines.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(41).cast("long")))).withColumn("x", F.lit(0.37) + F.col("k") * F.lit(1.53))


def _register_inttest1(kind: str) -> None:
    def run(spark, sf):
        return rounded(interpolate.at_points(vectors(spark, sf), _places(spark, sf), "x", kind).select("i2", "k", "v"))

    query(_inttest1(kind), name=f"inttest1_{kind}")(run)


for _kind in ("lagrange", "cubic", "spline"):
    _register_inttest1(_kind)


@query("SELECT k.k AS kind, CAST(x.i AS BIGINT) AS i1, 1.0::DOUBLE AS mass FROM (VALUES ('cubic'), ('lagrange'), ('spline')) AS k(k), range(20) AS x(i)")
def intshow(spark, sf):
    """The weights of every filter at every place add up to 1."""
    x = F.col("i1") / F.lit(20.0)
    out = None
    for kind in ("cubic", "lagrange", "spline"):
        total = sum(interpolate.weights(kind, x)[1:], interpolate.weights(kind, x)[0])
        df = spark.range(20).select(F.lit(kind).alias("kind"), F.col("id").alias("i1")).withColumn("mass", total)
        out = df if out is None else out.unionAll(df)
    return rounded(out, 9)


@query(f"""WITH {VECTORS}, p AS (SELECT o_orderkey, 2.3 + o_custkey % 59 + (o_orderkey % 4) * 0.17 AS x, 2.1 + o_orderkey % 91 + (o_custkey % 3) * 0.29 AS y FROM orders), t AS (SELECT o_orderkey, CAST(floor(x) AS BIGINT) AS a, CAST(floor(y) AS BIGINT) AS b, x - floor(x) AS x, y - floor(y) AS y FROM p),
w AS (SELECT o_orderkey, a + m.m AS i1, b + n.n AS i2, {_weight('cubic', 'x')} AS wx, {_weight('cubic', 'y', 'n.n')} AS wy FROM t, range(-1, 3) AS m(m), range(-1, 3) AS n(n))
SELECT o_orderkey, {R('sum(wx * wy * coalesce(v, 0))', 5)} AS v FROM w LEFT JOIN g USING (i1, i2) GROUP BY 1""")
def inttest2(spark, sf):
    """The panel of all vectors at two coordinates of each order, by cubic convolution."""
    points = table(spark, sf, "orders").select("o_orderkey", (F.lit(2.3) + F.col("o_custkey") % 59 + (F.col("o_orderkey") % 4) * 0.17).alias("x"), (F.lit(2.1) + F.col("o_orderkey") % 91 + (F.col("o_custkey") % 3) * 0.29).alias("y"))
    grid = vectors(spark, sf)
    return rounded(interpolate.at_points(grid, points, "x", "cubic", "y").select("o_orderkey", "v"), 5)


_LAGS, _TAPS = [1, 63, 64, 65], [-0.5, 0.1, -0.4, 0.2]


@query(f"""WITH {panels_sql(20)}, k AS (SELECT i3, i1 + 64 * i2 AS k, v FROM g), t AS (SELECT * FROM (VALUES (0, 1.0), (1, -0.5), (63, 0.1), (64, -0.4), (65, 0.2)) AS t(lag, a))
SELECT CAST(k.k % 64 AS BIGINT) AS i1, k.k // 64 AS i2, k.i3, {R('sum(t.a * x.v)')} AS v FROM k, t, k AS x WHERE x.i3 = k.i3 AND x.k = k.k - t.lag GROUP BY ALL""")
def helicon(spark, sf):
    return rounded(helix.convolve(panels(spark, sf, 20), _LAGS, _TAPS).df)


@query(f"WITH {panels_sql(20)} SELECT i1, i2, i3, {R('v', 5)} AS v FROM g")
def polydiv(spark, sf):
    """Division on the helix undoes convolution."""
    return rounded(helix.divide(helix.convolve(panels(spark, sf, 20), _LAGS, _TAPS), _LAGS, _TAPS).df, 5)


@query("SELECT true AS adjoint")
def helix_adjoint(spark, sf):
    """<C x, y> = <x, C' y>."""
    x = panels(spark, sf, 20)
    y = x.with_v(F.col("v") * F.cos(F.col("i1") + F.col("i2")))
    a, b = helix.convolve(x, _LAGS, _TAPS).dot(y), x.dot(helix.convolve(y, _LAGS, _TAPS, adjoint=True))
    return spark.range(1).select(F.lit(abs(a - b) <= 1e-9 * max(abs(a), abs(b), 1.0)).alias("adjoint"))


@query(f"""WITH RECURSIVE {VECTORS}, u AS (SELECT 0::BIGINT AS i1, i2, v AS x1, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS a1, 0.0::DOUBLE AS a2, v AS r FROM g WHERE i1 = 0 UNION ALL
SELECT i1, i2, v, x1, a1 - miss / (0.25 + x1 * x1 + x2 * x2) * x1, a2 - miss / (0.25 + x1 * x1 + x2 * x2) * x2, miss * 0.25 / (0.25 + x1 * x1 + x2 * x2)
FROM (SELECT g.i1, g.i2, g.v, u.x1, u.x2, u.a1, u.a2, g.v + u.a1 * u.x1 + u.a2 * u.x2 AS miss FROM u JOIN g ON g.i2 = u.i2 AND g.i1 = u.i1 + 1))
SELECT i1, i2, {R('r', 5)} AS v FROM u""")
def streaming_pef(spark, sf):
    return rounded(helix.streaming_error(vectors(spark, sf), 2, 0.5).df, 5)


@query(f"WITH {VECTORS} SELECT i2, {R('v')} AS v FROM g QUALIFY sum(1 + i1 % 3) OVER (PARTITION BY i2 ORDER BY v, i1) >= sum(1 + i1 % 3) OVER (PARTITION BY i2) / 2.0 AND sum(1 + i1 % 3) OVER (PARTITION BY i2 ORDER BY v, i1) - (1 + i1 % 3) < sum(1 + i1 % 3) OVER (PARTITION BY i2) / 2.0")
def udaf_weighted_median(spark, sf):
    df = vectors(spark, sf).df
    return rounded(df.groupBy("i2").agg(extend.weighted_median("v", (1 + F.col("i1") % 3).cast("double")).alias("v")))


@query("SELECT o_orderkey, k.k AS patch, least(k.k * 4, n - least(10, n)) AS start, least(k.k * 4, n - least(10, n)) + least(10, n) AS stop FROM (SELECT o_orderkey, 7 + o_custkey % 40 AS n FROM orders) o, range(20) AS k(k) WHERE k.k < 1 + ceil((n - least(10, n)) / 4.0)")
def udtf_patches(spark, sf):
    spark.udtf.register("grid_patches", extend.Patches)
    table(spark, sf, "orders").selectExpr("o_orderkey", "7 + o_custkey % 40 AS n").createOrReplaceTempView("grid_lines")
    return spark.sql("SELECT o_orderkey, p.patch, p.start, p.stop FROM grid_lines, LATERAL grid_patches(n, 10L, 4L) p")


_GAUSS = "exp(-10 * (pow((CASE WHEN i1 < 32 THEN i1 ELSE i1 - 64 END) / 64.0, 2) + pow((CASE WHEN i2 < 10 THEN i2 ELSE i2 - 20 END) / 20.0, 2)))"
_FILTERED = ", ".join([
    panels_sql(20), dft_sql("a", "g", 1, 64, real=True), dft_sql("b", "a", 2, 20), f"c AS (SELECT i1, i2, i3, re * {_GAUSS} AS re, im * {_GAUSS} AS im FROM b)",
    dft_sql("d", "c", 2, 20, inverse=True), dft_sql("e", "d", 1, 64, inverse=True),
])


@query(f"WITH {_FILTERED} SELECT i1, i2, i3, {R('re', 5)} AS v FROM e")
def freqfilt2(spark, sf):
    def response(f1, f2):
        import numpy as np

        return np.exp(-10 * (f1**2 + f2**2))

    return rounded(panel.frequency_filter(panels(spark, sf, 20), response).df, 5)


@query(f"WITH {VECTORS} SELECT CAST(k.k AS BIGINT) AS i1, i2, {R('sum(v * cos(2 * pi() * ((i1 * (k.k + 32)) % 64) / 64))', 5)} AS re, {R('-sum(v * sin(2 * pi() * ((i1 * (k.k + 32)) % 64) / 64))', 5)} AS im FROM g, range(64) AS k(k) GROUP BY 1, 2")
def fft3(spark, sf):
    return rounded(traces.fft3(vectors(spark, sf)).df.select("i1", "i2", "v.re", "v.im"), 5)


_CUBIC = "c AS (SELECT i2 * 16 + i1 // 4 AS i2, max(CASE WHEN i1 % 4 = 2 THEN v END) AS c2, max(CASE WHEN i1 % 4 = 3 THEN v + 2.0 END) AS c3 FROM g GROUP BY 1)"


@query(f"WITH {VECTORS}, {_CUBIC} SELECT i2, {R('-c2 / c3', 4)} AS v FROM c")
def roots(spark, sf):
    """The roots of a polynomial add up to its last two coefficients' ratio."""
    short = vectors(spark, sf).df.select(F.expr("i1 % 4").alias("i1"), F.expr("i2 * 16 + i1 div 4").alias("i2"), F.when(F.col("i1") % 4 == 3, F.col("v") + 2.0).otherwise(F.col("v")).alias("v"))
    out = traces.polynomial_roots(Grid(short, Header((Axis(4), Axis()))))
    return rounded(out.df.groupBy("i2").agg(F.sum("v.re").alias("v")), 4)


_MATRIX = "m AS (SELECT i2 AS i3, i1 % 8 AS c, i1 // 8 AS r, v FROM g), a AS (SELECT x.i3, x.c, x.r, x.v + y.v AS v FROM m x JOIN m y ON y.i3 = x.i3 AND y.c = x.r AND y.r = x.c)"


@query(f"WITH {VECTORS}, {_MATRIX} SELECT i3, {R('sum(CASE WHEN r = c THEN v END)', 5)} AS trace, {R('sum(v * v)', 5)} AS squares FROM a GROUP BY 1")
def jacobi(spark, sf):
    """Eigenvalues of symmetric panels add up to the trace, and their squares to those of the panel."""
    df = vectors(spark, sf).df.select((F.col("i1") % 8).alias("i1"), F.expr("i1 div 8").alias("i2"), F.col("i2").alias("i3"), "v")
    both = df.unionAll(df.select(F.col("i2").alias("i1"), F.col("i1").alias("i2"), "i3", "v")).groupBy("i1", "i2", "i3").agg(F.sum("v").alias("v"))
    out = panel.eigenvalues(Grid(both, Header((Axis(8), Axis(8), Axis()))))
    return rounded(out.df.groupBy("i3").agg(F.sum("v").alias("trace"), F.sum(F.col("v") * F.col("v")).alias("squares")), 5)


@query(f"WITH {VECTORS} SELECT i1 // 8 AS r, i2 AS i3, {R('v', 5)} AS b FROM g WHERE i1 % 8 = 7")
def gaussel(spark, sf):
    """A x = b for the systems of all vectors: A times x is b again."""
    v = F.col("v") + F.when(F.col("i1") % 9 == 0, F.lit(3.0)).otherwise(0.0)
    base = vectors(spark, sf).df
    matrix = base.select((F.col("i1") % 8).alias("i1"), F.expr("i1 div 8").alias("i2"), F.col("i2").alias("i3"), v.alias("v"))
    right = base.where("i1 % 8 = 7").select(F.lit(8).cast("long").alias("i1"), F.expr("i1 div 8").alias("i2"), F.col("i2").alias("i3"), "v")
    x = panel.solved(Grid(matrix.unionAll(right), Header((Axis(9), Axis(8), Axis())))).df.select("i1", "i3", F.col("v").alias("x"))
    return rounded(matrix.join(x, ["i1", "i3"]).groupBy(F.col("i2").alias("r"), "i3").agg(F.sum(F.col("v") * F.col("x")).alias("b")), 5)


@query(f"WITH {VECTORS} SELECT {R('sqrt(sum(pow(0.01 * cos(i1), 2))) / sqrt(sum(v * v))')} AS error FROM g")
def compare_traces(spark, sf):
    g = vectors(spark, sf)
    return rounded(algebra.relative_error(g, g.with_v(F.col("v") + F.lit(0.01) * F.cos("i1"))))


@query(f"""WITH {VECTORS}, l AS (SELECT i2 AS i3, i1 AS layer, 20 + 10 * abs(v) AS z, 1500 + 10 * i1 + 200 * v AS vp, 700 + 6 * i1 + 90 * v AS vs, 2 + 0.3 * v AS rho FROM g),
a AS (SELECT i3, sum(2 * z / vp) OVER w AS tp, sum(z / vp + z / vs) OVER w AS ts, lead(vp) OVER w AS p, lead(vs) OVER w AS s, lead(rho) OVER w AS r, vp, vs, rho FROM l WINDOW w AS (PARTITION BY i3 ORDER BY layer)),
s AS (SELECT 0 AS i2, i3, tp / 0.02 AS t, (p - vp) / (p + vp) + (r - rho) / (r + rho) AS v FROM a WHERE p IS NOT NULL UNION ALL SELECT 1, i3, ts / 0.02, 4 * (s - vs) / (p + vp) + (1 + 2 * (s + vs) / (p + vp)) * (r - rho) / (r + rho) FROM a WHERE p IS NOT NULL),
e AS (SELECT i2, i3, CAST(floor(t) AS BIGINT) + e.e AS i1, sum(v * CASE e.e WHEN 0 THEN 1 - (t - floor(t)) ELSE t - floor(t) END) AS v FROM s, range(2) AS e(e) GROUP BY ALL)
SELECT i.i AS i1, CAST(k.k AS BIGINT) AS i2, u.i3, {R('coalesce(e.v, 0)')} AS v FROM range(80) AS i(i), range(2) AS k(k), (SELECT DISTINCT i3 FROM l) u LEFT JOIN e ON e.i1 = i.i AND e.i2 = k.k AND e.i3 = u.i3""")
def modrefl(spark, sf):
    v = F.col("v")
    layers = vectors(spark, sf).df.select(F.col("i2").alias("model"), F.col("i1").alias("layer"), (F.lit(20.0) + 10 * F.abs(v)).alias("thickness"), (F.lit(1500.0) + 10 * F.col("i1") + 200 * v).alias("vp"), (F.lit(700.0) + 6 * F.col("i1") + 90 * v).alias("vs"), (F.lit(2.0) + 0.3 * v).alias("rho"))
    return rounded(seismic.layer_reflections(layers, Axis(80, 0.0, 0.02)).df)
