"""Geometry, moveout, migration and amplitude queries on the vectors as panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis, Header
from hyperstrata.operators import seismic as S
from hyperstrata.operators.grid import Grid
from hyperstrata.plans.adapters import VECTORS, panels, panels_sql, table, vectors
from hyperstrata.plans.catalog import query, rounded
from hyperstrata.plans.queries_kernel import dft_sql, filled_sql
from hyperstrata.plans.queries_select import R

_CUBE = "q AS (SELECT i1, i2 % 6 AS i2, i2 // 6 AS i3, v FROM g)"


def _cube(spark, sf):
    """All vectors as gathers of 6 offsets: axis 3 is the midpoint."""
    df = vectors(spark, sf).df.select("i1", (F.col("i2") % 6).alias("i2"), F.expr("i2 div 6").alias("i3"), "v")
    n3 = (df.agg(F.max("i3")).first()[0] or 0) + 1
    return Grid(df, Header((Axis(64, 0.0, 0.01), Axis(6, -0.25, 0.1), Axis(n3, 0.0, 0.1))))


def _panels(spark, sf):
    return panels(spark, sf, 24, 0.01, 0.05)


_SHOTS = "f AS (SELECT a.i AS i1, b.i AS i2, c.i AS i3 FROM range(64) AS a(i), range(6) AS b(i), range((SELECT max(i3) + 6 FROM q)) AS c(i))"


@query(f"WITH {VECTORS}, {_CUBE}, {_SHOTS} SELECT f.i1, f.i2, f.i3, coalesce(q.v, 0.0) AS v FROM f LEFT JOIN q ON q.i1 = f.i1 AND q.i2 = f.i2 AND q.i3 = f.i3 + f.i2 - 5")
def cmp2shot(spark, sf):
    cube = _cube(spark, sf)
    return S.cmp_to_shot(cube, cube.axis(3).n + 5).df


@query(f"WITH {VECTORS}, {_CUBE}, {_SHOTS} SELECT f.i1, f.i2, f.i3, coalesce(q.v, 0.0) AS v FROM f LEFT JOIN q ON q.i1 = f.i1 AND q.i2 = f.i2 AND q.i3 = f.i3 - f.i2 + 5")
def shot2cmp(spark, sf):
    cube = _cube(spark, sf)
    return S.shot_to_cmp(cube, cube.axis(3).n + 5).df


@query("WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) SELECT o_orderkey, round(o_totalprice / 2 + 10 * n + (5 + n * 0.5), 4) + 0.0 AS v FROM n")
def headermath_number(spark, sf):
    """A header key from other keys, the trace number and its coordinate."""
    df = S.header_math(table(spark, sf, "orders"), "o_totalprice/2 + 10*N + T", "v", ["o_orderkey"], 5.0, 0.5)
    return rounded(df.select("o_orderkey", "v"), 4)


_VZ = "w AS (SELECT i1, i2, v, 2 * coalesce(sum(10.0 / (1500.0 + 20.0 * i1)) OVER (PARTITION BY i2 ORDER BY i1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS t FROM g)"


def _velocity(spark, sf):
    g = vectors(spark, sf).put(d1=10.0)
    return g, g.with_v(F.lit(1500.0) + 20.0 * F.col("i1"))


@query(f"""WITH {VECTORS}, {_VZ}, k AS (SELECT *, lead(t) OVER (PARTITION BY i2 ORDER BY t) AS nt, lead(v) OVER (PARTITION BY i2 ORDER BY t) AS nv FROM w),
o AS (SELECT i.i AS i1, i.i * 0.00731 AS at, u.i2 FROM range(70) AS i(i), (SELECT DISTINCT i2 FROM g) u)
SELECT o.i1, o.i2, {R("CASE WHEN o.at <= k.t OR k.nt IS NULL THEN k.v ELSE k.v + (o.at - k.t) * (k.nv - k.v) / (k.nt - k.t) END")} AS v FROM o JOIN k ON o.i2 = k.i2 AND o.at >= k.t AND (k.nt IS NULL OR o.at < k.nt)""")
def depth2time(spark, sf):
    data, velocity = _velocity(spark, sf)
    return rounded(S.depth_to_time(data, velocity, Axis(70, 0.0, 0.00731)).select("i1", "i2", "v"))


@query(f"""WITH {VECTORS}, {_VZ}, p AS (SELECT i1, i2, t / 0.00731 AS p FROM w)
SELECT p.i1, p.i2, {R("coalesce(a.v, 0) * (1 - (p - floor(p))) + CASE WHEN p > floor(p) THEN coalesce(b.v, 0) * (p - floor(p)) ELSE 0 END")} AS v FROM p LEFT JOIN g a ON a.i2 = p.i2 AND a.i1 = floor(p) LEFT JOIN g b ON b.i2 = p.i2 AND b.i1 = floor(p) + 1""")
def time2depth(spark, sf):
    data, velocity = _velocity(spark, sf)
    return rounded(S.time_to_depth(data.put(d1=0.00731), velocity).df)


@query(f"""WITH {VECTORS}, p AS (SELECT l_suppkey AS s, l_quantity / 10 AS x, l_linenumber * 1.0 AS y, l_extendedprice / 1000 AS t0, sqrt(pow(l_extendedprice / 1000, 2) + 0.3 * pow(l_quantity / 10, 2) + 2 * 0.1 * (l_quantity / 10) * l_linenumber + 0.5 * pow(l_linenumber, 2)) AS t FROM lineitem)
SELECT DISTINCT s AS l_suppkey, 0.3 AS wx, 0.1 AS wxy, 0.5 AS wy FROM p""")
def nmow_fit(spark, sf):
    """Recover an elliptical moveout from picks made with it."""
    x, y, t0 = F.col("l_quantity") / 10, F.col("l_linenumber") * F.lit(1.0), F.col("l_extendedprice") / 1000
    picks = table(spark, sf, "lineitem").select("l_suppkey", x.alias("x"), y.alias("y"), t0.alias("t0"), F.sqrt(t0 * t0 + 0.3 * x * x + 0.2 * x * y + 0.5 * y * y).alias("t"))
    return rounded(S.moveout_fit(picks, ["l_suppkey"], "t", "t0", "x", "y"), 4)


@query(f"""WITH {panels_sql(24)}, q AS (SELECT i1, i2, i3, v FROM g), c AS (SELECT q.i1, q.i2, q.i3, CAST(floor(0.5 + sqrt((i1 * 0.01) * (i1 * 0.01) + (s.s * 0.05 * (2.0 / 1.87)) * (s.s * 0.05 * (2.0 / 1.87))) / 0.01) AS BIGINT) AS j, q.i2 + s.s AS y FROM q, (SELECT range - 5 AS s FROM range(11)) s)
SELECT c.i1, c.i2, c.i3, {R("sum(q.v)")} AS v FROM c JOIN q ON q.i1 = c.j AND q.i2 = c.y AND q.i3 = c.i3 GROUP BY 1, 2, 3""")
def kirchhoff(spark, sf):
    return rounded(S.kirchhoff_time(_panels(spark, sf), 1.87, 5).df)


@query("SELECT true AS adjoint")
def kirchhoff_dottest(spark, sf):
    from hyperstrata.operators.inverse import Operator, dot_test

    g = _panels(spark, sf)
    op = Operator(lambda m: S.kirchhoff_time(m, 1.87, 5), lambda d: S.kirchhoff_time(d, 1.87, 5, adjoint=True))
    a, b = dot_test(op, g, g)
    return spark.createDataFrame([(abs(a - b) <= 1e-9 * max(abs(a), 1.0),)], "adjoint boolean")


_STOLT = ", ".join([
    panels_sql(32), dft_sql("a", "g", 1, 128, real=True), dft_sql("b", "a", 2, 32),
    "w AS (SELECT k.k AS i1, l.l AS i2, (CASE WHEN k.k < 64 THEN k.k ELSE k.k - 128 END) * (1 / (128 * 0.01::DOUBLE)) AS w, (CASE WHEN l.l < 16 THEN l.l ELSE l.l - 32 END) * (1 / (32 * 0.05::DOUBLE)) AS k FROM range(128) AS k(k), range(32) AS l(l))",
    "s AS (SELECT *, sign(w) * sqrt(w * w + k * k) AS s FROM w)",
    "p AS (SELECT *, s * 128 * 0.01::DOUBLE AS p, CASE WHEN s = 0 THEN 1.0 ELSE abs(w) / abs(s) END AS j FROM s)",
    "q AS (SELECT i1, i2, (CAST(floor(p) AS BIGINT) + e.e + 256) % 128 AS at, j * CASE e.e WHEN 0 THEN 1 - (p - floor(p)) ELSE p - floor(p) END AS c FROM p, range(2) AS e(e) WHERE abs(p) < 63)",
    "m AS (SELECT q.i1, q.i2, b.i3, sum(c * re) AS re, sum(c * im) AS im FROM q JOIN b ON b.i1 = q.at AND b.i2 = q.i2 GROUP BY 1, 2, 3)",
    dft_sql("n", "m", 2, 32, inverse=True), dft_sql("o", "n", 1, 128, inverse=True, out=64),
])


@query(f"WITH {_STOLT} SELECT i1, i2, i3, {R('re', 5)} AS v FROM o")
def stolt(spark, sf):
    return rounded(S.stolt(panels(spark, sf, 32, 0.01, 0.05), 2.0).df, 5)


@query(f"""WITH {panels_sql(24)}, p AS (SELECT i.i AS i1, k.i AS i2, u.i3, ((0.1 + k.i * 0.21) * (i.i * 0.01)) / 0.05 AS p FROM range(64) AS i(i), range(8) AS k(i), (SELECT DISTINCT i3 FROM g) u)
SELECT p.i1, p.i2, p.i3, {R("coalesce(a.v, 0) * (1 - (p - floor(p))) + coalesce(b.v, 0) * (p - floor(p))")} AS v FROM p LEFT JOIN g a ON a.i1 = p.i1 AND a.i3 = p.i3 AND a.i2 = floor(p) LEFT JOIN g b ON b.i1 = p.i1 AND b.i3 = p.i3 AND b.i2 = floor(p) + 1""")
def radial(spark, sf):
    return rounded(S.radial(_panels(spark, sf), Axis(8, 0.1, 0.21)).df)


@query(f"""WITH {VECTORS}, q AS (SELECT i1, i2, v FROM g), p AS (SELECT i1, i2, k.i AS i3, i1 + (-1.3) + k.i * 0.65 AS p FROM q, range(5) AS k(i))
SELECT p.i1, p.i2, p.i3, {R("CASE WHEN p >= 0 AND p <= 63 THEN coalesce(a.v, 0) * (1 - (p - floor(p))) + coalesce(b.v, 0) * (p - floor(p)) ELSE 0.0 END")} AS v FROM p LEFT JOIN q a ON a.i2 = p.i2 + 1 AND a.i1 = floor(p) LEFT JOIN q b ON b.i2 = p.i2 + 1 AND b.i1 = floor(p) + 1""")
def shifts(spark, sf):
    return rounded(S.shifts(vectors(spark, sf), Axis(5, -1.3, 0.65)).df)


@query(f"""WITH {VECTORS}, p AS (SELECT o.i1, u.i2, (tan(radians(0.0 + o.i1 * 1.3)) - 0.0) / 0.05 AS p FROM range(30) AS o(i1), (SELECT DISTINCT i2 FROM g) u)
SELECT p.i1, p.i2, {R("CASE WHEN p >= 0 AND p <= 63 THEN coalesce(a.v * (1 - (p - floor(p))), 0.0) + CASE WHEN p > floor(p) THEN b.v * (p - floor(p)) ELSE 0.0 END ELSE 0.0 END")} AS v FROM p LEFT JOIN g a ON a.i2 = p.i2 AND a.i1 = floor(p) LEFT JOIN g b ON b.i2 = p.i2 AND b.i1 = floor(p) + 1""")
def tan2ang(spark, sf):
    return rounded(S.remap_angle(vectors(spark, sf).put(d1=0.05), "tan", Axis(30, 0.0, 1.3)).df)


@query(f"SELECT i.i AS i1, {R('ln(1 + (0.6 / 1500.0) * (i.i * 25.0)) / 0.6')} AS t, {R('acosh(greatest(1 + 0.36 * (1000.0 * 1000.0 + (i.i * 25.0) * (i.i * 25.0)) / (2 * 1500.0 * (1500.0 + 0.6 * (i.i * 25.0))), 1)) / 0.6')} AS ray FROM range(80) AS i(i)")
def vofz(spark, sf):
    """Vertical and two-point traveltimes where velocity grows with depth."""
    z = F.col("id") * 25.0
    return rounded(spark.range(80).select(F.col("id").alias("i1"), S.linear_velocity_time(z, 1500.0, 0.6).alias("t"), S.gradient_time(F.lit(1000.0), z, 1500.0, 0.6).alias("ray")))


@query(f"SELECT CAST(0 AS BIGINT) AS i1, {R('(2.4 * 3000 - 2.2 * 2500) / (2.4 * 3000 + 2.2 * 2500)')} AS v")
def zoeppritz_normal(spark, sf):
    """At normal incidence the coefficient is the contrast of impedances."""
    return rounded(spark.range(1).select(F.col("id").alias("i1"), S.zoeppritz_pp(F.radians(F.lit(0.0)), 2500, 1200, 2.2, 3000, 1500, 2.4).alias("v")))


@query(f"""WITH t AS (SELECT i, sin(radians(i)) / 2500 AS p FROM range(50) AS i(i)), c AS (SELECT *, sqrt(1 - pow(p * 2500, 2)) / 2500 AS a1, sqrt(1 - pow(p * 3000, 2)) / 3000 AS a2, sqrt(1 - pow(p * 1200, 2)) / 1200 AS b1, sqrt(1 - pow(p * 1500, 2)) / 1500 AS b2, 2.2 * 1200 * 1200 AS m1, 2.4 * 1500 * 1500 AS m2 FROM t),
k AS (SELECT *, (2.4 - 2 * m2 * p * p) - (2.2 - 2 * m1 * p * p) AS a, 2.4 - 2 * (m2 - m1) * p * p AS b, 2.2 + 2 * (m2 - m1) * p * p AS c, 2 * (m2 - m1) AS d FROM c)
SELECT i AS i1, {R("((b * a1 - c * a2) * (b * b1 + c * b2) - (a + d * a1 * b2) * (a - d * a2 * b1) * p * p) / ((b * a1 + c * a2) * (b * b1 + c * b2) + (a - d * a1 * b2) * (a - d * a2 * b1) * p * p)")} AS v FROM k""")
def zoeppritz(spark, sf):
    return rounded(spark.range(50).select(F.col("id").alias("i1"), S.zoeppritz_pp(F.radians(F.col("id").cast("double")), 2500, 1200, 2.2, 3000, 1500, 2.4).alias("v")))


@query("""WITH t AS (SELECT u.i AS i2, (0.05 + u.i * 0.0137) / 0.01 AS p FROM range(20) AS u(i)), s AS (SELECT i2, CAST(floor(p) AS BIGINT) AS i1, 1 - (p - floor(p)) AS v FROM t UNION ALL SELECT i2, CAST(floor(p) AS BIGINT) + 1, p - floor(p) FROM t)
SELECT a.i AS i1, b.i AS i2, round(coalesce(s.v, 0.0), 6) + 0.0 AS v FROM range(40) AS a(i) CROSS JOIN range(20) AS b(i) LEFT JOIN s ON s.i1 = a.i AND s.i2 = b.i""")
def moveout_spikes(spark, sf):
    times = Grid(spark.range(20).select(F.col("id").alias("i1"), (F.lit(0.05) + F.col("id") * 0.0137).alias("v")), Header((Axis(20),)))
    return rounded(S.moveout_spikes(times, Axis(40, 0.0, 0.01)).df)


@query(f"""WITH {VECTORS}, p AS (SELECT i1, i2, i1 * 0.913 + 1.27 AS p FROM g), s AS (SELECT p.i2, CAST(floor(p) AS BIGINT) AS j, 1 - (p - floor(p)) AS w, g.v FROM p JOIN g USING (i1, i2) UNION ALL SELECT p.i2, CAST(floor(p) AS BIGINT) + 1, p - floor(p), g.v FROM p JOIN g USING (i1, i2)),
c AS (SELECT i2, j, sum(v * w) / sum(w) AS v FROM s WHERE w > 0 AND j BETWEEN 0 AND 63 GROUP BY 1, 2) SELECT a.i AS i1, u.i2, {R("coalesce(c.v, 0.0)")} AS v FROM range(64) AS a(i) CROSS JOIN (SELECT DISTINCT i2 FROM g) u LEFT JOIN c ON c.i2 = u.i2 AND c.j = a.i""")
def iwarp_inverse(spark, sf):
    g = vectors(spark, sf)
    return rounded(S.warp(g, g.with_v(F.col("i1") * 0.913 + 1.27), inverse=True).df)


def _best_path(width: int, gate: int) -> str:
    """The best sums time by time, each with the velocity it came from (equal ones: the smaller step), read back from the end."""
    steps = sorted(range(-gate, gate + 1), key=abs)
    came = {m: f"{'t' if m == 0 else f'lag(t, {m}) OVER w' if m > 0 else f'lead(t, {-m}) OVER w'} - {m * m}" for m in steps}
    best = f"greatest({', '.join(came.values())})"
    origin = "CASE " + " ".join(f"WHEN {came[m]} = {best} THEN i2 - ({m})" for m in steps) + " END"
    return f"""WITH RECURSIVE {panels_sql(width)}, {filled_sql(64, width)}, p AS (SELECT i1, i2, i3, v AS t, 0::BIGINT AS o FROM f WHERE i1 = 0 UNION ALL
SELECT f.i1, f.i2, f.i3, b.t + f.v, b.o FROM (SELECT i1, i2, i3, {best} AS t, {origin} AS o FROM p WINDOW w AS (PARTITION BY i3 ORDER BY i2)) b JOIN f ON f.i1 = b.i1 + 1 AND f.i2 = b.i2 AND f.i3 = b.i3),
e AS (SELECT i3, min(i2) AS i2 FROM (SELECT i3, i2, t, max(t) OVER (PARTITION BY i3) AS m FROM p WHERE i1 = 63) WHERE t = m GROUP BY 1),
b AS (SELECT 63::BIGINT AS i1, i2, i3 FROM e UNION ALL SELECT b.i1 - 1, p.o, b.i3 FROM b JOIN p ON p.i1 = b.i1 AND p.i2 = b.i2 AND p.i3 = b.i3 WHERE b.i1 > 0)
SELECT i1, 0::BIGINT AS i2, i3, CAST(i2 AS DOUBLE) AS v FROM b"""


@query(_best_path(24, 3))
def automatic_pick(spark, sf):
    return S.automatic_pick(panels(spark, sf, 24, 0.01, 0.05)).df
