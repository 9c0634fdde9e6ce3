"""Queries on weights, velocity, warping, acquisition and gradients; all vectors take part."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis, Header
from hyperstrata.operators import acquire as A
from hyperstrata.operators import algebra, frame, seismic
from hyperstrata.operators import velocity as V
from hyperstrata.operators import weights as W
from hyperstrata.operators.grid import Grid
from hyperstrata.operators.select import to_complex
from hyperstrata.plans.adapters import LINE_ORDER, VECTORS, gathers, panels, panels_sql, table, vectors
from hyperstrata.plans.catalog import query, rounded
from hyperstrata.plans.queries_select import R

_EPS = repr(W._EPS)


def _taps(asked: str, lines: str = "i2", n: int = 64) -> str:
    """SQL: the value between two samples of g at place p of each asked row, 0 outside."""
    same = " AND ".join(f"{{0}}.{c} = q.{c}" for c in lines.split(", "))
    return f"""SELECT q.*, CASE WHEN p >= 0 AND p <= {n - 1} THEN coalesce(a.v, 0) * (1 - (p - floor(p))) + coalesce(b.v, 0) * (p - floor(p)) ELSE 0.0 END AS v
FROM ({asked}) q LEFT JOIN g a ON {same.format('a')} AND a.i1 = CAST(floor(p) AS BIGINT) LEFT JOIN g b ON {same.format('b')} AND b.i1 = CAST(floor(p) AS BIGINT) + 1"""


def _places(p: str, n: int) -> str:
    return f"SELECT i.i AS i1, u.i2, {p} AS p FROM range({n}) AS i(i), (SELECT DISTINCT i2 FROM g) u"


def _cube_gradient() -> str:
    parts = []
    for k in (1, 2, 3):
        w = {j: f"OVER (PARTITION BY {', '.join(f'i{m}' for m in (1, 2, 3) if m != j)} ORDER BY i{j})" for j in (1, 2, 3)}
        a, b = [j for j in (1, 2, 3) if j != k]
        parts.append(f"""d{k} AS (SELECT i1, i2, i3, v, lead(v) {w[k]} - lag(v) {w[k]} AS d FROM q),
e{k} AS (SELECT *, lag(d) {w[a]} + lead(d) {w[a]} AS e, lag(d) {w[b]} + lead(d) {w[b]} AS f FROM d{k}),
h{k} AS (SELECT i1, i2, i3, 4 * (d + e + f + lag(e) {w[b]} + lead(e) {w[b]}) - 3 * (lag(e) {w[b]} + lead(e) {w[b]}) AS g{k} FROM e{k})""")
    return ",\n".join(parts)


@query(f"WITH {VECTORS}, q AS (SELECT i1, i2 % 10 AS i2, i2 // 10 AS i3, v FROM g),\n{_cube_gradient()}\nSELECT i1, i2, i3, {R('coalesce(g1 * g1 + g2 * g2 + g3 * g3, 0.0)')} AS v FROM h1 JOIN h2 USING (i1, i2, i3) JOIN h3 USING (i1, i2, i3)")
def grad3(spark, sf):
    df = vectors(spark, sf).df.select("i1", (F.col("i2") % 10).alias("i2"), F.expr("i2 div 10").alias("i3"), "v")
    return rounded(frame.sobel3(Grid(df, Header((Axis(64), Axis(10), Axis())))).df)


@query(f"""WITH {VECTORS}, d AS (SELECT i1, i2, lead(v) OVER (PARTITION BY i2 ORDER BY i1) - v AS a, lead(v) OVER (PARTITION BY i1 ORDER BY i2) - v AS b FROM g)
SELECT i1, i2, {R('CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE a END')} AS g1, {R('CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE b END')} AS g2 FROM d""")
def igrad2(spark, sf):
    return rounded(frame.forward_gradient(vectors(spark, sf)))


@query(f"""WITH {VECTORS}, c AS (SELECT i1, i2, sum(v) OVER (PARTITION BY i2 ORDER BY i1) AS v FROM g) SELECT i1, i2, {R('sum(v) OVER (PARTITION BY i2 ORDER BY i1 DESC)', 4)} AS v FROM c""")
def doubint(spark, sf):
    """Causal, then anticausal integration."""
    return rounded(frame.causint(frame.causint(vectors(spark, sf)), adjoint=True).df, 4)


@query(f"WITH {VECTORS} SELECT i1, {R('sum(v * ((i1 + 1.0) / (i2 + 1.0)))', 5)} AS v FROM g GROUP BY 1")
def weight2(spark, sf):
    g = vectors(spark, sf)
    w = g.df.select("i1", "i2", ((F.col("i1") + 1.0) / (F.col("i2") + 1.0)).alias("w"))
    return rounded(W.weighted_components(g, w, 2).df, 5)


_MEDIAN = "m AS (SELECT abs(v) AS m FROM g QUALIFY row_number() OVER (ORDER BY abs(v)) = (SELECT count(*) FROM g) // 2 + 1)"


@query(f"WITH {VECTORS}, {_MEDIAN} SELECT i1, i2, {R('1 / sqrt(sqrt(1 + (v / m) * (v / m)))')} AS v FROM g, m")
def irls_l1(spark, sf):
    return rounded(W.robust_weights(vectors(spark, sf)).df)


@query(f"WITH {VECTORS}, {_MEDIAN} SELECT i1, i2, {R('1 / sqrt(1 + (v / m) * (v / m))')} AS v FROM g, m")
def irls_cauchy(spark, sf):
    return rounded(W.robust_weights(vectors(spark, sf), "cauchy").df)


@query(f"""WITH {VECTORS}, w AS (SELECT max(abs(v)) * {_EPS} AS least FROM g), s AS (SELECT abs(v) AS s FROM g QUALIFY row_number() OVER (ORDER BY abs(v)) = CAST(floor((SELECT count(*) FROM g) * 50.0 * 0.01) AS BIGINT) + 1)
SELECT i1, i2, {R('v * exp(-0.5 * s * s / ((abs(v) + least) * (abs(v) + least))) * exp(-0.5 * s * s / ((abs(v) + least) * (abs(v) + least)))')} AS v FROM g, w, s""")
def sharpen(spark, sf):
    return rounded(W.sharpen(vectors(spark, sf)).df)


@query(f"SELECT a.i AS i1, b.i AS i2, {R('0.5 * (1 - cos(2 * pi() * (a.i + 1) / 13)) * 0.5 * (1 - cos(2 * pi() * (b.i + 1) / 10))')} AS v FROM range(12) AS a(i), range(9) AS b(i)")
def tent2(spark, sf):
    return rounded(W.tent(spark, Header((Axis(12), Axis(9)))).df)


@query(f"""WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount - 0.05 AS a, l_tax - 0.04 AS b, (l_quantity - 25.0) / 100 AS c FROM lineitem), r AS (SELECT *, b * b - a * c AS d, sqrt(greatest(b * b - a * c, 0)) + abs(b) AS s FROM q)
SELECT l_orderkey, l_linenumber, l_partkey, {R(f"CASE WHEN abs(c) < {_EPS} AND ((b > {_EPS} AND a < -{_EPS}) OR (b < -{_EPS} AND a > {_EPS})) THEN -2 * b / a WHEN d < 0 THEN -1 WHEN b * c <= 0 THEN CASE WHEN s > {_EPS} AND abs(c) > 0 THEN abs(c) / s ELSE -1 END WHEN b * a <= 0 AND abs(a) > {_EPS} AND s > 0 THEN s / abs(a) ELSE -1 END", 5)} AS v FROM r""")
def quadratic(spark, sf):
    """The smallest positive roots of some quadratics; -1 where there is none."""
    t = table(spark, sf, "lineitem")
    root = W.smallest_root(F.col("l_discount") - 0.05, F.col("l_tax") - 0.04, (F.col("l_quantity") - 25.0) / 100)
    return rounded(t.select("l_orderkey", "l_linenumber", "l_partkey", F.when(root > 1e38, -1.0).otherwise(root).alias("v")), 5)


@query(f"SELECT i.i AS i1, {R('CASE WHEN i.i > 0 THEN 1.5 * sqrt((exp(0.5 * (i.i * 0.04)) - 1) / (0.5 * (i.i * 0.04))) ELSE 1.5 END')} AS v FROM range(100) AS i(i)")
def voft(spark, sf):
    return rounded(spark.range(100).select(F.col("id").alias("i1"), V.interval_profile(F.col("id") * 0.04).alias("v")))


@query(f"""WITH q AS (SELECT a.i AS i1, b.i AS i2, c.i AS i3, 4.0 - 3.0 * (a.i * 0.025) AS v, a.i * 0.025 AS z, pow(a.i * 0.025, 2) + pow(b.i * 0.025 - 0.5, 2) AS r FROM range(21) AS a(i), range(61) AS b(i), range(3) AS c(i)), s AS (SELECT *, v * v - 9 * r AS f, sqrt(greatest(v * v - 9 * r, 0)) AS w FROM q)
SELECT i1, i2, i3, {R("CASE WHEN i3 = 0 THEN 1 / sqrt(v - 3 * z) WHEN f < 0 THEN -1 WHEN i3 = 1 THEN sqrt(2 * r / (v + w)) * (2 * v + w) / 3 ELSE sqrt(2 * (v + w) / 9) * (2 * v - w) / 3 END", 5)} AS v FROM s""")
def s2ofz(spark, sf):
    return rounded(V.slowness_gradient(spark, 20).df, 5)


@query(f"""WITH {VECTORS}, x AS (SELECT i.i AS t0, k.i AS k, u.i2, u.i3, sqrt((i.i * 0.01) * (i.i * 0.01) + (u.i2 * 0.0005 / (1.5 + k.i * 0.5)) * (u.i2 * 0.0005 / (1.5 + k.i * 0.5))) / 0.01 AS p FROM range(64) AS i(i), range(3) AS k(i), (SELECT DISTINCT i2, i3 FROM g) u),
y AS ({_taps("SELECT * FROM x WHERE p BETWEEN 0 AND 63", "i2, i3")}), s AS (SELECT t0, k, i3, avg(v) AS v FROM y WHERE v <> 0 GROUP BY 1, 2, 3)
SELECT i.i AS i1, k.i AS i2, u.i3, {R("coalesce(s.v, 0.0)")} AS v FROM range(64) AS i(i) CROSS JOIN range(3) AS k(i) CROSS JOIN (SELECT DISTINCT i3 FROM g) u LEFT JOIN s ON s.t0 = i.i AND s.k = k.i AND s.i3 = u.i3""")
def stacks(spark, sf):
    return rounded(V.constant_velocity_stacks(gathers(spark, sf).put(d1=0.01, d2=0.0005), Axis(3, 1.5, 0.5)).df)


def _frame_sql(n: int) -> str:
    return f"FROM range(64) AS i(i) CROSS JOIN range({n}) AS k(i) CROSS JOIN (SELECT DISTINCT i3 FROM g) u LEFT JOIN s ON s.t0 = i.i AND s.k = k.i AND s.i3 = u.i3"


@query(f"""WITH {panels_sql(8)}, x AS (SELECT i.i AS t0, k.i AS k, u.i2, u.i3, (i.i * 0.01) * (i.i * 0.01) - (k.i * 0.0517 * 2.0 / (1.5 + u.i2 * 0.25)) * (k.i * 0.0517 * 2.0 / (1.5 + u.i2 * 0.25)) AS f FROM range(64) AS i(i), range(6) AS k(i), (SELECT DISTINCT i2, i3 FROM g) u),
y AS ({_taps("SELECT *, sqrt(f) / 0.01 AS p FROM x WHERE f >= 0", "i2, i3")}), s AS (SELECT t0, k, i3, sum(v) * (1.0 / 384) AS v FROM y GROUP BY 1, 2, 3)
SELECT i.i AS i1, k.i AS i2, u.i3, {R("coalesce(s.v, 0.0)")} AS v {_frame_sql(6)}""")
def velmod(spark, sf):
    scan = panels(spark, sf, 8).put(d1=0.01, o2=1.5, d2=0.25)
    return rounded(V.velocity_model(scan, Axis(6, 0.0, 0.0517)).df)


@query(f"""WITH {panels_sql(16)}, x AS (SELECT i.i AS t0, k.i AS k, u.i2, u.i3, sqrt((i.i * 0.01) * (i.i * 0.01) + (k.i * 0.0937) * (u.i2 * 0.0517) * (u.i2 * 0.0517)) AS t FROM range(1, 64) AS i(i), range(4) AS k(i), (SELECT DISTINCT i2, i3 FROM g) u),
y AS ({_taps("SELECT *, t / 0.01 AS p FROM x WHERE t / 0.01 <= 63", "i2, i3")}), s AS (SELECT t0, k, i3, sum(v * (t0 * 0.01) / (t * sqrt(t))) AS v FROM y GROUP BY 1, 2, 3)
SELECT i.i AS i1, k.i AS i2, u.i3, {R("coalesce(s.v, 0.0)", 5)} AS v {_frame_sql(4)}""")
def veltran(spark, sf):
    return rounded(V.hyperbolic_radon(panels(spark, sf, 16, 0.01, 0.0517), Axis(4, 0.0, 0.0937)).df, 5)


@query(f"WITH {VECTORS} SELECT i1, i2, {R('v')} AS v FROM ({_taps(_places(f'least(sqrt(i.i * {3969 / 79!r}), 63.0)', 80))})")
def t2warp(spark, sf):
    return rounded(A.warped(vectors(spark, sf), "t2", 80).df)


@query(f"WITH {VECTORS} SELECT i1, i2, {R('v')} AS v FROM ({_taps(_places('CAST(i.i * i.i AS DOUBLE) / 63.0', 64))})")
def t2warp_inverse(spark, sf):
    return rounded(A.warped(vectors(spark, sf).put(d1=63.0), "t2", 64, inverse=True).df)


@query(f"WITH {VECTORS} SELECT i1, i2, {R('v')} AS v FROM ({_taps(_places(f'least(2.0 * exp(i.i * {math.log(31.5) / 49!r}), 63.0)', 50))})")
def logwarp(spark, sf):
    return rounded(A.warped(vectors(spark, sf), "log", 50, first=2.0).df)


@query(f"WITH {VECTORS} SELECT i1, i2, {R('v')} AS v FROM ({_taps(_places('(-1 / cos(radians(i.i * 2.3)) + 4.0) / 0.05', 32))})")
def cos2ang(spark, sf):
    return rounded(seismic.remap_angle(vectors(spark, sf).put(o1=-4.0, d1=0.05), "inverse cos", Axis(32, 0.0, 2.3)).df)


@query(f"WITH {VECTORS} SELECT i1, i2, {R('v')} AS v FROM ({_taps(_places('(1 / sin(radians(15.0 + i.i * 2.3)) - 1.0) / 0.05', 30))})")
def isin2ang(spark, sf):
    return rounded(seismic.remap_angle(vectors(spark, sf).put(o1=1.0, d1=0.05), "inverse sin", Axis(30, 15.0, 2.3)).df)


@query(f"WITH {VECTORS} SELECT i1, i2, {R('v')} AS v FROM ({_taps(_places('sqrt((pow(i.i * 0.02, 2) + 1.0 / 9) / (1 + pow(i.i * 0.02, 2) / 9.0)) / 0.02', 64))})")
def pp2psang(spark, sf):
    return rounded(seismic.converted_angle(vectors(spark, sf).put(d1=0.02), 2.0).df)


@query(f"""WITH {VECTORS}, x AS (SELECT i.i AS i1, u.i2, i.i - 63 + 5.3 + (u.i2 % 7) * 0.11 AS p FROM range(127) AS i(i), (SELECT DISTINCT i2 FROM g) u) SELECT i1, i2, {R('CASE WHEN p < 63 THEN v ELSE 0.0 END')} AS v FROM ({_taps('SELECT * FROM x')})""")
def refer(spark, sf):
    g = vectors(spark, sf)
    reference = g.df.select("i2").distinct().withColumn("ref", F.lit(5.3) + (F.col("i2") % 7) * 0.11)
    return rounded(A.redatumed(g, reference).df)


@query("SELECT s.i AS shot, CAST(1 AS BIGINT) AS kinds FROM range(49) AS s(i)")
def shotholes(spark, sf):
    """A shot is kept or lost as a whole."""
    g = A.lost_shots(spark, 30, 20)
    return g.df.groupBy((F.col("i1") - F.col("i2") + 19).alias("shot")).agg(F.count_distinct("v").alias("kinds"))


@query(f"""WITH q AS (SELECT a.i AS i1, b.i AS i2, 0.5 + a.i * 0.25 AS h, 1.0 + b.i * 0.25 AS s FROM range(20) AS a(i), range(30) AS b(i))
SELECT i1, i2, CASE WHEN i1 % 4 = 0 OR i2 % 5 = 0 OR floor((s + h / 2 - 0.25) / 0.125 + 0.5) % 7 = 0 OR floor((s + h - 1.5) / 0.25 + 0.5) % 6 = 0 THEN 0.0 ELSE 1.0 END AS v FROM q""")
def stripes(spark, sf):
    return A.strikes(spark, Axis(20, 0.5, 0.25), Axis(30, 1.0, 0.25), (4, 5, 7, 6)).df


@query(f"SELECT l_quantity, l_discount, l_orderkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_quantity, l_discount ORDER BY l_orderkey, {', '.join(LINE_ORDER)}) = 1")
def trirand(spark, sf):
    return A.thinned_points(table(spark, sf, "lineitem"), "l_quantity", "l_discount", ["l_orderkey", *LINE_ORDER]).select("l_quantity", "l_discount", "l_orderkey")


@query(f"""WITH {VECTORS}, x AS (SELECT o_orderkey, o_custkey % 64 + (o_orderkey % 4) * 0.25 AS p, o_orderkey % 490 + (o_custkey % 2) * 0.5 AS q FROM orders)
SELECT o_orderkey, {R("coalesce(a.v * (1 - (p - floor(p))) * (1 - (q - floor(q))), 0) + coalesce(b.v * (p - floor(p)) * (1 - (q - floor(q))), 0) + coalesce(c.v * (1 - (p - floor(p))) * (q - floor(q)), 0) + coalesce(d.v * (p - floor(p)) * (q - floor(q)), 0)")} AS v
FROM x LEFT JOIN g a ON a.i1 = floor(p) AND a.i2 = floor(q) LEFT JOIN g b ON b.i1 = floor(p) + 1 AND b.i2 = floor(q) LEFT JOIN g c ON c.i1 = floor(p) AND c.i2 = floor(q) + 1 LEFT JOIN g d ON d.i1 = floor(p) + 1 AND d.i2 = floor(q) + 1""")
def extract(spark, sf):
    """The panel of all vectors sampled at coordinates in a header table."""
    points = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 64 + (F.col("o_orderkey") % 4) * 0.25).alias("x"), (F.col("o_orderkey") % 490 + (F.col("o_custkey") % 2) * 0.5).alias("y"))
    return rounded(A.sampled_at(vectors(spark, sf), points, "x", "y").select("o_orderkey", "v"))


@query(f"WITH {VECTORS} SELECT CAST(j.j AS BIGINT) AS i1, a.i2, {R('sum(a.v * (b.v + 1.0))', 5)} AS v FROM range(5) AS j(j), g a JOIN g b ON b.i2 = a.i2 AND a.i1 = b.i1 + j.j - 2 GROUP BY 1, 2")
def match(spark, sf):
    """The adjoint of a five-point filter of shifted lines."""
    g = vectors(spark, sf)
    return rounded(algebra.matched(g, g.with_v(F.col("v") + 1.0), 5).df, 5)


_COMPLEX = "z AS (SELECT i1 // 2 AS i1, i2, max(CASE WHEN i1 % 2 = 0 THEN v END) AS re, max(CASE WHEN i1 % 2 = 1 THEN v END) AS im FROM g GROUP BY 1, 2), m AS (SELECT r.i AS row, c.i AS col, cos(r.i * c.i / 10.0) AS re, sin((r.i + c.i) / 7.0) AS im FROM range(32) AS r(i), range(32) AS c(i))"


def _matrix(spark):
    m = spark.range(32 * 32).select(F.expr("id div 32").alias("row"), (F.col("id") % 32).alias("col"))
    return m.withColumns({"re": F.cos(F.col("row") * F.col("col") / 10.0), "im": F.sin((F.col("row") + F.col("col")) / 7.0)})


@query(f"WITH {VECTORS}, {_COMPLEX} SELECT m.row AS i1, z.i2, {R('sum(m.re * z.re - m.im * z.im)', 5)} AS re, {R('sum(m.re * z.im + m.im * z.re)', 5)} AS im FROM m JOIN z ON z.i1 = m.col GROUP BY 1, 2")
def cmatmult(spark, sf):
    out = algebra.complex_matvec(_matrix(spark), to_complex(vectors(spark, sf), pair=True), 32)
    return rounded(out.df.select("i1", "i2", "v.re", "v.im"), 5)


@query(f"WITH {VECTORS}, {_COMPLEX} SELECT m.col AS i1, z.i2, {R('sum(m.re * z.re + m.im * z.im)', 5)} AS re, {R('sum(m.re * z.im - m.im * z.re)', 5)} AS im FROM m JOIN z ON z.i1 = m.row GROUP BY 1, 2")
def cmatmult_adjoint(spark, sf):
    out = algebra.complex_matvec(_matrix(spark), to_complex(vectors(spark, sf), pair=True), 32, adjoint=True)
    return rounded(out.df.select("i1", "i2", "v.re", "v.im"), 5)
