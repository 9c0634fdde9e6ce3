"""Three-dimensional and header variants of the basic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis, Header
from hyperstrata.operators import bin as B
from hyperstrata.operators import frame as W
from hyperstrata.operators import generate as G
from hyperstrata.operators import select as S
from hyperstrata.plans.adapters import LINES, VECTORS, lines, table, vectors
from hyperstrata.plans.catalog import query, rounded
from hyperstrata.plans.queries_seismic import _CUBE, _cube
from hyperstrata.plans.queries_select import R


@query(f"""WITH {VECTORS}, {_CUBE}, w AS (SELECT *, lag(v) OVER a AS a1, lead(v) OVER a AS a2, lag(v) OVER b AS b1, lead(v) OVER b AS b2, lag(v) OVER c AS c1, lead(v) OVER c AS c2 FROM q
WINDOW a AS (PARTITION BY i2, i3 ORDER BY i1), b AS (PARTITION BY i1, i3 ORDER BY i2), c AS (PARTITION BY i1, i2 ORDER BY i3))
SELECT i1, i2, i3, {R("coalesce(v - a1, 0) + coalesce(v - a2, 0) + coalesce(v - b1, 0) + coalesce(v - b2, 0) + coalesce(v - c1, 0) + coalesce(v - c2, 0)")} AS v FROM w""")
def laplac3d(spark, sf):
    return rounded(W.laplacian(_cube(spark, sf), (1, 2, 3)).df)


@query(f"""WITH d AS (SELECT a.i AS i1, b.i AS i2, c.i AS i3, a.i * 10.0 AS z, b.i * 25.0 AS x, c.i * 20.0 AS y FROM range(30) AS a(i), range(8) AS b(i), range(6) AS c(i))
SELECT i1, i2, i3, {R("CASE WHEN i1 >= floor(0.5 + (100.0 + x * 0.21 + y * 0.13) / 10) THEN 2000.0 + x * 0.1 + y * 0.2 + (z - (100.0 + x * 0.21 + y * 0.13)) * 0.3 ELSE 1500.0 END")} AS v FROM d""")
def unif3(spark, sf):
    header = Header((Axis(30, 0.0, 10.0), Axis(8, 0.0, 25.0), Axis(6, 0.0, 20.0)))
    return rounded(G.layered3(spark, header, [(100.0, 0.21, 0.13)], [(1500.0, 0.0, 0.0, 0.0), (2000.0, 0.1, 0.2, 0.3)]).df)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linenumber, l_returnflag ORDER BY l_orderkey DESC, l_partkey DESC, l_shipdate DESC, l_extendedprice DESC) AS r, count(*) OVER (PARTITION BY l_suppkey, l_linenumber, l_returnflag) AS fold FROM lineitem)
SELECT l_suppkey, l_linenumber, l_returnflag, fold, l_extendedprice FROM r WHERE r = 1""")
def intbin3(spark, sf):
    return B.int_bin(table(spark, sf, "lineitem"), ["l_suppkey", "l_linenumber", "l_returnflag"], ["l_orderkey", "l_partkey", "l_shipdate", "l_extendedprice"], ["l_extendedprice"])


@query(f"""WITH {VECTORS}, k AS (SELECT range - 2 AS k, (3 - abs(range - 2)) / 9.0 AS w FROM range(5)),
t AS (SELECT g.i2, i.i AS i1, k.w, CASE WHEN i.i + k.k < 0 THEN -1 - (i.i + k.k) WHEN i.i + k.k > 63 THEN 127 - (i.i + k.k) ELSE i.i + k.k END AS j FROM (SELECT DISTINCT i2 FROM g) g, range(64) AS i(i), k),
s AS (SELECT t.i1, t.i2, sum(t.w * g.v) AS v FROM t JOIN g ON g.i2 = t.i2 AND g.i1 = t.j GROUP BY 1, 2),
w AS (SELECT *, lag(v) OVER (PARTITION BY i2 ORDER BY i1) AS a, lead(v) OVER (PARTITION BY i2 ORDER BY i1) AS b FROM s) SELECT i1, i2, {R("coalesce((b - a) / 2, b - v, v - a)")} AS v FROM w""")
def dsmooth(spark, sf):
    """The derivative of a triangle smoothing."""
    return rounded(W.derivative(W.triangle(vectors(spark, sf), 3)).df)


@query(f"WITH {LINES} SELECT i1, i2, CASE WHEN v > 60000 THEN 1.0 WHEN v < 20000 THEN -1.0 ELSE v END AS v FROM g")
def maskval(spark, sf):
    g = lines(spark, sf)
    return g.with_v(S.outside_values(F.col("v"), 20000.0, 60000.0, -1.0, 1.0)).df


@query("SELECT l_returnflag, l_linestatus, count(*) AS fold, round(avg(l_extendedprice), 4) + 0.0 AS v FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def stack_rollup(spark, sf):
    """Stacks along one axis after another, with all their partial folds."""
    return rounded(table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("fold"), F.avg("l_extendedprice").alias("v")), 4)


@query(f"WITH {VECTORS} SELECT i2, {R('sqrt(avg(v * v))')} AS rms, {R('max(abs(v))')} AS peak, CAST(arg_max(i1, abs(v)) AS BIGINT) AS at FROM g GROUP BY i2")
def trace_energy(spark, sf):
    """RMS, peak and the place of the peak of each trace."""
    g = vectors(spark, sf).df
    return rounded(g.groupBy("i2").agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.max(F.abs("v")).alias("peak"), F.max_by("i1", F.abs("v")).alias("at")))


@query("""SELECT c_custkey, n_name, r_name, CAST(count(o_orderkey) AS BIGINT) AS fold, round(coalesce(sum(o_totalprice), 0.0), 2) + 0.0 AS v FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3""")
def header_join(spark, sf):
    """Header tables joined by key, and the fold and sum of each."""
    c, n, r, o = (table(spark, sf, t) for t in ("customer", "nation", "region", "orders"))
    joined = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).join(o, o["o_custkey"] == c["c_custkey"], "left")
    return rounded(joined.groupBy("c_custkey", "n_name", "r_name").agg(F.count("o_orderkey").alias("fold"), F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("v")), 2)
