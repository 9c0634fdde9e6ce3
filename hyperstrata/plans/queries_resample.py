"""Interpolation, slices, moveout and sums along curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis, Header
from hyperstrata.operators import resample as I
from hyperstrata.operators.grid import Grid
from hyperstrata.plans.adapters import FEED, VECTORS, feed, panels, panels_sql, vectors
from hyperstrata.plans.catalog import query, rounded
from hyperstrata.plans.queries_select import R


@query(f"""WITH {FEED}, k AS (SELECT i2, x, v, lead(x) OVER (PARTITION BY i2 ORDER BY x, v) AS nx, lead(v) OVER (PARTITION BY i2 ORDER BY x, v) AS nv, lag(x) OVER (PARTITION BY i2 ORDER BY x, v) IS NULL AS f FROM g),
o AS (SELECT i.i AS i1, i.i * 7200.0 AS at, u.i2 FROM range(372) AS i(i), (SELECT DISTINCT i2 FROM g) u)
SELECT o.i1, o.i2, {R("CASE WHEN o.at <= k.x OR k.nx IS NULL THEN k.v ELSE k.v + (o.at - k.x) * (k.nv - k.v) / (k.nx - k.x) END", 5)} AS v
FROM o JOIN k ON o.i2 = k.i2 AND (k.f OR o.at >= k.x) AND (k.nx IS NULL OR o.at < k.nx)""")
def linear_interp(spark, sf):
    return rounded(I.linear(feed(spark, sf).df, ["i2"], "x", "v", Axis(372, 0.0, 7200.0)).select("i1", "i2", "v"), 5)


@query(f"""WITH {VECTORS}, p AS (SELECT vec_id AS i2, (vec_id * 7 % 640) / 10.0 AS pick FROM embeddings)
SELECT p.i2, {R("CASE WHEN pick <= 63 THEN coalesce(a.v, 0) * (1 - (pick - floor(pick))) + coalesce(b.v, 0) * (pick - floor(pick)) ELSE 0.0 END")} AS v
FROM p LEFT JOIN g a ON a.i2 = p.i2 AND a.i1 = floor(pick) LEFT JOIN g b ON b.i2 = p.i2 AND b.i1 = floor(pick) + 1""")
def slice_pick(spark, sf):
    g = vectors(spark, sf)
    picks = g.df.select("i2").distinct().withColumn("pick", (F.col("i2") * 7 % 640) / 10.0)
    return rounded(I.slice_at(g, picks, axis=1))


def _sampled(target: str, n_in: int = 64) -> str:
    """SQL of a fractional look-up of axis 1 at ``target`` (an expression of o.i1 and o.i2)."""
    return f"""p AS (SELECT o.i1, o.i2, {target} AS p FROM (SELECT DISTINCT g.i1, g.i2 FROM g) o)
SELECT p.i1, p.i2, {R(f"CASE WHEN p >= 0 AND p <= {n_in - 1} THEN coalesce(a.v * (1 - (p - floor(p))), 0.0) + CASE WHEN p > floor(p) THEN b.v * (p - floor(p)) ELSE 0.0 END ELSE 0.0 END")} AS v
FROM p LEFT JOIN g a ON a.i2 = p.i2 AND a.i1 = floor(p) LEFT JOIN g b ON b.i2 = p.i2 AND b.i1 = floor(p) + 1"""


@query(f"WITH {VECTORS}, {_sampled('(sqrt((0.1 + o.i1 * 0.01) * (0.1 + o.i1 * 0.01) + ((o.i2 % 10) * 0.05 / 2.0) * ((o.i2 % 10) * 0.05 / 2.0)) - 0.1) / 0.01')}")
def nmo(spark, sf):
    g = vectors(spark, sf).put(o1=0.1, d1=0.01)
    return rounded(I.nmo(g, (F.col("i2") % 10) * 0.05, 2.0).df)


@query(f"""WITH {VECTORS}, {_sampled("CASE WHEN (0.1 + o.i1 * 0.01) * (0.1 + o.i1 * 0.01) - ((o.i2 % 10) * 0.05 / 2.0) * ((o.i2 % 10) * 0.05 / 2.0) >= 0 THEN (sqrt(greatest((0.1 + o.i1 * 0.01) * (0.1 + o.i1 * 0.01) - ((o.i2 % 10) * 0.05 / 2.0) * ((o.i2 % 10) * 0.05 / 2.0), 0)) - 0.1) / 0.01 ELSE -1 END")}""")
def inmo(spark, sf):
    g = vectors(spark, sf).put(o1=0.1, d1=0.01)
    return rounded(I.inverse_nmo(g, (F.col("i2") % 10) * 0.05, 2.0).df)


@query(f"WITH {VECTORS}, {_sampled('(exp(-2.0 + o.i1 * 0.03) - 0.1) / 0.01')}")
def logstretch(spark, sf):
    g = vectors(spark, sf).put(o1=0.1, d1=0.01)
    return rounded(I.stretch(g, "log", 64, -2.0, 0.03).df)


@query(f"WITH {VECTORS}, {_sampled('(sqrt(greatest(0.02 + o.i1 * 0.008, 0)) - 0.1) / 0.01')}")
def t2stretch(spark, sf):
    g = vectors(spark, sf).put(o1=0.1, d1=0.01)
    return rounded(I.stretch(g, "t2", 64, 0.02, 0.008).df)


def _curves(index: str) -> str:
    """SQL: the samples asked for along curves in every panel."""
    return f"a AS (SELECT t.i AS t0, k.i AS k, x.i2 AS x, x.i3, CAST(floor(0.5 + ({index}) / 0.01) AS BIGINT) AS j FROM range(64) AS t(i), range(9) AS k(i), (SELECT DISTINCT i2, i3 FROM g) x)"


_FRAME = "FROM range(64) AS t(i) CROSS JOIN range(9) AS k(i) CROSS JOIN (SELECT DISTINCT i3 FROM g) u LEFT JOIN s ON s.t0 = t.i AND s.k = k.i AND s.i3 = u.i3"


@query(f"""WITH {panels_sql(24)}, {_curves("t.i * 0.01 + (-0.2013 + k.i * 0.04717) * (x.i2 * 0.05)")},
s AS (SELECT t0, k, a.i3, sum(g.v) AS v FROM a JOIN g ON g.i1 = a.j AND g.i2 = a.x AND g.i3 = a.i3 GROUP BY 1, 2, 3)
SELECT t.i AS i1, k.i AS i2, u.i3, {R("coalesce(s.v, 0.0)")} AS v {_FRAME}""")
def slant_stack(spark, sf):
    return rounded(I.slant_stack(panels(spark, sf, 24, 0.01, 0.05), Axis(9, -0.2013, 0.04717)).df)


@query(f"""WITH {panels_sql(24)}, {_curves("sqrt((0.0 + t.i * 0.01) * (0.0 + t.i * 0.01) + ((0.0 + x.i2 * 0.05) / (1.53 + k.i * 0.27)) * ((0.0 + x.i2 * 0.05) / (1.53 + k.i * 0.27)))")},
s AS (SELECT t0, k, a.i3, sum(g.v) * sum(g.v) / (sum(CASE WHEN g.v <> 0 THEN 1 ELSE 0 END) * sum(g.v * g.v)) AS v FROM a JOIN g ON g.i1 = a.j AND g.i2 = a.x AND g.i3 = a.i3 GROUP BY 1, 2, 3)
SELECT t.i AS i1, k.i AS i2, u.i3, {R("coalesce(s.v, 0.0)")} AS v {_FRAME}""")
def vscan_semblance(spark, sf):
    return rounded(I.velocity_scan(panels(spark, sf, 24, 0.01, 0.05), Axis(9, 1.53, 0.27)).df)
