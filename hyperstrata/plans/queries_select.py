"""Selection, masks, clips and pointwise math."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyperstrata.operators import select as S
from hyperstrata.operators.grid import combine
from hyperstrata.plans.adapters import LINES, VECTORS, gathers, lines, table, vectors
from hyperstrata.plans.catalog import query, rounded

R = lambda x, d=6: f"(round({x}, {d}) + 0.0)"
PARITY = "even AS (SELECT i1, i2 // 2 AS i2, v FROM g WHERE i2 % 2 = 0), odd AS (SELECT i1, i2 // 2 AS i2, v FROM g WHERE i2 % 2 = 1)"


def halves(spark, sf):
    """Even and odd vectors as two grids of one shape."""
    g = vectors(spark, sf)
    split = lambda r: type(g)(g.df.where(F.col("i2") % 2 == r).withColumn("i2", F.expr("i2 div 2")), g.header)
    return split(0), split(1)


@query("""
WITH h AS (SELECT l_orderkey, l_suppkey, l_linenumber, l_extendedprice, CASE WHEN l_quantity BETWEEN 10 AND 40 THEN 1 ELSE 0 END AS mask FROM lineitem),
kept AS (SELECT *, 100 * l_suppkey + l_linenumber AS cdp FROM h WHERE mask <> 0)
SELECT l_suppkey AS i1, CAST(l_linenumber AS BIGINT) AS i2, cdp, count(*) AS fold, round(sum(l_extendedprice), 2) + 0.0 AS total FROM kept GROUP BY 1, 2, 3""")
def land_fold(spark, sf):
    """Mask headers, keep traces, compute a sort key, bin, and count the fold of each bin."""
    h = table(spark, sf, "lineitem").withColumn("mask", S.mask(F.col("l_quantity"), 10, 40))
    kept = h.where("mask <> 0").withColumn("cdp", 100 * F.col("l_suppkey") + F.col("l_linenumber"))
    binned = kept.groupBy(F.col("l_suppkey").alias("i1"), F.col("l_linenumber").cast("long").alias("i2"), "cdp").agg(F.count("*").alias("fold"), F.sum("l_extendedprice").alias("total"))
    return rounded(binned, 2)


@query(f"WITH {LINES} SELECT i1 - 1 AS i1, i2, v FROM g WHERE i1 BETWEEN 1 AND 3")
def window_axis1(spark, sf):
    return S.window(lines(spark, sf), axis1={"f": 1, "n": 3}).df


@query(f"WITH {VECTORS} SELECT (i1 - 3) // 5 AS i1, i2, v FROM g WHERE i1 >= 3 AND i1 < 3 + 10 * 5 AND (i1 - 3) % 5 = 0")
def window_jump(spark, sf):
    return S.window(vectors(spark, sf), axis1={"f": 3, "n": 10, "j": 5}).df


@query(f"WITH {VECTORS} SELECT i1 - 56 AS i1, i2, v FROM g WHERE i1 >= 56")
def window_from_end(spark, sf):
    return S.window(vectors(spark, sf), axis1={"f": -8}).df


@query(f"WITH {LINES} SELECT i1, i2, CASE WHEN i1 BETWEEN 1 AND 2 THEN 0.0 ELSE v END AS v FROM g")
def cut_zero(spark, sf):
    return S.cut(lines(spark, sf), axis1={"f": 1, "n": 2}).df


@query("SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity BETWEEN 10 AND 40 THEN 1 ELSE 0 END AS mask FROM lineitem")
def mask_range(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", S.mask(F.col("l_quantity"), 10, 40).alias("mask"))


_MASKS = "m AS (SELECT vec_id AS i2, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS mask FROM embeddings)"


def _masks(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("i2"), (F.col("label") >= 5).cast("int").alias("mask"))


@query(f"WITH {VECTORS}, {_MASKS}, k AS (SELECT i2, row_number() OVER (ORDER BY i2) - 1 AS n FROM m WHERE mask <> 0) SELECT i1, n AS i2, v FROM g JOIN k USING (i2)")
def headerwindow(spark, sf):
    return S.header_window(vectors(spark, sf), _masks(spark, sf)).df


@query(f"WITH {VECTORS}, {_MASKS} SELECT i1, i2, CASE WHEN mask <> 0 THEN v ELSE 0.0 END AS v FROM g JOIN m USING (i2)")
def headerwindow_inverse(spark, sf):
    """Window by a mask and scatter back: the other traces are zero."""
    g, masks = vectors(spark, sf), _masks(spark, sf)
    return S.header_window(S.header_window(g, masks), masks, inverse=True).df


@query(f"WITH {VECTORS}, {_MASKS} SELECT i1, i2, CASE WHEN mask <> 0 THEN v ELSE 0.0 END AS v FROM g JOIN m USING (i2)")
def headercut(spark, sf):
    return S.header_cut(vectors(spark, sf), _masks(spark, sf)).df


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) + 0.0 AS v FROM lineitem")
def headermath(spark, sf):
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr("l_extendedprice * (1 - l_discount) * (1 + l_tax)").alias("v")))


@query(f"WITH {VECTORS} SELECT i1, i2, CASE WHEN v > 0.1 THEN 0.1 WHEN v < -0.1 THEN -0.1 ELSE v END AS v FROM g")
def clip(spark, sf):
    g = vectors(spark, sf)
    return g.with_v(S.clip(F.col("v"), 0.1)).df


@query(f"WITH {LINES} SELECT i1, i2, least(greatest(v, 10000.0), 50000.0) AS v FROM g")
def clip2(spark, sf):
    g = lines(spark, sf)
    return g.with_v(S.clip2(F.col("v"), 10000.0, 50000.0)).df


@query(f"WITH {VECTORS} SELECT i1, i2, CASE WHEN v < -0.05 THEN 0.0 WHEN v > 0.05 THEN 1.0 ELSE v END AS v FROM g")
def tclip(spark, sf):
    g = vectors(spark, sf)
    return g.with_v(S.threshold_clip(F.col("v"), -0.05, 0.05)).df


@query(f"""WITH {LINES}, n AS (SELECT count(*) AS n FROM g),
t AS (SELECT abs(v) AS t FROM g ORDER BY 1 LIMIT 1 OFFSET (SELECT CAST(floor(0.5 + n * 0.8) AS BIGINT) FROM n))
SELECT i1, i2, {R("sign(v) * greatest(abs(v) - t, 0.0)", 4)} AS v FROM g, t""")
def threshold_soft(spark, sf):
    return rounded(S.soft_threshold(lines(spark, sf), 20.0).df, 4)


@query(f"WITH {VECTORS} SELECT i1, i2, {R('v * pow(0.5 + (i1 + 1) * 0.25, 1.5)')} AS v FROM g")
def pow_gain(spark, sf):
    return rounded(S.power_gain(vectors(spark, sf).put(o1=0.5, d1=0.25), {1: 1.5}).df)


@query(f"WITH {VECTORS} SELECT i1, i2, {R('v / max(abs(v)) OVER (PARTITION BY i2)')} AS v FROM g")
def scale_axis1(spark, sf):
    return rounded(S.scale_axis(vectors(spark, sf), 1).df)


@query(f"WITH {VECTORS} SELECT i1, i2, i3, {R('v / max(abs(v)) OVER (PARTITION BY i3)')} AS v FROM g")
def scale_axis2(spark, sf):
    return rounded(S.scale_axis(gathers(spark, sf), 2).df)


@query(f"""WITH {VECTORS} SELECT i1, i2, {R("CASE WHEN i1 * 0.01 < abs(i2 % 8) * 0.02 THEN 0.0 ELSE v END")} AS v FROM g""")
def mute_linear(spark, sf):
    g = vectors(spark, sf).put(d1=0.01)
    return rounded(S.mutter(g, F.col("i2") % 8, slope0=0.02).df)


@query(f"""WITH {VECTORS} SELECT i1, i2, {R("CASE WHEN i1 * 0.01 - (i2 % 4) * 0.05 < 0 THEN 0.0 WHEN i1 * 0.01 - (i2 % 4) * 0.05 - 0.1 > 0 THEN v ELSE v * pow(sin(1.5707963267948966 * (i1 * 0.01 - (i2 % 4) * 0.05) / ((i1 * 0.01 - (i2 % 4) * 0.05) - (i1 * 0.01 - (i2 % 4) * 0.05 - 0.1))), 2) END")} AS v FROM g""")
def mute_ramp(spark, sf):
    return rounded(S.mutter(vectors(spark, sf).put(d1=0.01), F.col("i2") % 4, slope0=0.05, tp=0.1).df)


@query(f"""WITH {VECTORS} SELECT i1, i2, {R("v * CASE WHEN i1 < 5 THEN pow(sin(0.5 * pi() * (i1 + 1) / 6.0), 2) ELSE 1 END * CASE WHEN 63 - i1 < 5 THEN pow(sin(0.5 * pi() * (63 - i1 + 1) / 6.0), 2) ELSE 1 END")} AS v FROM g""")
def costaper(spark, sf):
    return rounded(S.cosine_taper(vectors(spark, sf), {1: 5}).df)


@query("""SELECT s_suppkey, s_nationkey, ((CASE WHEN (0 > s_acctbal) <> (9000 > s_acctbal) AND s_nationkey < 2 + (s_acctbal - 0) * ((12.0 - 2) / (9000.0 - 0)) THEN 1 ELSE 0 END)
 + (CASE WHEN (9000 > s_acctbal) <> (0 > s_acctbal) AND s_nationkey < 12 + (s_acctbal - 9000) * ((22.0 - 12) / (0.0 - 9000)) THEN 1 ELSE 0 END)) % 2 AS mask FROM supplier""")
def polymask(spark, sf):
    """Points inside a triangle of nation key and balance."""
    corners = [(2.0, 0.0), (12.0, 9000.0), (22.0, 0.0)]
    df = table(spark, sf, "supplier")
    return df.select("s_suppkey", "s_nationkey", S.polygon_mask(F.col("s_nationkey").cast("double"), F.col("s_acctbal"), corners).alias("mask"))


@query(f"WITH {VECTORS}, {PARITY} SELECT e.i1, e.i2, CASE WHEN e.v > o.v THEN 1 ELSE 0 END AS v FROM even e JOIN odd o USING (i1, i2)")
def boolcmp_gt(spark, sf):
    return S.compare(*halves(spark, sf), "gt").df


@query(f"WITH {VECTORS}, {PARITY} SELECT e.i1, e.i2, {R('2 * e.v + 3 * (o.v + 1)')} AS v FROM even e JOIN odd o USING (i1, i2)")
def add(spark, sf):
    return rounded(combine(list(halves(spark, sf)), "add", scale=[2.0, 3.0], shift=[0.0, 1.0]).df)


@query(f"WITH {VECTORS}, {PARITY} SELECT e.i1, e.i2, {R('e.v * o.v', 8)} AS v FROM even e JOIN odd o USING (i1, i2)")
def mul(spark, sf):
    return rounded(combine(list(halves(spark, sf)), "mul").df, 8)


@query(f"WITH {VECTORS}, {PARITY} SELECT e.i1, e.i2, {R('CASE WHEN o.v <> 0 THEN e.v / o.v ELSE 0.0 END', 4)} AS v FROM even e JOIN odd o USING (i1, i2)")
def div(spark, sf):
    return rounded(combine(list(halves(spark, sf)), "div").df, 4)


@query(f"WITH {VECTORS}, {PARITY} SELECT e.i1, e.i2, {R('sqrt(abs(e.v)) * exp(-(0.004 * e.i1)) + o.v * e.i2')} AS v FROM even e JOIN odd o USING (i1, i2)")
def math_expression(spark, sf):
    a, b = halves(spark, sf)
    return rounded(S.math("sqrt(abs(input)) * exp(-x1) + other * x2", a.put(d1=0.004), other=b.put(d1=0.004)).df)


@query(f"WITH {VECTORS}, {PARITY} SELECT e.i1, e.i2, {R('sqrt(e.v * e.v + o.v * o.v)')} AS amplitude, {R('atan2(o.v, e.v)')} AS phase FROM even e JOIN odd o USING (i1, i2)")
def cmplx_polar(spark, sf):
    c = S.cmplx(*halves(spark, sf))
    df = S.part(c, "abs").df.withColumnRenamed("v", "amplitude").join(S.part(c, "arg").df.withColumnRenamed("v", "phase"), ["i1", "i2"])
    return rounded(df)


@query(f"WITH {VECTORS} SELECT i1 // 2 AS i1, i2, max(CASE WHEN i1 % 2 = 0 THEN v END) AS re, max(CASE WHEN i1 % 2 = 1 THEN v END) AS im FROM g GROUP BY 1, 2")
def rtoc_pair(spark, sf):
    return S.to_complex(vectors(spark, sf), pair=True).df.select("i1", "i2", "v.re", "v.im")
