"""Running sums, stencils, moving frames, sorting and peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyperstrata.operators import algebra, frame as W, rank as S
from hyperstrata.plans.adapters import FEED, LINES, VECTORS, feed, gathers, lines, table, vectors
from hyperstrata.plans.catalog import query, rounded
from hyperstrata.plans.queries_select import R

LINE = "PARTITION BY i2 ORDER BY i1"


@query(f"WITH {FEED} SELECT i1, i2, {R(f'sum(v) OVER ({LINE})', 4)} AS v FROM g")
def causint(spark, sf):
    return rounded(W.causint(feed(spark, sf)).df.select("i1", "i2", "v"), 4)


@query(f"WITH {FEED} SELECT i1, i2, {R(f'sum(v) OVER ({LINE} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)', 4)} AS v FROM g")
def causint_adjoint(spark, sf):
    return rounded(W.causint(feed(spark, sf), adjoint=True).df.select("i1", "i2", "v"), 4)


@query("SELECT o_orderkey, o_custkey, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS v FROM orders")
def listminmax(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.min("o_totalprice").over(w).alias("v"))


@query(f"WITH {LINES} SELECT i1, i2, max(v) OVER ({LINE}) AS v FROM g")
def running_max(spark, sf):
    return W.running_extreme(lines(spark, sf), least=False).df


@query(f"WITH {FEED} SELECT i1, i2, {R(f'coalesce(lead(v) OVER ({LINE}) - v, 0.0)')} AS v FROM g")
def igrad(spark, sf):
    return rounded(W.igrad(feed(spark, sf)).df.select("i1", "i2", "v"))


@query(f"WITH {VECTORS}, w AS (SELECT *, lag(v) OVER ({LINE}) AS a, lead(v) OVER ({LINE}) AS b FROM g) SELECT i1, i2, {R('CASE WHEN b IS NULL THEN coalesce(a, 0.0) WHEN a IS NULL THEN -v ELSE a - v END')} AS v FROM w")
def igrad_adjoint(spark, sf):
    return rounded(W.igrad(vectors(spark, sf), adjoint=True).df)


@query(f"WITH {VECTORS}, w AS (SELECT *, lag(v) OVER ({LINE}) AS a, lead(v) OVER ({LINE}) AS b FROM g) SELECT i1, i2, {R('coalesce(pow(0.5 * (b - a), 2), 0.0)', 8)} AS v FROM w")
def igrad_square(spark, sf):
    return rounded(W.igrad(vectors(spark, sf), square=True).df, 8)


@query(f"WITH {FEED} SELECT i1, i2, {R(f'coalesce((lead(v) OVER ({LINE}) - v) / (lead(v) OVER ({LINE}) + v), 0.0)')} AS v FROM g")
def ai2refl(spark, sf):
    return rounded(W.reflectivity(feed(spark, sf)).df.select("i1", "i2", "v"))


@query(f"WITH {VECTORS} SELECT i1, i2, {R(f'2.0 * exp(coalesce(sum(ln((1 + v * 0.5) / (1 - v * 0.5))) OVER ({LINE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))')} AS v FROM g")
def refl2ai(spark, sf):
    g = vectors(spark, sf)
    return rounded(W.impedance(g.with_v(F.col("v") * 0.5), 2.0).df)


@query(f"WITH {FEED} SELECT i1, i2, {R(f'sum(v) OVER ({LINE} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) / 4')} AS v FROM g")
def boxsmooth(spark, sf):
    return rounded(W.boxsmooth(feed(spark, sf), 4).df.select("i1", "i2", "v"))


@query(f"""WITH {VECTORS}, k AS (SELECT range - 2 AS k, (3 - abs(range - 2)) / 9.0 AS w FROM range(5)),
t AS (SELECT g.i2, i.i AS i1, k.w, CASE WHEN i.i + k.k < 0 THEN -1 - (i.i + k.k) WHEN i.i + k.k > 63 THEN 127 - (i.i + k.k) ELSE i.i + k.k END AS j FROM (SELECT DISTINCT i2 FROM g) g, range(64) AS i(i), k)
SELECT t.i1, t.i2, {R("sum(t.w * g.v)")} AS v FROM t JOIN g ON g.i2 = t.i2 AND g.i1 = t.j GROUP BY 1, 2""")
def smooth_triangle(spark, sf):
    return rounded(W.triangle(vectors(spark, sf), 3).df)


@query(f"WITH {VECTORS} SELECT i1, i2, {R(f'sum(v) OVER ({LINE} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5')} AS v FROM g")
def mean_moving(spark, sf):
    return rounded(W.moving(vectors(spark, sf), 5, "mean").df)


_AROUND = "list(v) OVER (PARTITION BY i2 ORDER BY i1 ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query(f"""WITH {VECTORS}, w AS (SELECT i1, i2, {_AROUND} AS l FROM g)
SELECT i1, i2, list_sort(list_concat(l, list_transform(range(5 - len(l)), lambda x: 0.0)))[3] AS v FROM w""")
def mf(spark, sf):
    """Moving median, zeros beyond the ends."""
    return W.moving(vectors(spark, sf), 5, "median").df


@query(f"""WITH {VECTORS}, s AS (SELECT i1, i2, greatest(0, least(i1 - 2, 59)) AS a FROM g)
SELECT s.i1, s.i2, list_sort(list(g.v))[3] AS v FROM s JOIN g ON g.i2 = s.i2 AND g.i1 BETWEEN s.a AND s.a + 4 GROUP BY 1, 2""")
def despike(spark, sf):
    return W.despike(vectors(spark, sf), 5).df


@query(f"""WITH {VECTORS}, w AS (SELECT i1, i2, v, lag(v) OVER a AS a1, lead(v) OVER a AS a2, lag(v) OVER b AS b1, lead(v) OVER b AS b2 FROM g WINDOW a AS (PARTITION BY i2 ORDER BY i1), b AS (PARTITION BY i1 ORDER BY i2))
SELECT i1, i2, {R("coalesce(v - a1, 0) + coalesce(v - a2, 0) + coalesce(v - b1, 0) + coalesce(v - b2, 0)")} AS v FROM w""")
def laplac(spark, sf):
    return rounded(W.laplacian(vectors(spark, sf)).df)


@query(f"WITH {VECTORS} SELECT CAST(b.i1 - a.i1 AS INTEGER) AS lag, {R('sum(pow(a.v - b.v, 2)) / (2 * count(*))')} AS value FROM g a JOIN g b ON a.i2 = b.i2 AND b.i1 - a.i1 BETWEEN 1 AND 8 GROUP BY 1")
def variogram(spark, sf):
    return rounded(W.variogram(vectors(spark, sf), 8))


@query(f"""WITH {VECTORS}, a AS (SELECT i1, i2, lag(v) OVER w + 2 * v + lead(v) OVER w AS s, lead(v) OVER w - lag(v) OVER w AS d FROM g WINDOW w AS (PARTITION BY i2 ORDER BY i1)),
b AS (SELECT i1, i2, lag(d) OVER w + 2 * d + lead(d) OVER w AS p, lead(s) OVER w - lag(s) OVER w AS q FROM a WINDOW w AS (PARTITION BY i1 ORDER BY i2))
SELECT i1, i2, {R("coalesce(p * p + q * q, 0.0)")} AS v FROM b""")
def grad2(spark, sf):
    return rounded(W.sobel(vectors(spark, sf)).df)


@query(f"""WITH {VECTORS}, k AS (SELECT range - 4 AS k, (5 - abs(range - 4)) / 25.0 AS w FROM range(9)),
t AS (SELECT g.i2, i.i AS i1, k.w, CASE WHEN i.i + k.k < 0 THEN -1 - (i.i + k.k) WHEN i.i + k.k > 63 THEN 127 - (i.i + k.k) ELSE i.i + k.k END AS j FROM (SELECT DISTINCT i2 FROM g) g, range(64) AS i(i), k),
s AS (SELECT t.i1, t.i2, sum(t.w * abs(g.v)) AS a FROM t JOIN g ON g.i2 = t.i2 AND g.i1 = t.j GROUP BY 1, 2)
SELECT g.i1, g.i2, {R("g.v / s.a", 5)} AS v FROM g JOIN s USING (i1, i2)""")
def agc(spark, sf):
    return rounded(W.gain_control(vectors(spark, sf), 5).df, 5)


@query(f"WITH {VECTORS}, w AS (SELECT *, lag(v) OVER ({LINE}) AS a, lead(v) OVER ({LINE}) AS b FROM g) SELECT i1, i2, {R('coalesce((b - a) / 2, b - v, v - a)')} AS v FROM w")
def deriv(spark, sf):
    return rounded(W.derivative(vectors(spark, sf)).df)


@query(f"WITH {VECTORS} SELECT i1, i2, coalesce(lag(v, 3) OVER ({LINE}), 0.0) AS v FROM g")
def shift_traces(spark, sf):
    return W.shift(vectors(spark, sf), 3).df


@query(f"WITH {VECTORS} SELECT i1, i2, {R(f'1.0 * v - 0.5 * coalesce(lag(v) OVER ({LINE}), 0) + 0.25 * coalesce(lag(v, 2) OVER ({LINE}), 0)')} AS v FROM g")
def conv(spark, sf):
    return rounded(algebra.convolve(vectors(spark, sf), [1.0, -0.5, 0.25]).df)


@query(f"WITH {VECTORS} SELECT b.i1 - a.i1 AS i1, a.i2, {R('sum(a.v * b.v)')} AS v FROM g a JOIN g b ON a.i2 = b.i2 AND b.i1 - a.i1 BETWEEN 0 AND 9 GROUP BY 1, 2")
def autocorr(spark, sf):
    return rounded(algebra.autocorrelation(vectors(spark, sf), 10).df)


@query(f"WITH {VECTORS} SELECT k.k AS i1, i2, {R('sum(v * cos(-2 * pi() / 64 * ((i1 * k.k) % 64)))')} AS re, {R('sum(v * sin(-2 * pi() / 64 * ((i1 * k.k) % 64)))')} AS im FROM g, range(9) AS k(k) GROUP BY 1, 2")
def dft(spark, sf):
    return rounded(algebra.dft(vectors(spark, sf), 9))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS new FROM orders")
def headersort(spark, sf):
    return S.header_sort(table(spark, sf, "orders"), "o_totalprice", "o_orderkey").select("o_orderkey", "new")


@query("SELECT c_custkey, row_number() OVER (ORDER BY abs(c_acctbal) DESC, c_custkey) - 1 AS place FROM customer")
def sort_abs(spark, sf):
    return S.sort_values(table(spark, sf, "customer"), "c_acctbal", "c_custkey").select("c_custkey", "place")


@query("SELECT row_number() OVER (ORDER BY v) - 1 AS i1, v FROM (SELECT DISTINCT p_size AS v FROM part)")
def unique(spark, sf):
    return S.unique(table(spark, sf, "part"), "p_size").select("i1", "v")


@query(f"""WITH {VECTORS}, w AS (SELECT i2, i1, v, lag(v) OVER ({LINE}) AS a, lead(v) OVER ({LINE}) AS c FROM g),
p AS (SELECT i2, i1 + 0.5 * (a - c) / (a - 2 * v + c) AS x, v - 0.25 * (a - c) * 0.5 * (a - c) / (a - 2 * v + c) AS v FROM w WHERE v > a AND v > c),
r AS (SELECT *, row_number() OVER (PARTITION BY i2 ORDER BY v DESC, x) AS rank FROM p)
SELECT i2, {R("x")} AS x, {R("v")} AS v, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def max1_peaks(spark, sf):
    return rounded(S.local_maxima(vectors(spark, sf), 5))


@query(f"""WITH g AS (SELECT l_orderkey AS i2, CAST(l_quantity AS DOUBLE) AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS i1 FROM lineitem),
c AS (SELECT v, count(*) AS n FROM g GROUP BY v), t AS (SELECT v, CAST(floor(sum(n) OVER (ORDER BY v) * 255.0 / sum(n) OVER ()) AS INTEGER) AS e FROM c)
SELECT g.i1, g.i2, t.e AS v FROM g JOIN t USING (v)""")
def equal(spark, sf):
    """Histogram equalisation of one slice."""
    return S.equalise(lines(spark, sf, "l_quantity")).df


@query(f"WITH {LINES}, n AS (SELECT CAST(least(floor(count(*) * 0.9 + 0.5), count(*) - 1) AS BIGINT) AS k FROM g) SELECT v FROM (SELECT abs(v) AS v FROM g) ORDER BY v LIMIT 1 OFFSET (SELECT k FROM n)")
def quantile(spark, sf):
    """The exact 90th percentile clip of all samples."""
    df = lines(spark, sf).df.select(F.abs("v").alias("v"))
    return spark.createDataFrame([(S.kth_smallest(df, "v", S.quantile_rank(df.count(), 90.0)),)], "v double")


@query(f"WITH {VECTORS} SELECT i3, i1, {R('avg(v)')} AS mean, {R('quantile_cont(v, 0.5)')} AS middle FROM g GROUP BY 1, 2")
def gather_profile(spark, sf):
    d = gathers(spark, sf).df
    return rounded(d.groupBy("i3", "i1").agg(F.avg("v").alias("mean"), F.median("v").alias("middle")))
