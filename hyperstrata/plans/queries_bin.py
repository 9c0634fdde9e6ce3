"""Histograms and binning of irregular samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis
from hyperstrata.operators import bin as B, rank
from hyperstrata.plans.adapters import FEED, samples, table
from hyperstrata.plans.catalog import query, rounded
from hyperstrata.plans.queries_select import R


@query("WITH c AS (SELECT CAST(floor((value - 0.0) / 10.0) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1) SELECT b.i AS bin, coalesce(n, 0) AS n FROM range(30) AS b(i) LEFT JOIN c ON c.bin = b.i")
def histogram(spark, sf):
    return B.histogram(table(spark, sf, "events"), F.col("value"), 0.0, 10.0, 30)


@query("""WITH c AS (SELECT event_type, CAST(floor(value / 25.0) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2)
SELECT t.event_type, b.i AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT event_type FROM events) t CROSS JOIN range(12) AS b(i) LEFT JOIN c ON c.bin = b.i AND c.event_type = t.event_type""")
def histogram_by(spark, sf):
    return B.histogram(table(spark, sf, "events"), F.col("value"), 0.0, 25.0, 12, by=["event_type"])


@query("""WITH c AS (SELECT CAST(floor(l_quantity / 5.0) AS BIGINT) AS i1, CAST(floor(l_discount / 0.02) AS BIGINT) AS i2, count(*) AS v FROM lineitem GROUP BY 1, 2)
SELECT a.i AS i1, b.i AS i2, coalesce(v, 0) AS v FROM range(11) AS a(i) CROSS JOIN range(6) AS b(i) LEFT JOIN c ON c.i1 = a.i AND c.i2 = b.i""")
def hist2(spark, sf):
    return B.histogram2(table(spark, sf, "lineitem"), F.col("l_quantity"), F.col("l_discount"), 0.0, 5.0, 11, 0.0, 0.02, 6).df


_HOUR = "CAST(floor(0.5 + x / 3600.0) AS BIGINT)"


@query(f"WITH {FEED}, c AS (SELECT {_HOUR} AS i1, avg(v) AS v FROM g GROUP BY 1) SELECT a.i AS i1, {R('coalesce(c.v, 0.0)')} AS v FROM range(744) AS a(i) LEFT JOIN c ON c.i1 = a.i")
def bin1_nearest(spark, sf):
    return rounded(B.bin1(samples(spark, sf), F.col("x"), F.col("value"), Axis(744, 0.0, 3600.0)).df)


@query(f"""WITH {FEED}, p AS (SELECT x / 3600.0 AS p, v FROM g), s AS (SELECT CAST(floor(p) AS BIGINT) AS i1, v, 1 - (p - floor(p)) AS w FROM p UNION ALL SELECT CAST(floor(p) AS BIGINT) + 1, v, p - floor(p) FROM p),
c AS (SELECT i1, CASE WHEN sum(w) > 0.01 THEN sum(v * w) / sum(w) ELSE 0.0 END AS v FROM s GROUP BY 1) SELECT a.i AS i1, {R("coalesce(c.v, 0.0)")} AS v FROM range(744) AS a(i) LEFT JOIN c ON c.i1 = a.i""")
def bin1_linear(spark, sf):
    return rounded(B.bin1(samples(spark, sf), F.col("x"), F.col("value"), Axis(744, 0.0, 3600.0), how="linear", clip=0.01).df)


_DAY = "CAST(floor(0.5 + x / 86400.0) AS BIGINT)"
for _how, _value in (("mean", "avg(v)"), ("median", "median(v)"), ("fold", "CAST(count(*) AS DOUBLE)")):

    @query(f"WITH {FEED}, c AS (SELECT {_DAY} AS i1, CAST(floor(0.5 + i2 / 10.0) AS BIGINT) AS i2, {_value} AS v FROM g GROUP BY 1, 2) SELECT a.i AS i1, b.i AS i2, {R('coalesce(c.v, 0.0)')} AS v FROM range(32) AS a(i) CROSS JOIN range(20) AS b(i) LEFT JOIN c ON c.i1 = a.i AND c.i2 = b.i", name=f"bin2_{_how}")
    def _bin2(spark, sf, how=_how):
        return rounded(B.bin2(samples(spark, sf), F.col("x"), F.col("user_id"), F.col("value"), Axis(32, 0.0, 86400.0), Axis(20, 0.0, 10.0), how).df)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey DESC, l_partkey DESC, l_shipdate DESC, l_extendedprice DESC) AS r, count(*) OVER (PARTITION BY l_suppkey, l_linenumber) AS fold FROM lineitem)
SELECT l_suppkey, l_linenumber, fold, l_extendedprice, l_quantity FROM r WHERE r = 1""")
def intbin(spark, sf):
    """One trace per cell of two integer keys, the last one wins."""
    return B.int_bin(table(spark, sf, "lineitem"), ["l_suppkey", "l_linenumber"], ["l_orderkey", "l_partkey", "l_shipdate", "l_extendedprice"], ["l_extendedprice", "l_quantity"])


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS number FROM orders")
def number_in_gather(spark, sf):
    return B.number_within(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "number")


@query("""WITH c AS (SELECT CAST(floor(value / 5.0) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1), h AS (SELECT b.i AS bin, coalesce(n, 0) AS n FROM range(70) AS b(i) LEFT JOIN c ON c.bin = b.i),
s AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS w, sum(n * bin) OVER (ORDER BY bin) AS m, sum(n) OVER () AS ww, sum(n * bin) OVER () AS mm FROM h),
b AS (SELECT bin, CASE WHEN w > 0 AND ww > w THEN CAST(w AS DOUBLE) * (ww - w) * pow(m / CAST(w AS DOUBLE) - (mm - m) / CAST(ww - w AS DOUBLE), 2) ELSE 0 END AS b FROM s)
SELECT 0.0 + (bin + 0.5) * 5.0 AS threshold FROM b ORDER BY b DESC, bin LIMIT 1""")
def otsu(spark, sf):
    h = B.histogram(table(spark, sf, "events"), F.col("value"), 0.0, 5.0, 70)
    return rank.otsu(h, 0.0, 5.0)
