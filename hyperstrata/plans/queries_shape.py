"""Reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis, Header
from hyperstrata.operators import shape as X
from hyperstrata.operators.grid import Grid
from hyperstrata.plans.adapters import LINES, VECTORS, lines, table, vectors, whole
from hyperstrata.plans.catalog import query
from hyperstrata.plans.queries_select import PARITY, halves


@query(f"WITH {VECTORS} SELECT i2 AS i1, i1 AS i2, v FROM g")
def transp(spark, sf):
    return X.transp(vectors(spark, sf)).df


@query(f"WITH {VECTORS} SELECT 63 - i1 AS i1, i2, v FROM g")
def reverse(spark, sf):
    return X.reverse(vectors(spark, sf), [1]).df


@query(f"WITH {LINES} SELECT max(i1) OVER (PARTITION BY i2) - i1 AS i1, i2, v FROM g")
def reverse_ragged(spark, sf):
    return X.reverse(lines(spark, sf), [1]).df


@query(f"WITH {VECTORS} SELECT (i1 + 10) % 64 AS i1, i2, v FROM g")
def rotate(spark, sf):
    return X.rotate(vectors(spark, sf), {1: 10}).df


@query(f"WITH {VECTORS}, f AS (SELECT a.i AS i1, c.i AS i2 FROM range(67) AS a(i), range((SELECT CAST(pow(2, ceil(log2(max(i2) + 1))) AS BIGINT) FROM g)) AS c(i)) SELECT f.i1, f.i2, coalesce(b.v, 0.0) AS v FROM f LEFT JOIN g b ON b.i1 + 2 = f.i1 AND b.i2 = f.i2")
def pad(spark, sf):
    return X.pad(whole(spark, sf), begin={1: 2}, end={1: 1}, to={2: 0}).df


@query(f"WITH {VECTORS} SELECT i1, r.i AS i2, i2 AS i3, v FROM g, range(4) AS r(i)")
def spray(spark, sf):
    return X.spray(whole(spark, sf), 2, 4).df


@query("""SELECT CAST(0 AS BIGINT) AS i1, s_suppkey AS i2, s_acctbal AS v FROM supplier UNION ALL
SELECT CAST(0 AS BIGINT), c_custkey + (SELECT count(*) FROM supplier), c_acctbal FROM customer""")
def cat(spark, sf):
    """Balances of suppliers, then of customers, along axis 2."""
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    grid = lambda df, k, v, n: Grid(df.select(F.lit(0).cast("long").alias("i1"), F.col(k).alias("i2"), F.col(v).alias("v")), Header((Axis(1), Axis(n))))
    return X.cat([grid(s, "s_suppkey", "s_acctbal", s.count()), grid(c, "c_custkey", "c_acctbal", c.count())], 2).df


@query(f"WITH {VECTORS}, f AS (SELECT a.i AS i1, c.i2 FROM range(131) AS a(i), (SELECT DISTINCT i2 FROM g) c), u AS (SELECT i1, i2, v FROM g UNION ALL SELECT i1 + 67, i2, v FROM g) SELECT f.i1, f.i2, coalesce(u.v, 0.0) AS v FROM f LEFT JOIN u USING (i1, i2)")
def merge_space(spark, sf):
    b = whole(spark, sf)
    return X.cat([b, b], 1, space=3).df


@query(f"WITH {VECTORS}, {PARITY} SELECT i1, i2 * 2 AS i2, v FROM even UNION ALL SELECT i1, i2 * 2 + 1, v FROM odd")
def interleave(spark, sf):
    return X.interleave(list(halves(spark, sf)), 2).df


@query(f"WITH {VECTORS}, f AS (SELECT a.i AS i1, c.i AS i2 FROM range(64) AS a(i), range((SELECT 3 * (max(i2) + 1) FROM g)) AS c(i)) SELECT f.i1, f.i2, coalesce(b.v, 0.0) AS v, CASE WHEN f.i2 % 3 = 0 THEN 1 ELSE 0 END AS mask FROM f LEFT JOIN g b ON b.i1 = f.i1 AND b.i2 * 3 = f.i2")
def lpad(spark, sf):
    data, mask = X.interleave_zeros(whole(spark, sf), 2, 3)
    return data.df.join(mask.df.withColumnRenamed("v", "mask"), ["i1", "i2"])


@query(f"WITH {VECTORS} SELECT (i1 + 64 * i2) % 32 AS i1, (i1 + 64 * i2) // 32 AS i2, v FROM g")
def put_reshape(spark, sf):
    g = whole(spark, sf)
    return X.reshape(g, [32, 2 * g.axis(2).n]).df
