"""Chains of named programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyperstrata.plans.adapters import VECTORS, gathers, vectors
from hyperstrata.plans.catalog import query, rounded
from hyperstrata.plans.flow import flow
from hyperstrata.plans.queries_select import PARITY, R, halves


@query(f"""WITH {VECTORS}, w AS (SELECT i1 - 8 AS i1, i2, v FROM g WHERE i1 BETWEEN 8 AND 55), c AS (SELECT i1, i2, 0.5 * sum(v) OVER (PARTITION BY i2 ORDER BY i1) AS v FROM w)
SELECT i1, i2, {R("least(greatest(v, -0.25), 0.25)")} AS v FROM c""")
def flow_chain(spark, sf):
    return rounded(flow("window f1=8 n1=48 squeeze=n | causint | scale dscale=0.5 | clip clip=0.25", {"input": vectors(spark, sf)}).df)


@query(f"WITH {VECTORS}, {PARITY} SELECT e.i1, e.i2, {R('sqrt(pow(0.004 * e.i1, 2) + pow(e.i2, 2)) * e.v - o.v / (1 + abs(e.v))')} AS v FROM even e JOIN odd o USING (i1, i2)")
def flow_math(spark, sf):
    a, b = halves(spark, sf)
    return rounded(flow('put d1=0.004 | math output="sqrt(x1^2 + x2^2)*input - other/(1 + abs(input))"', {"input": a, "other": b.put(d1=0.004)}).df)


@query(f"WITH {VECTORS}, s AS (SELECT i1, i3, sum(v) AS v FROM g GROUP BY 1, 2) SELECT i3 AS i1, 63 - i1 AS i2, {R('v')} AS v FROM s")
def flow_stack_transpose(spark, sf):
    return rounded(flow("stack axis=2 norm=n | transp plane=12 | reverse which=2", {"input": gathers(spark, sf)}).df)


@query(f"WITH {VECTORS} SELECT i1, i2, CAST(round(v * 100) AS INTEGER) AS v FROM g")
def flow_dd(spark, sf):
    return flow("scale dscale=100 | dd type=int", {"input": vectors(spark, sf)}).df


@query(f"WITH {VECTORS} SELECT i1, i2, CAST(greatest(0, least(255, floor(127.5 + 127.5 * v / 0.25 + 0.5))) AS INTEGER) AS v FROM g")
def byte_scale(spark, sf):
    """Amplitudes to 0 .. 255 about the middle, for a clip."""
    from hyperstrata.operators.select import byte

    return byte(vectors(spark, sf), 0.25).df


@query(f"WITH {VECTORS} SELECT i1 // 16 AS i1, i2 // 6 AS i2, {R('avg(v)')} AS v FROM g GROUP BY 1, 2")
def patch_means(spark, sf):
    """Means of 16 by 6 patches of all vectors."""
    df = vectors(spark, sf).df
    return rounded(df.groupBy(F.expr("i1 div 16").alias("i1"), F.expr("i2 div 6").alias("i2")).agg(F.avg("v").alias("v")))
