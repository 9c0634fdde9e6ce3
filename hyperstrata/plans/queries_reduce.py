"""Stacks, attributes, semblance, medians and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyperstrata.operators import algebra, reduce as A
from hyperstrata.plans.adapters import LINES, VECTORS, gathers, lines, table, vectors
from hyperstrata.plans.catalog import query, rounded
from hyperstrata.plans.queries_select import PARITY, R, halves

_STACKS = {
    "sum": "sum(v)",
    "mean": "coalesce(avg(CASE WHEN v <> 0 THEN v END), 0.0)",
    "rms": "coalesce(sqrt(avg(CASE WHEN v <> 0 THEN v * v END)), 0.0)",
    "min": "min(v)",
    "max": "max(v)",
}
for _how, _value in _STACKS.items():

    @query(f"WITH {LINES} SELECT i2 AS i1, {R(_value, 6)} AS v FROM g GROUP BY i2", name=f"stack_{_how}")
    def _stack(spark, sf, how=_how):
        return rounded(A.stack(lines(spark, sf), 1, how).df, 6)

    @query(f"WITH {VECTORS} SELECT i1, i3 AS i2, {R(_value)} AS v FROM g GROUP BY i1, i3", name=f"stack_gather_{_how}")
    def _stack_gather(spark, sf, how=_how):
        return rounded(A.stack(gathers(spark, sf), 2, how).df)


@query(f"WITH {VECTORS} SELECT i2 AS i1, {R('product(1 + v)')} AS v FROM g GROUP BY i2")
def stack_prod(spark, sf):
    g = vectors(spark, sf)
    return rounded(A.stack(g.with_v(F.col("v") + 1), 1, "prod").df)


@query("SELECT l_partkey AS i1, CAST(sum(CASE WHEN l_discount <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS v FROM lineitem GROUP BY 1")
def fold(spark, sf):
    """Live (non-zero) discounts of each part."""
    df = table(spark, sf, "lineitem")
    from hyperstrata.operators.grid import Grid, ragged

    grid = Grid(df.select(F.col("l_orderkey").alias("i2"), F.col("l_partkey").alias("i1"), F.col("l_discount").alias("v")), ragged())
    return A.fold(grid, 2).df


@query(f"WITH {VECTORS} SELECT i1, i3 AS i2, {R('sum(v) * sum(v) / (sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) * sum(v * v))')} AS v FROM g GROUP BY i1, i3")
def semblance(spark, sf):
    return rounded(A.semblance(gathers(spark, sf), 2).df)


@query(f"WITH {LINES} SELECT i2 AS i1, {R('median(v)', 4)} AS v FROM g GROUP BY i2")
def median_axis1(spark, sf):
    return rounded(A.median(lines(spark, sf), 1).df, 4)


@query(f"""WITH {LINES} SELECT {R("avg(v)", 3)} AS mean, {R("sqrt(avg(v * v))", 3)} AS rms, {R("sqrt(sum(v * v))", 2)} AS norm2, {R("var_samp(v)", 1)} AS var, {R("stddev_samp(v)", 3)} AS std,
max(v) AS max, min(v) AS min, max(abs(v)) AS amax, count(*) AS samples, CAST(sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS nonzero FROM g""")
def attr(spark, sf):
    d = A.attributes(lines(spark, sf).df)
    digits = {"mean": 3, "rms": 3, "norm2": 2, "var": 1, "std": 3}
    return d.select(*[(F.round(c, digits[c]) + 0.0).alias(c) if c in digits else F.col(c) for c in d.columns])


_KEYS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query(" UNION ALL ".join(f"SELECT '{k}' AS key, CAST(min({k}) AS DOUBLE) AS min, CAST(max({k}) AS DOUBLE) AS max, round(CAST(avg({k}) AS DOUBLE), 6) + 0.0 AS mean FROM lineitem" for k in _KEYS))
def headerattr(spark, sf):
    return rounded(A.header_attributes(table(spark, sf, "lineitem"), _KEYS))


@query("SELECT l_suppkey, round(regr_intercept(l_extendedprice, l_quantity), 4) + 0.0 AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 AS slope FROM lineitem GROUP BY l_suppkey")
def linefit(spark, sf):
    return rounded(A.line_fit(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice"), 4)


@query(f"WITH {VECTORS} SELECT i1, i3, {R('regr_intercept(v, i2)')} AS intercept, {R('regr_slope(v, i2)', 8)} AS slope FROM g GROUP BY i1, i3")
def avo(spark, sf):
    d = A.line_fit(gathers(spark, sf).df, ["i1", "i3"], "i2", "v")
    return d.select("i1", "i3", (F.round("intercept", 6) + 0.0).alias("intercept"), (F.round("slope", 8) + 0.0).alias("slope"))


@query(f"WITH {VECTORS} SELECT i1, i3, {R('avg(v) * avg(v) / var_samp(v)')} AS snr FROM g GROUP BY i1, i3")
def snr_stack(spark, sf):
    return rounded(A.normalised_stack(gathers(spark, sf).df, ["i1", "i3"], "v"))


@query(f"WITH {VECTORS} SELECT i1 // 4 AS i1, i2, {R('sum(v)')} AS v FROM g GROUP BY 1, 2")
def presum(spark, sf):
    return rounded(A.partial_sums(vectors(spark, sf), 1, 4).df)


@query(f"WITH {VECTORS}, {PARITY} SELECT e.i2, {R('sum(e.v * o.v)')} AS v FROM even e JOIN odd o USING (i1, i2) GROUP BY e.i2")
def dot_traces(spark, sf):
    return rounded(A.dot_by(*halves(spark, sf), 1))


_MATRIX = "m AS (SELECT a.i AS row, c.i AS col, 1.0 / (1 + a.i + c.i) AS a FROM range(8) AS a(i), range(64) AS c(i))"


def _matrix(spark, rows=8, cols=64):
    return spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("row"), (F.col("id") % cols).alias("col")).withColumn("a", F.lit(1.0) / (1 + F.col("row") + F.col("col")))


@query(f"WITH {VECTORS}, {_MATRIX} SELECT m.row AS i1, g.i2, {R('sum(m.a * g.v)')} AS v FROM m JOIN g ON m.col = g.i1 GROUP BY 1, 2")
def matmult(spark, sf):
    return rounded(algebra.matvec(_matrix(spark), vectors(spark, sf), 8).df)


@query(f"WITH {VECTORS}, {_MATRIX} SELECT m.col AS i1, g.i2, {R('sum(m.a * g.v)')} AS v FROM m JOIN g ON m.row = g.i1 GROUP BY 1, 2")
def matmult_adjoint(spark, sf):
    return rounded(algebra.matvec(_matrix(spark), vectors(spark, sf), 64, adjoint=True).df)


@query(f"WITH {VECTORS} SELECT a.i1 AS row, b.i1 AS col, {R('avg(a.v * b.v)')} AS a FROM g a JOIN g b USING (i2) GROUP BY 1, 2")
def covariance(spark, sf):
    return rounded(algebra.covariance(vectors(spark, sf)))


@query(f"""WITH {VECTORS}, a AS (SELECT i2 AS row, i1 // 2 AS col, max(CASE WHEN i1 % 2 = 0 THEN v END) AS re, max(CASE WHEN i1 % 2 = 1 THEN v END) AS im FROM g GROUP BY 1, 2),
b AS (SELECT col AS row, row AS col, re, -im AS im FROM a)
SELECT a.row, b.col, {R("sum(a.re * b.re - a.im * b.im)", 4)} AS re, {R("sum(a.re * b.im + a.im * b.re)", 4)} AS im FROM b AS a JOIN a AS b ON a.col = b.row GROUP BY 1, 2""")
def cmatmult2(spark, sf):
    """The conjugate transpose of all vectors, taken as complex, times themselves."""
    from hyperstrata.operators.select import to_complex

    c = to_complex(vectors(spark, sf), pair=True).df
    a = c.select(F.col("i2").alias("row"), F.col("i1").alias("col"), "v.re", "v.im")
    b = a.select(F.col("col").alias("row"), F.col("row").alias("col"), "re", (-F.col("im")).alias("im"))
    return rounded(algebra.complex_matmul(b, a), 4)
