"""Queries on the data of figures, on extrapolation and on functions of samples; all vectors take part."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyperstrata.functions import expr
from hyperstrata.operators import algebra, figures
from hyperstrata.plans.adapters import VECTORS, panels, panels_sql, vectors
from hyperstrata.plans.catalog import query, rounded
from hyperstrata.plans.queries_select import R


@query(f"WITH {VECTORS} SELECT {R('0.5 + i1 * 0.004')} AS x, {R('v')} AS y, i2 FROM g")
def graph(spark, sf):
    return rounded(figures.curve(vectors(spark, sf).put(o1=0.5, d1=0.004)))


@query(f"WITH {VECTORS} SELECT i1, i2, {R('1.0 + i1 * 0.5 - 0.2')} AS left, {R('1.0 + i1 * 0.5 + 0.2')} AS right, {R('least(v, 0)')} AS bottom, {R('greatest(v, 0)')} AS top FROM g".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def bargraph(spark, sf):
    return rounded(figures.bars(vectors(spark, sf).put(o1=1.0, d1=0.5)))


_CUT = "greatest(least(v, 0.15), -0.15) * 2 / 0.15"


@query(f"WITH {VECTORS} SELECT i1, i2, {R(f'10 + i2 * 2 + {_CUT}')} AS x, {R('i1 * 0.004')} AS y, {R(f'greatest({_CUT}, 0)')} AS fill FROM g")
def wiggle(spark, sf):
    return rounded(figures.wiggles(vectors(spark, sf).put(d1=0.004, o2=10.0, d2=2.0), 0.15))


@query(f"""WITH {panels_sql(20)}, c AS (SELECT * FROM (VALUES (-0.1::DOUBLE), (0.0), (0.05)) AS c(level)), a AS (SELECT *, lead(v) OVER (PARTITION BY i2, i3 ORDER BY i1) AS w FROM g), b AS (SELECT *, lead(v) OVER (PARTITION BY i1, i3 ORDER BY i2) AS w FROM g)
SELECT level, 1 AS axis, i1, i2, i3, {R("0.5 * (i1 + (level - v) / (w - v))")} AS y, {R("i2 * 2.0")} AS x FROM a, c WHERE w IS NOT NULL AND greatest(v, w) >= level AND least(v, w) < level UNION ALL
SELECT level, 2, i1, i2, i3, {R("0.5 * i1")}, {R("2.0 * (i2 + (level - v) / (w - v))")} FROM b, c WHERE w IS NOT NULL AND greatest(v, w) >= level AND least(v, w) < level""")
def contour(spark, sf):
    return rounded(figures.crossings(panels(spark, sf, 20, 0.5, 2.0), [-0.1, 0.0, 0.05]))


@query(f"WITH {VECTORS} SELECT i1, i2, {R('v')} AS v, {R('-0.03 * cos(i1)')} AS error FROM g")
def rich(spark, sf):
    """Values with a second-order error at two steps are found without it."""
    g = vectors(spark, sf)
    at = lambda step: g.with_v(F.col("v") + F.lit(0.03 * step * step) * F.cos("i1"))
    return rounded(algebra.richardson(at(1.0), at(2.0), 2).select("i1", "i2", "v", "error"))


@query(f"WITH {VECTORS}, f AS (SELECT n, CASE n WHEN 0 THEN 1.0::DOUBLE ELSE gamma(n + 1.0) END AS f FROM range(25) AS n(n)) SELECT i1, i2, {R('sum((1 - 2 * (n % 2)) * pow(v, 2 * n + 1) / (f * (2 * n + 1))) * 2 / sqrt(pi())')} AS v FROM g, f GROUP BY 1, 2")
def erf(spark, sf):
    return rounded(vectors(spark, sf).with_v(expr.erf(F.col("v"))).df)


_FUNCTIONS = "cos(v) + 2*sin(v) + tan(v) + acos(v) + asin(v) + atan(v) + cosh(v) + sinh(v) + tanh(v) + asinh(v) + acosh(1.5+v) + atanh(v) + exp(v) + {log}(2+v) + sqrt(abs(v)) + sign(v) + floor(10*v)"


@query(f"WITH {VECTORS} SELECT i1, i2, {R(_FUNCTIONS.format(log='ln'))} AS v FROM (SELECT i1, i2, v / 2 AS v FROM g)")
def math_functions(spark, sf):
    """Every elementary function of expressions."""
    g = vectors(spark, sf).with_v(F.col("v") / 2)
    return rounded(g.with_v(expr.parse(_FUNCTIONS.format(log="log"), {"v": F.col("v")})).df)
