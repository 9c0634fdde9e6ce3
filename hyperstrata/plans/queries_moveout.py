"""Queries on moveout, angles, smoothing, helices and small solvers; all vectors take part."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis, Header
from hyperstrata.operators import moveout as M
from hyperstrata.operators.grid import Grid, from_traces
from hyperstrata.plans.adapters import panels, panels_sql, table
from hyperstrata.plans.catalog import query, rounded
from hyperstrata.plans.queries_extra import _taps
from hyperstrata.plans.queries_select import R

#: embeddings as gathers of 10 by 10 traces.
CUBE = "g AS (SELECT vec_id % 10 AS i2, vec_id // 10 % 10 AS i3, vec_id // 100 AS i4, CAST(unnest(range(len(embedding))) AS BIGINT) AS i1, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def cube(spark, sf, d1=0.01, o2=0.0, d2=1.0, o3=0.0, d3=1.0) -> Grid:
    vec = F.col("vec_id")
    lines = table(spark, sf, "embeddings").select((vec % 10).alias("i2"), F.expr("vec_id div 10 % 10").alias("i3"), F.expr("vec_id div 100").alias("i4"), F.col("embedding").cast("array<double>").alias("trace"))
    return from_traces(lines, Header((Axis(64, 0.0, d1), Axis(10, o2, d2), Axis(10, o3, d3), Axis())))


def _gathered(source: str, p: str, lines: str) -> str:
    """Lines of g read at place ``p`` of each of their 64 samples."""
    return f"WITH {source} SELECT i1, {lines}, {R('v')} AS v FROM ({_taps(f'SELECT i1, {lines}, {p} AS p FROM g', lines)})"


def _scattered(source: str, p: str, lines: str, v: str = "v") -> str:
    """Samples of g put at place ``p``, shared by the two samples next to it; means of what falls on one."""
    return f"""WITH {source}, p AS (SELECT i1, {lines}, {v} AS v, {p} AS p FROM g), s AS (SELECT CAST(floor(p) AS BIGINT) + e.e AS i1, {lines}, v, CASE e.e WHEN 0 THEN 1 - (p - floor(p)) ELSE p - floor(p) END AS w FROM p, range(2) AS e(e) WHERE p IS NOT NULL),
t AS (SELECT i1, {lines}, sum(v * w) AS s, sum(w) AS f FROM s WHERE w > 0 GROUP BY ALL)
SELECT i1, {lines}, {R("CASE WHEN f > 1e-9 THEN s / f ELSE 0.0 END", 5)} AS v FROM (SELECT i1, {lines} FROM g) LEFT JOIN t USING (i1, {lines})"""


_ELLIPSE = "sqrt(pow(i1 * 0.01, 2) + (0.3 + 0.1 * i1 * 0.01) * pow(0.04 + i2 * 0.1, 2) + 0.5 * pow(i3 * 0.06, 2) + 2 * 0.05 * (0.04 + i2 * 0.1) * (i3 * 0.06)) / 0.01"


def _ellipse(spark, sf, inverse=False):
    g = cube(spark, sf, o2=0.02, d2=0.05, d3=0.03)
    return rounded(M.ellipse(g, F.lit(0.3) + F.lit(0.1) * g.x(1), F.lit(0.5), F.lit(0.05), inverse=inverse).df, 5 if inverse else 6)


@query(_gathered(CUBE, _ELLIPSE, "i2, i3, i4"))
def nmo3(spark, sf):
    return _ellipse(spark, sf)


@query(_scattered(CUBE, _ELLIPSE, "i2, i3, i4"))
def inmo3(spark, sf):
    return _ellipse(spark, sf, inverse=True)


_ROOT = "sqrt(greatest(1 - pow((0.01 + i2 * 0.037) * (1.5 + 0.02 * i1), 2), 0))"
_INTERVAL = f"coalesce(sum({_ROOT}) OVER (PARTITION BY i2, i3 ORDER BY i1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
_EFFECTIVE = f"CASE WHEN 1 - pow((0.01 + i2 * 0.037) * (1.5 + 0.02 * i1), 2) >= 0 THEN {_ROOT} * i1 END"


def _slopes(spark, sf, **keys):
    g = panels(spark, sf, 10, 0.01).put(o2=0.01, d2=0.037)
    return rounded(M.slope_moveout(g, F.lit(1.5) + F.lit(0.02) * F.col("i1"), **keys).df, 5 if keys.get("inverse") else 6)


@query(_gathered(panels_sql(10), _INTERVAL, "i2, i3"))
def taupmo(spark, sf):
    return _slopes(spark, sf)


@query(_gathered(panels_sql(10), f"coalesce({_EFFECTIVE}, -1)", "i2, i3"))
def taupmo_effective(spark, sf):
    return _slopes(spark, sf, interval=False)


@query(_scattered(panels_sql(10), _INTERVAL, "i2, i3"))
def itaupmo(spark, sf):
    return _slopes(spark, sf, inverse=True)


@query(_gathered(CUBE, "(i1 * 0.01 + (0.05 + i3 * 0.02) * pow(0.1 + i2 * 0.07, 2) / (0.1 + i2 * 0.07 + i1 * 0.01 * (0.05 + i3 * 0.02) * pow(1.5 + 0.01 * i1, 2))) / 0.01", "i2, i3, i4"))
def txpnmo(spark, sf):
    g = cube(spark, sf, o2=0.1, d2=0.07, o3=0.05, d3=0.02)
    return rounded(M.time_offset_slope(g, F.lit(1.5) + F.lit(0.01) * F.col("i1")).df)


_APEX = "(i1 * 0.01 - (0.3 + 0.01 * i1) * (0.1 + i2 * 0.05 + 0.025) * 0.01 / 0.05)"
_SLOPE_PLACE = f"CASE WHEN {_APEX} >= 0 AND {_APEX} <= i1 * 0.01 THEN sqrt(i1 * 0.01 * {_APEX}) / 0.01 END"


def _slope(spark, sf, operator):
    return rounded(operator(panels(spark, sf, 10, 0.01).put(o2=0.1, d2=0.05), F.lit(0.3) + F.lit(0.01) * F.col("i1")).df, 5)


@query(_scattered(panels_sql(10), _SLOPE_PLACE, "i2, i3"))
def pnmo(spark, sf):
    return _slope(spark, sf, M.slope_nmo)


@query(_scattered(panels_sql(10), _SLOPE_PLACE, "i2, i3", f"(0.1 + i2 * 0.05 + 0.025) / sqrt(greatest(i1 * 0.01 * (i1 * 0.01 - {_APEX}), 0) + 1.0 / 65536)"))
def pnmo_velocity(spark, sf):
    return _slope(spark, sf, M.slope_velocity)


def _angles(slant: str, o2: str, d2: str) -> str:
    """Panels of 10 slants read at the slant of each of 12 angles from 0, 4 degrees apart."""
    return f"""WITH {panels_sql(10)}, q AS (SELECT i.i AS i1, k.i AS i2, u.i3, radians(k.i * 4.0) AS a FROM range(64) AS i(i), range(12) AS k(i), (SELECT DISTINCT i3 FROM g) u), p AS (SELECT *, ({slant} - {o2}) / {d2} AS p FROM q)
SELECT p.i1, p.i2, p.i3, {R("CASE WHEN p >= 0 AND p <= 9 THEN coalesce(a.v, 0) * (1 - (p - floor(p))) + coalesce(b.v, 0) * (p - floor(p)) ELSE 0.0 END")} AS v FROM p LEFT JOIN g a ON a.i1 = p.i1 AND a.i3 = p.i3 AND a.i2 = floor(p) LEFT JOIN g b ON b.i1 = p.i1 AND b.i3 = p.i3 AND b.i2 = floor(p) + 1"""


_DIP = "(0.1 + i1 * 0.003)"


def _lags(spark, sf, rule, o2, d2):
    g = panels(spark, sf, 10).put(o2=o2, d2=d2)
    dip, velocity, ratio = F.lit(0.1) + F.col("i1") * F.lit(0.003), F.lit(1.5) + F.col("i1") * F.lit(0.004), F.lit(1.8) + F.col("i1") * F.lit(0.002)
    return rounded(M.lag_to_angle(g, rule, Axis(12, 0.0, 4.0), dip, velocity, ratio).df)


@query(_angles(f"(1.5 + i1 * 0.004) * sqrt(1 + {_DIP} * {_DIP}) * sqrt(1 + tan(a) * tan(a))", "1.45", "0.1"))
def tshift(spark, sf):
    return _lags(spark, sf, "time", 1.45, 0.1)


_CONVERTED = f"(1.5 + i1 * 0.004) * sqrt(1 + {_DIP} * {_DIP}) / sqrt(1.8 + i1 * 0.002) / sqrt(pow(cos(a), 2) + pow(0.8 + i1 * 0.002, 2) / (4 * (1.8 + i1 * 0.002)))"


@query(_angles(_CONVERTED, "1.0", "0.07"))
def tlagtoang2d(spark, sf):
    return _lags(spark, sf, "converted time", 1.0, 0.07)


@query(_angles(_CONVERTED, "1.05", "0.05"))
def pp2pstsic(spark, sf):
    return _lags(spark, sf, "converted time", 1.05, 0.05)


@query(_angles(f"(4 * (1.8 + i1 * 0.002) * tan(a) + {_DIP} * (pow(1.8 + i1 * 0.002, 2) - 1) * (pow(tan(a), 2) + 1)) / (pow(tan(a), 2) * pow(0.8 + i1 * 0.002, 2) + pow(2.8 + i1 * 0.002, 2))", "0.0", "0.1"))
def xlagtoang2d(spark, sf):
    return _lags(spark, sf, "converted space", 0.0, 0.1)


_X, _Y = "(0.1 + i2 * 0.2)", "(i3 * 0.3)"


@query(f"WITH {CUBE} SELECT i1, i4, {R(f'sum(4 * {_X} * {_X} * v)', 5)} AS wx, {R(f'sum(4 * {_Y} * {_Y} * v)', 5)} AS wy, {R(f'sum(8 * {_X} * {_Y} * v)', 5)} AS wxy FROM g GROUP BY 1, 2")
def nmow_adj(spark, sf):
    return rounded(M.moveout_products(cube(spark, sf, o2=0.1, d2=0.2, d3=0.3)), 5)


@query(f"WITH {CUBE} SELECT i1, i4, {R(f'sum(pow({_X} * {_X} + {_Y} * {_Y}, 2)) / sum(({_X} * {_X} + {_Y} * {_Y}) * (v + 2.0))', 5)} AS v FROM g GROUP BY 1, 2")
def nmov(spark, sf):
    g = cube(spark, sf, o2=0.1, d2=0.2, d3=0.3)
    return rounded(M.isotropic_velocity(g.with_v(F.col("v") + 2.0)), 5)


@query(_gathered(CUBE, "sqrt(pow(i1 * 0.01, 2) + (0.4 + 0.1 * i1 * 0.01) * (pow(0.04 + i2 * 0.1, 2) + pow(i3 * 0.06, 2)) - 0.1 * (pow(0.04 + i2 * 0.1, 2) - pow(i3 * 0.06, 2)) + 2 * 0.05 * (0.04 + i2 * 0.1) * (i3 * 0.06)) / 0.01", "i2, i3, i4"))
def nmo3_ort(spark, sf):
    g = cube(spark, sf, o2=0.02, d2=0.05, d3=0.03)
    return rounded(M.ellipse_by_parts(g, F.lit(0.4) + F.lit(0.1) * g.x(1), F.lit(-0.1), F.lit(0.05)).df)


@query(f"SELECT t.i AS i1, h.i AS i2, v.i AS i3, {R('pow(1.5 + v.i * 0.1, -2) * (0.2 + h.i * 0.1) * CASE h.i WHEN 0 THEN 0.05 ELSE 0.1 END / (0.004 * greatest(sqrt(pow(t.i * 0.004, 2) + pow((0.2 + h.i * 0.1) / (1.5 + v.i * 0.1), 2)), 0.004))')} AS v FROM range(100) AS t(i), range(24) AS h(i), range(10) AS v(i)")
def nmodips(spark, sf):
    return rounded(M.moveout_slopes(spark, Axis(100, 0.0, 0.004), Axis(24, 0.2, 0.1), Axis(10, 1.5, 0.1), 0.05).df.select("i1", "i2", "i3", "v"))
