"""Generators, and kernels on lines and panels: numerical, so mostly without SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis, Header
from hyperstrata.operators import generate as G, inverse, panel as P, traces as T
from hyperstrata.operators.grid import Grid
from hyperstrata.plans.adapters import VECTORS, panels, panels_sql, vectors
from hyperstrata.plans.catalog import query, rounded
from hyperstrata.plans.queries_select import R


def _spectral(response: str, nt: int, where: str = "true") -> str:
    """CTEs: g, and f, its lines through a filter of the real and imaginary ``response`` at frequency k of nt.

    Said by definition: the response's inverse transform, moved along each line.
    """
    return f"""{VECTORS}, r AS (SELECT k, CASE WHEN k IN (0, {nt // 2}) THEN 1 ELSE 2 END AS c, {response} FROM range({nt // 2 + 1}) AS k(k) WHERE {where}),
h AS (SELECT m, sum(c * (re * cos(2 * pi() * ((k * m) % {nt}) / {nt}) - im * sin(2 * pi() * ((k * m) % {nt}) / {nt}))) / {nt} AS h FROM r, range({nt}) AS m(m) GROUP BY m),
f AS (SELECT i.i AS i1, g.i2, sum(g.v * h.h) AS f, sum(CASE WHEN g.i1 = i.i THEN g.v END) AS v FROM g, range(64) AS i(i), h WHERE h.m = (i.i - g.i1 + {nt}) % {nt} GROUP BY 1, 2)"""


def _impulse(name: str, b: tuple[str, str, str], a: tuple[str, str]) -> str:
    """CTE: the first 64 places of the answer of a recursive filter to a unit impulse."""
    return f"{name} AS (SELECT 0 AS m, CAST({b[0]} AS DOUBLE) AS h, 0.0::DOUBLE AS last UNION ALL SELECT m + 1, CASE m WHEN 0 THEN {b[1]} WHEN 1 THEN {b[2]} ELSE 0.0 END - ({a[0]}) * h - ({a[1]}) * last, h FROM {name} WHERE m < 63)"


def _convolved(name: str, source: str, impulse: str, backward: bool = False) -> str:
    """CTE: the lines of ``source`` convolved with an impulse's answer, from the end if backward."""
    m = f"{source}.i1 - i.i" if backward else f"i.i - {source}.i1"
    return f"{name} AS (SELECT i.i AS i1, {source}.i2, sum({source}.v * {impulse}.h) AS v FROM {source}, range(64) AS i(i), {impulse} WHERE {impulse}.m = {m} GROUP BY 1, 2)"


def _second_order(cut: str, high: bool) -> tuple[tuple[str, str, str], tuple[str, str]]:
    """Taps of a two-pole Butterworth filter by the bilinear transform, as SQL."""
    w = f"(2 * tan(pi() * {cut}))"
    a0 = f"(4 + 2 * sqrt(2) * {w} + {w} * {w})"
    b0 = f"4 / {a0}" if high else f"{w} * {w} / {a0}"
    b1 = f"-8 / {a0}" if high else f"2 * {w} * {w} / {a0}"
    return (b0, b1, b0), (f"(2 * {w} * {w} - 8) / {a0}", f"(4 - 2 * sqrt(2) * {w} + {w} * {w}) / {a0}")


_BANDPASS = ", ".join([
    VECTORS, _impulse("hi", *_second_order("0.04", True)), _impulse("lo", *_second_order("0.24", False)),
    _convolved("a", "g", "hi"), _convolved("b", "a", "hi", True), _convolved("c", "b", "lo"), _convolved("d", "c", "lo", True),
])
_HILBERT = _spectral("0.0 AS re, -1.0 AS im", 64, "k BETWEEN 1 AND 31")
_HALF_PHASE = "CASE WHEN k = 0 THEN 0.0 ELSE (pi() / 2 - pi() * k / 128) / 2 END"
_HALF_SIZE = "sqrt(greatest(2 * sin(pi() * k / 128), 0.001))"


def _burg(order: int) -> str:
    """Burg's recursion: forward and backward errors and one reflection coefficient a stage."""
    out = [VECTORS, "s0 AS (SELECT i1, i2, v AS f, v AS b FROM g)"]
    filters = ["1.0"]
    for n in range(1, order + 1):
        out.append(f"p{n} AS (SELECT i1, i2, f, lag(b) OVER (PARTITION BY i2 ORDER BY i1) AS b FROM s{n - 1})")
        out.append(f"k{n} AS (SELECT i2, -2 * sum(f * b) / sum(f * f + b * b) AS k{n} FROM p{n} WHERE b IS NOT NULL GROUP BY 1)")
        out.append(f"s{n} AS (SELECT i1, i2, f + k{n} * b AS f, b + k{n} * f AS b FROM p{n} JOIN k{n} USING (i2) WHERE b IS NOT NULL)")
        padded = [*filters, "0.0"]
        filters = [f"({a} + k{n} * {b})" for a, b in zip(padded, reversed(padded), strict=True)]
    joined = "k1 " + " ".join(f"JOIN k{n} USING (i2)" for n in range(2, order + 1))
    taps = " UNION ALL ".join(f"SELECT {i} AS i1, i2, {a} AS v FROM {joined}" for i, a in enumerate(filters))
    return f"WITH {', '.join(out)}, t AS ({taps}) SELECT CAST(i1 AS BIGINT) AS i1, i2, {R('v', 5)} AS v FROM t"


def _signed(k: str, n: int) -> str:
    return f"CASE WHEN {k} < {n // 2} THEN {k} ELSE {k} - {n} END"


def filled_sql(n1: int, n2: int, source: str = "g") -> str:
    """The CTE f: whole panels, 0 where ``source`` has no sample."""
    return f"f AS (SELECT a.i AS i1, b.i AS i2, u.i3, coalesce(v, 0.0) AS v FROM range({n1}) AS a(i), range({n2}) AS b(i), (SELECT DISTINCT i3 FROM {source}) u LEFT JOIN {source} ON {source}.i1 = a.i AND {source}.i2 = b.i AND {source}.i3 = u.i3)"


def dft_sql(name: str, source: str, axis: int, n: int, inverse: bool = False, real: bool = False, out: int | None = None) -> str:
    """CTE: the transform of axis 1 or 2 (of n places) of panels (i1, i2, i3, re, im or real v), by definition."""
    re, im = ("v", "0.0") if real else ("re", "im")
    angle, other = f"(2 * pi() * ((k.k * i{axis}) % {n}) / {n})", 3 - axis
    c, d = f"cos({angle})", f"{'' if inverse else '-'}sin({angle})"
    scale = f" / {n}" if inverse else ""
    return f"{name} AS (SELECT CAST(k.k AS BIGINT) AS i{axis}, i{other}, i3, sum({re} * {c} - {im} * ({d})){scale} AS re, sum({re} * ({d}) + {im} * {c}){scale} AS im FROM {source}, range({out or n}) AS k(k) GROUP BY 1, 2, 3)"


_SPECTRA2 = ", ".join([panels_sql(64), dft_sql("a", "g", 1, 64, real=True, out=33), dft_sql("b", "a", 2, 64)])
_DIPFILTER = ", ".join([
    panels_sql(64), dft_sql("a", "g", 1, 64, real=True), dft_sql("b", "a", 2, 64),
    f"c AS (SELECT * FROM b WHERE i1 = 0 OR -({_signed('i2', 64)})::DOUBLE / ({_signed('i1', 64)}) BETWEEN -0.5 AND 0.5)",
    dft_sql("d", "c", 2, 64, inverse=True), dft_sql("e", "d", 1, 64, inverse=True),
])


def _smoothed_panel(columns: list[str]) -> str:
    """CTEs t1 and t2: triangle smoothing of panels p (64 by 64) over both axes, edges mirrored."""
    out, source = [], "p"
    for axis in (1, 2):
        at = f"i{axis} + m.m"
        near = f"CASE WHEN {at} < 0 THEN -1 - ({at}) WHEN {at} > 63 THEN 127 - ({at}) ELSE {at} END"
        asked = f"(SELECT *, {near} AS j FROM (SELECT i1, i2, i3 FROM {source}) _, range(-4, 5) AS m(m))"
        other = 3 - axis
        sums = ", ".join(f"sum((5 - abs(q.m)) / 25.0::DOUBLE * s.{c}) AS {c}" for c in columns)
        out.append(f"t{axis} AS (SELECT q.i1, q.i2, q.i3, {sums} FROM {asked} q JOIN {source} s ON s.i{axis} = q.j AND s.i{other} = q.i{other} AND s.i3 = q.i3 GROUP BY 1, 2, 3)")
        source = f"t{axis}"
    return ", ".join(out)


def _central(axis: int) -> str:
    """SQL: central differences inside, one-sided ones at the ends."""
    w = f"OVER (PARTITION BY i{3 - axis}, i3 ORDER BY i{axis})"
    return f"CASE WHEN i{axis} = 0 THEN lead(v) {w} - v WHEN i{axis} = 63 THEN v - lag(v) {w} ELSE (lead(v) {w} - lag(v) {w}) / 2 END"


def _diffusion(steps: int) -> str:
    """Each step: differences, the median of their sizes in a panel, and the flow over the edges of cells."""
    out, last = [panels_sql(64), filled_sql(64, 64)], "f"
    for n in range(steps):
        out.append(f"d{n} AS (SELECT *, lead(v) OVER (PARTITION BY i2, i3 ORDER BY i1) - v AS a, lead(v) OVER (PARTITION BY i1, i3 ORDER BY i2) - v AS b FROM {last})")
        out.append(f"k{n} AS (SELECT i3, quantile_cont(x, 0.5) AS k FROM (SELECT i3, abs(a) AS x FROM d{n} WHERE a IS NOT NULL UNION ALL SELECT i3, abs(b) FROM d{n} WHERE b IS NOT NULL) GROUP BY 1)")
        out.append(f"e{n} AS (SELECT i1, i2, i3, v, coalesce(a / (1 + pow(a / CASE k WHEN 0 THEN 1 ELSE k END, 2)), 0) AS a, coalesce(b / (1 + pow(b / CASE k WHEN 0 THEN 1 ELSE k END, 2)), 0) AS b FROM d{n} JOIN k{n} USING (i3))")
        out.append(f"u{n} AS (SELECT i1, i2, i3, v + 0.2 * (a + b - coalesce(lag(a) OVER (PARTITION BY i2, i3 ORDER BY i1), 0) - coalesce(lag(b) OVER (PARTITION BY i1, i3 ORDER BY i2), 0)) AS v FROM e{n})")
        last = f"u{n}"
    return f"WITH {', '.join(out)} SELECT i1, i2, i3, {R('v', 5)} AS v FROM {last}"


#: Curvatures of the natural spline through 64 knots by the closed inverse of their (1, 4, 1) system.
_SPLINE = f"""WITH {VECTORS}, c AS (SELECT i1, i2, v, 6 * (lead(v) OVER w - 2 * v + lag(v) OVER w) AS c FROM g WINDOW w AS (PARTITION BY i2 ORDER BY i1)),
n AS (SELECT a.i AS i, b.i AS j, (1 - 2 * ((a.i + b.i) % 2)) * sinh(least(a.i, b.i) * acosh(2.0)) * sinh((63 - greatest(a.i, b.i)) * acosh(2.0)) / (sinh(acosh(2.0)) * sinh(63 * acosh(2.0))) AS x FROM range(1, 63) AS a(i), range(1, 63) AS b(i)),
m AS (SELECT n.i AS i1, c.i2, sum(n.x * c.c) AS m FROM n JOIN c ON c.i1 = n.j GROUP BY 1, 2),
k AS (SELECT i1, i2, v, coalesce(m, 0.0) AS m, lead(v) OVER w AS v1, lead(coalesce(m, 0.0)) OVER w AS m1 FROM g LEFT JOIN m USING (i1, i2) WINDOW w AS (PARTITION BY i2 ORDER BY i1)),
o AS (SELECT i.i AS i1, -1.0::DOUBLE + 0.35::DOUBLE * i.i AS x FROM range(200) AS i(i)), q AS (SELECT *, least(greatest(floor(x), 0), 62) AS b, least(greatest(x, 0), 63) - least(greatest(floor(x), 0), 62) AS t FROM o)
SELECT q.i1, k.i2, {R("v + t * (v1 - v - (2 * m + m1) / 6) + t * t * m / 2 + t * t * t * (m1 - m) / 6 + CASE WHEN x < 0 THEN x * (v1 - v - m1 / 6) WHEN x > 63 THEN (x - 63) * (v1 - v + m / 6) ELSE 0 END", 5)} AS v FROM q JOIN k ON k.i1 = q.b"""

#: Labels spread over whole runs of columns and rows in turn until nothing can change.
_COMPONENTS = f"""WITH RECURSIVE {panels_sql(64)}, s AS (SELECT i1, i2, i3, i2 * 64 + i1 AS c FROM g WHERE v > 0.1),
r AS (SELECT *, i1 - row_number() OVER (PARTITION BY i2, i3 ORDER BY i1) AS down, i2 - row_number() OVER (PARTITION BY i1, i3 ORDER BY i2) AS across FROM s),
u AS (SELECT 0 AS n, * FROM r UNION ALL SELECT n + 1, i1, i2, i3, min(c) OVER (PARTITION BY i1, i3, across), down, across FROM (SELECT n, i1, i2, i3, min(c) OVER (PARTITION BY i2, i3, down) AS c, down, across FROM u WHERE n < 150)),
l AS (SELECT i1, i2, i3, dense_rank() OVER (PARTITION BY i3 ORDER BY c) AS l FROM u WHERE n = 150)
SELECT a.i AS i1, b.i AS i2, p.i3, CAST(coalesce(l, 0) AS DOUBLE) AS v FROM range(64) AS a(i), range(64) AS b(i), (SELECT DISTINCT i3 FROM g) p LEFT JOIN l ON l.i1 = a.i AND l.i2 = b.i AND l.i3 = p.i3"""

#: The scheme's only solution, as the limit of repeated sweeps (cells of 10 by 10).
_EIKONAL = f"""WITH RECURSIVE u AS (SELECT 0 AS n, a.i AS i1, b.i AS i2, 10 / CASE WHEN a.i >= floor(0.5 + (300 + b.i) / 10.0) THEN 2500.0 ELSE 1500.0 END::DOUBLE AS s, CASE WHEN a.i = 3 AND b.i = 20 THEN 0.0 ELSE 1e9 END::DOUBLE AS t FROM range(60) AS a(i), range(40) AS b(i) UNION ALL
SELECT n + 1, i1, i2, s, least(t, CASE WHEN abs(x - y) < s THEN (x + y + sqrt(2 * s * s - (x - y) * (x - y))) / 2 ELSE least(x, y) + s END) FROM (SELECT *, least(coalesce(lag(t) OVER p, 1e9), coalesce(lead(t) OVER p, 1e9)) AS x, least(coalesce(lag(t) OVER q, 1e9), coalesce(lead(t) OVER q, 1e9)) AS y FROM u WHERE n < 200 WINDOW p AS (PARTITION BY i2 ORDER BY i1), q AS (PARTITION BY i1 ORDER BY i2)))
SELECT i1, i2, {R("t", 5)} AS v FROM u WHERE n = 200"""


def _beside(c: str, axis: int) -> tuple[str, str]:
    """SQL: the samples before and after along an axis, edges repeated."""
    w = f"OVER (PARTITION BY i{3 - axis}, i3 ORDER BY i{axis})"
    return f"coalesce(lag({c}) {w}, {c})", f"coalesce(lead({c}) {w}, {c})"


def _canny() -> str:
    """Sobel gradients, cells not under those across their edge, two percentiles, and weak cells that touch strong ones."""
    a, b = _beside("v", 1), _beside("v", 2)
    c, d = _beside("y", 1), _beside("x", 2)
    near = lambda m, n: f"coalesce((SELECT g FROM q o WHERE o.i3 = q.i3 AND o.i2 = q.i2 + ({m}) AND o.i1 = q.i1 + ({n})), 0)"
    ways = {0: (0, 1), 1: (1, 1), 2: (1, 0), 3: (1, -1)}
    thin = " OR ".join(f"(s = {k} AND g >= {near(m, n)} AND g > {near(-m, -n)})" for k, (m, n) in ways.items())
    return f"""WITH RECURSIVE {panels_sql(64)}, {filled_sql(64, 64)}, x AS (SELECT i1, i2, i3, {a[0]} + 2 * v + {a[1]} AS x, {b[0]} + 2 * v + {b[1]} AS y FROM f),
d AS (SELECT i1, i2, i3, {c[1]} - {c[0]} AS s1, {d[1]} - {d[0]} AS s2 FROM x), q AS (SELECT i1, i2, i3, s1 * s1 + s2 * s2 AS g, (CAST(round_even(atan2(s2, s1) / (pi() / 4), 0) AS BIGINT) + 8) % 4 AS s FROM d),
t AS (SELECT i1, i2, i3, CASE WHEN {thin} THEN g ELSE 0 END AS t FROM q), p AS (SELECT i3, quantile_cont(t, 0.95) AS low, quantile_cont(t, 0.98) AS high FROM t GROUP BY 1),
w AS (SELECT i1, i2, i3, t > high AS strong FROM t JOIN p USING (i3) WHERE t > low),
r AS (SELECT i1, i2, i3 FROM w WHERE strong UNION SELECT w.i1, w.i2, w.i3 FROM r JOIN w ON w.i3 = r.i3 AND abs(w.i1 - r.i1) <= 1 AND abs(w.i2 - r.i2) <= 1)
SELECT f.i1, f.i2, f.i3, CASE WHEN r.i1 IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS v FROM f LEFT JOIN r ON r.i1 = f.i1 AND r.i2 = f.i2 AND r.i3 = f.i3"""


@query("SELECT a.i AS i1, b.i AS i2, CASE WHEN a.i = 4 THEN 1.0 ELSE 0.0 END + CASE WHEN a.i BETWEEN 1 AND 2 AND b.i = 6 THEN 2.5 ELSE 0.0 END AS v FROM range(10) AS a(i), range(8) AS b(i)")
def spike(spark, sf):
    return G.spike(spark, Header((Axis(10), Axis(8))), [{"k": {1: 5}}, {"k": {1: 2, 2: 7}, "l": {1: 3}, "mag": 2.5}]).df


@query(f"SELECT a.i AS i1, b.i AS i2, {R('sin(0.5 + a.i * 0.1) * exp(-(b.i * 0.2))')} AS v FROM range(20) AS a(i), range(15) AS b(i)")
def math_generator(spark, sf):
    return rounded(G.math_grid(spark, Header((Axis(20, 0.5, 0.1), Axis(15, 0.0, 0.2))), "sin(x1) * exp(-x2)").df)


@query(f"""WITH d AS (SELECT a.i AS i1, b.i AS i2, a.i * 10.0 AS z, b.i * 25.0 AS x FROM range(50) AS a(i), range(20) AS b(i))
SELECT i1, i2, {R("CASE WHEN i1 >= floor(0.5 + (300.0 - x * 0.1) / 10) THEN 2500.0 + (z - (300.0 - x * 0.1)) * 0.3 WHEN i1 >= floor(0.5 + (150.0 + x * 0.2) / 10) THEN 2000.0 + x * 0.1 ELSE 1500.0 END")} AS v FROM d""")
def unif2(spark, sf):
    return rounded(G.layered(spark, Header((Axis(50, 0.0, 10.0), Axis(20, 0.0, 25.0))), [(150.0, 0.2), (300.0, -0.1)], [(1500.0, 0.0, 0.0), (2000.0, 0.1, 0.0), (2500.0, 0.0, 0.3)]).df)


@query()
def noise(spark, sf):
    """Seeded normal noise added to the vectors; the same on every run."""
    return rounded(G.noise(vectors(spark, sf), 7, variance=0.01).df)


@query("""WITH RECURSIVE c AS (SELECT a.i AS i1, b.i AS i2, -2.0::DOUBLE + a.i * 0.05::DOUBLE AS x, -1.25::DOUBLE + b.i * 0.05::DOUBLE AS y FROM range(60) AS a(i), range(50) AS b(i)), z AS (SELECT i1, i2, x, y, 0 AS n, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM c UNION ALL
SELECT i1, i2, x, y, n + 1, a * a - b * b + x, 2 * a * b + y FROM z WHERE sqrt(a * a + b * b) <= 2 AND n < 50)
SELECT i1, i2, CAST(max(n) AS DOUBLE) AS v FROM z GROUP BY 1, 2""")
def mandelbrot(spark, sf):
    return G.mandelbrot(spark, Header((Axis(60, -2.0, 0.05), Axis(50, -1.25, 0.05))), 50).df


@query(f"""WITH RECURSIVE p AS (SELECT 0 AS i, 3.051522::DOUBLE AS x, 1.582542::DOUBLE AS y, 15.62388::DOUBLE AS z UNION ALL
SELECT i + 1, x + 0.01 * 10 * (b - a), y + 0.01 * (a * (28 - c) - b), z + 0.01 * (a * b - 8.0::DOUBLE / 3 * c) FROM (SELECT *, x + 0.005 * 10 * (y - x) AS a, y + 0.005 * (x * (28 - z) - y) AS b, z + 0.005 * (x * y - 8.0::DOUBLE / 3 * z) AS c FROM p) WHERE i < 499)
SELECT CAST(k AS BIGINT) AS i1, CAST(i AS BIGINT) AS i2, {R("CASE k WHEN 0 THEN x WHEN 1 THEN y ELSE z END", 4)} AS v FROM p, range(3) AS k(k)""")
def lorenz(spark, sf):
    return rounded(G.lorenz(spark, 500).df, 4)


@query(f"""WITH {VECTORS} SELECT CAST(k.k AS BIGINT) AS i1, i2, {R("sum(v * cos(2 * pi() / 64 * ((i1 * k.k) % 64)))", 5)} AS re, {R("-sum(v * sin(2 * pi() / 64 * ((i1 * k.k) % 64)))", 5)} AS im FROM g, range(33) AS k(k) GROUP BY 1, 2""")
def fft1(spark, sf):
    return rounded(T.fft1(vectors(spark, sf)).df.select("i1", "i2", "v.re", "v.im"), 5)


@query(f"WITH {VECTORS} SELECT i1, i2, {R('v', 5)} AS v FROM g")
def fft1_round_trip(spark, sf):
    return rounded(T.ifft1(T.fft1(vectors(spark, sf))).df, 5)


@query(f"""WITH {VECTORS}, f AS (SELECT k.k AS i1, i2, sum(v * cos(2 * pi() / 64 * ((i1 * k.k) % 64))) AS a, sum(v * sin(2 * pi() / 64 * ((i1 * k.k) % 64))) AS b FROM g, range(33) AS k(k) GROUP BY 1, 2)
SELECT CAST(i1 AS BIGINT) AS i1, {R("avg(sqrt(a * a + b * b) / 8)", 5)} AS v FROM f GROUP BY 1""")
def spectra_all(spark, sf):
    return rounded(T.spectra(vectors(spark, sf), average=True).df, 5)


@query(f"WITH {VECTORS} SELECT CAST(k.k AS BIGINT) AS i1, i2, {R('sum(v * cos(pi() * k.k * (2 * i1 + 1) / 128))', 5)} AS v FROM g, range(64) AS k(k) GROUP BY 1, 2")
def cosft(spark, sf):
    return rounded(T.cosft(vectors(spark, sf)).df, 5)


@query(f"WITH {VECTORS} SELECT i1, i2, {R('v', 5)} AS v FROM g")
def dwt_round_trip(spark, sf):
    return rounded(T.dwt(T.dwt(vectors(spark, sf)), inverse=True).df, 5)


@query(f"""WITH RECURSIVE {_BANDPASS} SELECT i1, i2, {R("v", 5)} AS v FROM d""")
def bandpass(spark, sf):
    return rounded(T.bandpass(vectors(spark, sf).put(d1=0.004), 10.0, 60.0).df, 5)


@query(f"""WITH {_spectral("CASE WHEN k / 0.256 < 5 OR k / 0.256 > 80 THEN 0.0 WHEN k / 0.256 < 10 THEN (k / 0.256 - 5) / 5 WHEN k / 0.256 <= 60 THEN 1.0 ELSE (80 - k / 0.256) / 20 END AS re, 0.0 AS im", 64)} SELECT i1, i2, {R("f", 5)} AS v FROM f""")
def trapez(spark, sf):
    return rounded(T.trapezoid(vectors(spark, sf).put(d1=0.004), (5.0, 10.0, 60.0, 80.0)).df, 5)


@query(f"""WITH {_HILBERT} SELECT i1, i2, {R("sqrt(v * v + f * f)", 5)} AS v FROM f""")
def envelope(spark, sf):
    return rounded(T.envelope(vectors(spark, sf)).df, 5)


@query(f"""WITH {_HILBERT} SELECT i1, i2, {R("f", 5)} AS v FROM f""")
def phase_rotation(spark, sf):
    return rounded(T.envelope(vectors(spark, sf), phase=90.0).df, 5)


@query(f"""WITH {_spectral("pow(k / 12.8, 2) * exp(1 - pow(k / 12.8, 2)) AS re, 0.0 AS im", 128)} SELECT i1, i2, {R("f", 5)} AS v FROM f""")
def ricker1(spark, sf):
    return rounded(T.ricker(vectors(spark, sf).put(d1=0.004), 25.0).df, 5)


@query(f"""WITH {_spectral(f"cos({_HALF_PHASE}) / {_HALF_SIZE} AS re, -sin({_HALF_PHASE}) / {_HALF_SIZE} AS im", 128)} SELECT i1, i2, {R("f", 5)} AS v FROM f""")
def halfint(spark, sf):
    return rounded(T.half_integral(vectors(spark, sf)).df, 5)


@query(f"WITH {VECTORS} SELECT i1 * 2 AS i1, i2, {R('v', 5)} AS v FROM g")
def spline_at_knots(spark, sf):
    """Twice as fine a spline, seen at its knots."""
    out = T.spline(vectors(spark, sf), Axis(127, 0.0, 0.5))
    return rounded(out.df.where("i1 % 2 = 0"), 5)


@query(_SPLINE)
def spline(spark, sf):
    return rounded(T.spline(vectors(spark, sf), Axis(200, -1.0, 0.35)).df, 5)


@query(_burg(4))
def burg(spark, sf):
    return rounded(T.prediction_filter(vectors(spark, sf), 4).df, 5)


@query(f"WITH {VECTORS}, s AS (SELECT i2, sum(v) AS s FROM g GROUP BY 1) SELECT i2, {R('s', 5)} AS v FROM s")
def smoothreg_mass(spark, sf):
    """Smoothing by regularisation keeps each line's sum."""
    out = T.implicit_smooth(vectors(spark, sf), 4.0)
    return rounded(out.df.groupBy("i2").agg(F.sum("v").alias("v")), 5)


@query(f"""WITH RECURSIVE {VECTORS}, {_impulse("h", ("1.0", "0.0", "0.0"), ("-0.5", "0.2"))}, {_convolved("y", "g", "h")} SELECT i1, i2, {R("v", 5)} AS v FROM y""")
def recfilt(spark, sf):
    return rounded(T.recursive_filter(vectors(spark, sf), [-0.5, 0.2]).df, 5)


def _velocity(spark):
    return G.layered(spark, Header((Axis(60, 0.0, 10.0), Axis(40, 0.0, 10.0))), [(300.0, 0.1)], [(1500.0, 0.0, 0.0), (2500.0, 0.0, 0.0)])


@query(f"""WITH RECURSIVE {panels_sql(64)}, f AS (SELECT a.i AS i1, b.i AS i2, u.i3 FROM range(64) AS a(i), range(64) AS b(i), (SELECT DISTINCT i3 FROM g) u), u AS (SELECT 0 AS s, i1, i2, i3, coalesce(v, 0.0) AS v FROM f LEFT JOIN g USING (i1, i2, i3) UNION ALL
SELECT s + 1, i1, i2, i3, v + 0.2 * (coalesce(lag(v) OVER (PARTITION BY i2, i3 ORDER BY i1) - v, 0) + coalesce(lead(v) OVER (PARTITION BY i2, i3 ORDER BY i1) - v, 0) + coalesce(lag(v) OVER (PARTITION BY i1, i3 ORDER BY i2) - v, 0) + coalesce(lead(v) OVER (PARTITION BY i1, i3 ORDER BY i2) - v, 0)) FROM u WHERE s < 5)
SELECT i1, i2, i3, {R("v", 5)} AS v FROM u WHERE s = 5""")
def heat(spark, sf):
    return rounded(P.heat(panels(spark, sf, 64), 5, 0.2).df, 5)


@query(_diffusion(5))
def diffusion(spark, sf):
    return rounded(P.diffuse(panels(spark, sf, 64), 5).df, 5)


@query(_EIKONAL)
def eikonal(spark, sf):
    return rounded(P.travel_times(_velocity(spark), (3, 20)).df, 5)


@query(f"""WITH RECURSIVE u AS (SELECT 0 AS s, a.i AS i1, b.i AS i2, CASE WHEN a.i >= floor(0.5 + (300 + b.i) / 10.0) THEN 2.5 * 2.5 ELSE 1.5 * 1.5 END::DOUBLE AS c2, 0.0::DOUBLE AS before, 0.0::DOUBLE AS now FROM range(60) AS a(i), range(40) AS b(i) UNION ALL
SELECT s + 1, i1, i2, c2, now, 2 * now - before + c2 * (coalesce(lag(now) OVER x, 0) + coalesce(lead(now) OVER x, 0) + coalesce(lag(now) OVER y, 0) + coalesce(lead(now) OVER y, 0) - 4 * now) / 100
+ CASE WHEN i1 = 5 AND i2 = 20 THEN (1 - 2 * pow(pi() * 15 * (s * 0.001 - 0.06), 2)) * exp(-pow(pi() * 15 * (s * 0.001 - 0.06), 2)) * 1e-6 ELSE 0.0 END FROM u WHERE s < 150 WINDOW x AS (PARTITION BY i2 ORDER BY i1), y AS (PARTITION BY i1 ORDER BY i2))
SELECT i1, i2, {R("now", 9)} AS v FROM u WHERE s = 150""")
def wave2d(spark, sf):
    import math

    pulse = [(1 - 2 * (math.pi * 15 * (k * 0.001 - 0.06)) ** 2) * math.exp(-((math.pi * 15 * (k * 0.001 - 0.06)) ** 2)) for k in range(150)]
    return rounded(P.acoustic_wave(_velocity(spark), (5, 20), pulse, 0.001).df, 9)


@query()
def lapfill(spark, sf):
    g = panels(spark, sf, 64)
    return rounded(P.fill_missing(g.with_v(F.when((F.col("i1") + F.col("i2")) % 3 == 0, F.lit(0.0)).otherwise(F.col("v")))).df, 5)


@query(f"""WITH {_DIPFILTER} SELECT i1, i2, i3, {R("re", 5)} AS v FROM e""")
def dipfilter(spark, sf):
    return rounded(P.dip_filter(panels(spark, sf, 64), -0.5, 0.5).df, 5)


@query(f"""WITH {_SPECTRA2} SELECT i1, (i2 + 32) % 64 AS i2, i3, {R("sqrt(re * re + im * im) / 64", 5)} AS v FROM b""")
def spectra2(spark, sf):
    return rounded(P.spectra2(panels(spark, sf, 64)).df, 5)


@query(_canny())
def canny(spark, sf):
    return P.canny(panels(spark, sf, 64)).df


@query(_COMPONENTS)
def label_components(spark, sf):
    g = panels(spark, sf, 64)
    return P.components(g.with_v((F.col("v") > 0.1).cast("double"))).df


@query(f"""WITH {panels_sql(64)}, {filled_sql(64, 64)}, d AS (SELECT i1, i2, i3, {_central(1)} AS d1, {_central(2)} AS d2 FROM f), p AS (SELECT i1, i2, i3, d1 * d1 AS a, d1 * d2 AS b FROM d), {_smoothed_panel(["a", "b"])}
SELECT i1, i2, i3, {R("-b / CASE WHEN a > 1e-12 THEN a ELSE 1.0 END", 5)} AS v FROM t2""")
def dip(spark, sf):
    return rounded(P.local_slope(panels(spark, sf, 64)).df, 5)


@query(f"WITH {VECTORS} SELECT {R('sum(v * v)', 4)} AS v FROM g")
def svd_energy(spark, sf):
    """Squared singular values add up to the energy of all panels."""
    return rounded(P.singular_values(panels(spark, sf, 64)).df.agg(F.sum(F.col("v") * F.col("v")).alias("v")), 4)


@query(f"WITH {VECTORS}, w AS (SELECT i1 % 4 AS i1, i2 * 16 + i1 // 4 AS i2, v + 1.0 AS d FROM g) SELECT i1, i2, {R('d - coalesce(lag(d) OVER (PARTITION BY i2 ORDER BY i1), 0)', 4)} AS v FROM w")
def conjgrad(spark, sf):
    """Undo a causal integration of short lines by conjugate gradients."""
    short = vectors(spark, sf).df.select(F.expr("i1 % 4").alias("i1"), F.expr("i2 * 16 + i1 div 4").alias("i2"), (F.col("v") + 1.0).alias("v"))
    data = Grid(short, Header((Axis(4), Axis())))
    start = data.with_v(F.lit(0.0))
    return rounded(inverse.conjugate_gradients(inverse.causal_integration, data, start, 5).df, 4)


@query("SELECT * FROM (VALUES ('causint', true), ('gradient', true), ('convolution', true)) AS t(operator, adjoint)")
def dottest(spark, sf):
    """<L m, d> = <m, L' d> for operators with adjoints."""
    g = vectors(spark, sf)
    ops = {"causint": inverse.causal_integration, "gradient": inverse.gradient, "convolution": inverse.convolution([1.0, -0.5, 0.25])}
    rows = []
    for name, op in ops.items():
        a, b = inverse.dot_test(op, g, g)
        rows.append((name, abs(a - b) <= 1e-9 * max(abs(a), abs(b), 1.0)))
    return spark.createDataFrame(rows, "operator string, adjoint boolean")
