import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis, Header, parse_list, parse_parameters
from hyperstrata.operators import bin as B
from hyperstrata.operators import frame, generate, inverse, panel, rank, reduce, resample, select, shape, traces
from hyperstrata.operators.grid import Grid, combine, from_traces
from hyperstrata.sources import native, segy, tables


def grid(spark, array, **axes):
    """A dense array (last axis first) as a grid."""
    array = np.asarray(array, "f8")
    rows = [(*[int(i) for i in reversed(at)], float(v)) for at, v in np.ndenumerate(array)]
    names = [f"i{k + 1}" for k in range(array.ndim)]
    header = Header(tuple(Axis(n, *axes.get(f"axis{k}", (0.0, 1.0))) for k, n in enumerate(reversed(array.shape), 1)))
    return Grid(spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names) + ", v double"), header)


def dense(g, shape=None):
    rows = g.df.select(*g.indices, "v").collect()
    shape = shape or tuple(max(r[k] for r in rows) + 1 for k in range(g.dims))
    out = np.zeros(tuple(reversed(shape)))
    for r in rows:
        out[tuple(reversed(r[: g.dims]))] = r["v"]
    return out


RNG = np.random.default_rng(1)


def test_parameters_and_headers():
    assert parse_parameters('a=5 b=as a=100 label1="Time (s)" noise') == {"a": "100", "b": "as", "label1": "Time (s)"}
    assert parse_list("1,2x4.0,2.25") == [1, 4, 4, 2.25]
    assert parse_list("2*no".replace("*", "x"), bool) == [False, False]
    h = Header((Axis(10), Axis(3, 1.0, 0.5))).put(o1=2.0, n3=4, title="x")
    assert h.get("o1") == 2.0 and h.get("n3") == 4 and h.get("title") == "x" and h.axis(2).coordinate(2) == 2.0
    with pytest.raises(ValueError):
        Header(tuple(Axis(1) for _ in range(10)))
    with pytest.raises(ValueError):
        h.check_like(Header((Axis(10), Axis(4, 1.0, 0.5), Axis(4))))


def test_scalar_api(spark):
    """Arithmetic of grids of ones and spikes."""
    one = generate.spike(spark, Header((Axis(10),)))
    two = one + one
    assert one.mean() == 1 and two.rms() == 2 and (two * two + one).max() == 5
    assert one.dot(two) == 20
    s = generate.spike(spark, Header((Axis(5), Axis(5))), [{"k": {1: 3}}])
    a = dense(s)
    assert a[0][0] == 0 and a[1][2] == 1 and a[:3].mean() == pytest.approx(0.2)


def test_window_cut_and_bad_windows(spark):
    a = RNG.normal(size=(4, 12))
    g = grid(spark, a, axis1=(1.0, 0.5))
    assert np.allclose(dense(select.window(g, axis1={"start": 2.0, "end": 5.0}, axis2={"f": 1, "n": 2})), a[1:3, 2:9])
    w = select.window(g, axis1={"f": 1, "j": 3})
    assert np.allclose(dense(w), a[:, 1::3]) and w.axis(1).o == 1.5 and w.axis(1).d == 1.5
    assert np.allclose(dense(select.window(g, axis1={"f": -2})), a[:, -2:])
    with pytest.raises(ValueError):
        select.window(g, axis1={"f": 8, "n": 9})
    b = a.copy()
    b[1:3, 2:6] = 0
    assert np.allclose(dense(select.cut(g, axis1={"f": 2, "n": 4}, axis2={"f": 1, "n": 2})), b)
    assert [x.n for x in select.squeeze(select.window(g, axis1={"f": 3, "n": 1})).header.axes] == [4, 1]


def test_masks_and_clips(spark):
    df = spark.createDataFrame([(1.0,), (-3.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (2.0,), (None,)], "v double")
    got = df.select(select.mask(F.col("v"), 1, 2).alias("m"), select.clip(F.col("v"), 2.0).alias("c")).collect()
    assert [r["m"] for r in got] == [1, 0, 0, 0, 0, 1, 0]
    assert [r["c"] for r in got][:6] == [1, -2, -2, 2, -2, 2]
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    points = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (3.9, 3.9), (-1.0, 2.0)], "x double, y double")
    assert [r[0] for r in points.select(select.polygon_mask(F.col("x"), F.col("y"), square)).collect()] == [1, 0, 1, 0]


def test_shapes(spark):
    a = RNG.normal(size=(3, 4))
    g = grid(spark, a)
    assert np.allclose(dense(shape.transp(g)), a.T)
    assert np.allclose(dense(shape.rotate(g, {1: 1, 2: -1})), np.roll(np.roll(a, 1, 1), -1, 0))
    r = shape.reverse(g, [1])
    assert np.allclose(dense(r), a[:, ::-1]) and r.axis(1).o == 3 and r.axis(1).d == -1
    assert np.allclose(dense(shape.pad(g, begin={1: 1}, end={2: 2})), np.pad(a, ((0, 2), (1, 0))))
    assert shape.pad(g, to={1: 0, 2: 0}).header.axis(2).n == 4
    assert np.allclose(dense(shape.cat([g, g], 2)), np.vstack([a, a]))
    assert np.allclose(dense(shape.reshape(g, [6, 2])), a.reshape(2, 6))
    with pytest.raises(ValueError):
        shape.reshape(g, [5, 2])
    s = shape.spray(g, 1, 3)
    assert dense(s).shape == (3, 4, 3)
    assert np.allclose(dense(reduce.stack(s, 1, "mean")), a)


def test_combine_guards_division(spark):
    a, b = np.array([[1.0, 2.0, 3.0]]), np.array([[2.0, 0.0, 4.0]])
    assert np.allclose(dense(combine([grid(spark, a), grid(spark, b)], "div")), [[0.5, 0, 0.75]])


def test_reductions_skip_zeros(spark):
    a = np.array([[1.0, 0.0], [3.0, 0.0], [0.0, 5.0]])
    g = grid(spark, a)
    assert dense(reduce.stack(g, 2, "mean")).tolist() == [2, 5]
    assert dense(reduce.fold(g, 2)).tolist() == [2, 1]
    assert dense(reduce.semblance(g, 2)).tolist() == [pytest.approx(16 / 20), 1]
    assert dense(reduce.median(grid(spark, [[1.0], [3.0], [4.0], [5.0], [2.0]]), 2)).tolist() == [3]
    zero = reduce.semblance(grid(spark, np.zeros((3, 2))), 2)
    assert dense(zero).tolist() == [0, 0]


@pytest.mark.parametrize("rect", [1, 2, 3, 5, 9])
def test_triangle_smoothing(spark, rect):
    a = RNG.normal(size=(2, 7))
    mirrored = np.concatenate([a[:, ::-1], a, a[:, ::-1]] * 3, 1)
    weights = np.array([(rect - abs(k)) / rect**2 for k in range(1 - rect, rect)])
    # reflections of reflections: a period of twice the length
    period = np.concatenate([a, a[:, ::-1]], 1)
    want = np.array([[sum(w * line[(i + k) % 14] for w, k in zip(weights, range(1 - rect, rect))) for i in range(7)] for line in period])
    assert mirrored is not None
    assert np.allclose(dense(frame.triangle(grid(spark, a), rect)), want)


def test_frames(spark):
    a = RNG.normal(size=(2, 9))
    g = grid(spark, a)
    assert np.allclose(dense(frame.causint(g)), a.cumsum(1))
    assert np.allclose(dense(frame.boxsmooth(g, 3)), [np.convolve(x, np.ones(3) / 3)[:9] for x in a])
    edge = np.pad(a, ((0, 0), (2, 2)), mode="edge")
    assert np.allclose(dense(frame.moving(g, 5, "median", boundary="edge")), [[np.median(x[i : i + 5]) for i in range(9)] for x in edge])
    r = frame.reflectivity(g.with_v(F.abs("v") + 1))
    back = frame.impedance(r, float(abs(a[0, 0]) + 1))
    assert np.allclose(dense(back)[0], np.abs(a[0]) + 1)
    assert np.allclose(dense(frame.laplacian(grid(spark, np.ones((3, 4))))), 0)
    assert np.allclose(dense(frame.shift(g, -2)), np.pad(a[:, 2:], ((0, 0), (0, 2))))


@pytest.mark.parametrize("op", [inverse.causal_integration, inverse.gradient, inverse.convolution([1.0, -0.5, 0.25]), inverse.causal_integration @ inverse.gradient])
def test_adjoints(spark, op):
    g = grid(spark, np.zeros((3, 8)))
    a, b = inverse.dot_test(op, g, g)
    assert a == pytest.approx(b, rel=1e-9)


def test_conjugate_gradients_invert(spark):
    m = RNG.normal(size=(2, 5))
    op = inverse.causal_integration
    data = op.forward(grid(spark, m))
    got = inverse.conjugate_gradients(op, data, grid(spark, np.zeros((2, 5))), 6)
    assert np.allclose(dense(got), m, atol=1e-6)


def test_ranks_and_order_statistics(spark):
    values = [round(float(x), 2) for x in RNG.normal(size=500)] + [0.5] * 300
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, v double")
    ranked = {r["id"]: r["n"] for r in rank.global_rank(df, ["v", "id"], "n").collect()}
    assert [ranked[k] for k, _ in sorted(enumerate(values), key=lambda x: (x[1], x[0]))] == list(range(800))
    down = {r["id"]: r["n"] for r in rank.global_rank(df, ["v", "id"], "n", descending=True).collect()}
    assert [down[k] for k, _ in sorted(enumerate(values), key=lambda x: (-x[1], x[0]))] == list(range(800))
    ordered = sorted(values)
    for k in (0, 1, 399, 600, 799):
        assert rank.kth_smallest(df, "v", k, most=10) == ordered[k]
    five = spark.createDataFrame([(float(x),) for x in (1, 3, 4, 5, 2)], "v double")
    assert [rank.kth_smallest(five, "v", k) for k in range(5)] == [1, 2, 3, 4, 5]
    assert rank.global_rank(df.limit(0), ["v"], "n").count() == 0


def test_peaks(spark):
    x = np.arange(50) * 0.1
    g = grid(spark, [np.exp(-((x - 1.23) ** 2)) + 2 * np.exp(-4 * (x - 3.41) ** 2)], axis1=(0.0, 0.1))
    got = rank.local_maxima(g, 2).orderBy("rank").collect()
    assert got[0]["x"] == pytest.approx(3.41, abs=0.01) and got[1]["x"] == pytest.approx(1.23, abs=0.01)


def test_bins(spark):
    x, v = RNG.uniform(-1, 11, 300), RNG.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, v)], "x double, v double")
    cells = np.floor(0.5 + x).astype(int)
    want = [v[cells == k].mean() if (cells == k).any() else 0 for k in range(10)]
    assert np.allclose(dense(B.bin1(df, F.col("x"), F.col("v"), Axis(10))), want)
    h = {r["bin"]: r["n"] for r in B.histogram(df, F.col("x"), 0.0, 2.0, 5).collect()}
    assert h == {k: int(((x >= 2 * k) & (x < 2 * k + 2)).sum()) for k in range(5)}


def test_interpolation(spark):
    knots = spark.createDataFrame([("a", float(k), float(k * k)) for k in (1, 2, 4)] + [("b", 3.0, 7.0)], "key string, x double, v double")
    got = {(r["key"], r["i1"]): r["v"] for r in resample.linear(knots, ["key"], "x", "v", Axis(12, 0.0, 0.5)).collect()}
    want = np.interp(np.arange(12) * 0.5, [1, 2, 4], [1, 4, 16])
    assert [got["a", k] for k in range(12)] == pytest.approx(list(want)) and {got["b", k] for k in range(12)} == {7.0}
    a = RNG.normal(size=(2, 16))
    g = grid(spark, a, axis1=(0.0, 0.1))
    flat = resample.nmo(g, F.lit(0.0), 2.0)
    assert np.allclose(dense(flat), a)


def test_trace_kernels(spark):
    a = RNG.normal(size=(3, 30))
    g = grid(spark, a, axis1=(0.0, 0.004))
    assert np.allclose(dense(traces.ifft1(traces.fft1(g))), a)
    assert np.allclose(dense(traces.cosft(traces.cosft(g), inverse=True)), a)
    assert np.allclose(dense(traces.dwt(traces.dwt(g), inverse=True), (32, 3))[:, :30], a)
    t = np.arange(400) * 0.004
    tone = grid(spark, [np.sin(2 * np.pi * 30 * t), np.sin(2 * np.pi * 3 * t)], axis1=(0.0, 0.004))
    kept = dense(traces.bandpass(tone, 15.0, 60.0))[:, 100:300]
    assert np.abs(kept[0]).max() == pytest.approx(1, abs=0.1) and np.abs(kept[1]).max() < 0.05
    env = dense(traces.envelope(tone))[0, 100:300]
    assert np.allclose(env, 1, atol=0.05)
    knots = np.linspace(0, 3, 20)
    fine = traces.natural_spline(knots, np.sin(knots), np.linspace(0.5, 2.5, 50))
    assert np.allclose(fine, np.sin(np.linspace(0.5, 2.5, 50)), atol=1e-3)
    roots = traces.polynomial_roots(select.to_complex(grid(spark, [[6.0, -5.0, 1.0]]))).df.orderBy("i1").collect()
    assert [round(r["v"]["re"], 6) for r in roots] == [2, 3]
    x = np.zeros(4000)
    for k in range(1, 4000):
        x[k] = 0.7 * x[k - 1] + RNG.normal()
    assert traces.burg(x, 2)[1:] == pytest.approx([-0.7, 0.0], abs=0.06)


def test_panel_kernels(spark):
    v = grid(spark, np.full((21, 31), 2.0))
    t = dense(panel.travel_times(v, (10, 5)))
    assert t[5, 30] == pytest.approx(10.0) and t[20, 10] == pytest.approx(7.5)
    assert t[15, 20] == pytest.approx(math.hypot(10, 10) / 2, rel=0.1)
    a = np.add.outer(np.arange(8.0), 2 * np.arange(9.0))
    holes = a + 1
    holes[3:5, 4:6] = 0
    assert np.allclose(dense(panel.fill_missing(grid(spark, holes))), a + 1, atol=1e-4)
    lab = dense(panel.components(grid(spark, [[1, 0, 1], [1, 0, 1], [0, 0, 0], [1, 1, 1]])), (3, 4))
    assert lab.max() == 3 and lab[0, 0] == lab[1, 0] != lab[0, 2]
    q = RNG.normal(size=(4, 4))
    eig = dense(panel.eigenvalues(grid(spark, q + q.T)))[0]
    assert np.allclose(sorted(eig), np.linalg.eigvalsh(q + q.T))
    flat = dense(panel.local_slope(grid(spark, np.sin(np.add.outer(0.3 * np.arange(30), 0.6 * np.arange(40)))), rect=4))
    assert np.median(flat[8:-8, 8:-8]) == pytest.approx(-0.5, abs=0.05)


def test_generators(spark):
    g = generate.spike(spark, Header((Axis(100), Axis(100))), [{"k": {1: 1}, "mag": 0.0}])
    n = dense(generate.noise(g, 3, variance=4.0, mean=1.0, replace=True))
    assert n.mean() == pytest.approx(1, abs=0.06) and n.var() == pytest.approx(4, abs=0.2)
    again = dense(generate.noise(g, 3, variance=4.0, mean=1.0, replace=True))
    assert (n == again).all()
    u = dense(generate.noise(g, 3, variance=3.0, uniform=True, replace=True))
    assert np.abs(u).max() <= 3 and u.var() == pytest.approx(3, abs=0.15)
    m = dense(generate.mandelbrot(spark, Header((Axis(3, -2.0, 1.0), Axis(1, 0.0, 1.0))), 20))
    assert m.ravel().tolist() == [20, 20, 20]


@pytest.mark.parametrize("form", ["native_float", "xdr_float", "native_int", "native_double"])
def test_native_files(spark, tmp_path, monkeypatch, form):
    monkeypatch.setattr(native, "BLOCK", 24)
    a = RNG.integers(-50, 50, size=(4, 3, 7)).astype("f8")
    path = str(tmp_path / "d.h")
    native.write(grid(spark, a, axis2=(1.0, 0.25)), path, form)
    back = native.read(spark, path)
    assert np.allclose(dense(back), a) and back.axis(2).d == 0.25


def test_text_files(spark, tmp_path):
    (tmp_path / "d.txt").write_text("1 2 3\n4 5 6\n")
    (tmp_path / "d.h").write_text(f'n1=3 n2=2 o1=1 d1=0.5 label1="Time" data_format=ascii_float in="{tmp_path}/d.txt"')
    g = native.read(spark, str(tmp_path / "d.h"))
    assert dense(g).tolist() == [[1, 2, 3], [4, 5, 6]] and g.axis(1).label == "Time"
    (tmp_path / "t.csv").write_text("1,,3\n4,x\n\n7,8,9,10\n")
    assert dense(tables.read_csv(spark, str(tmp_path / "t.csv"), 3)).tolist() == [[1, 0, 3], [4, 0, 0], [7, 8, 9]]


@pytest.mark.parametrize("form", [1, 2, 3, 5])
def test_segy_files(spark, tmp_path, form):
    a = RNG.integers(-99, 99, size=(9, 11)).astype("f8")
    df = spark.createDataFrame([(k, 100 + k, 10 * k, x.tolist()) for k, x in enumerate(a)], "i2 long, iline int, offset int, trace array<double>")
    path = str(tmp_path / "d.sgy")
    assert segy.write(df, path, 0.002, 11, form, "C 1 TEST") == 9
    info = segy.layout(path)
    assert info["traces"] == 9 and info["dt"] == pytest.approx(0.002) and info["text"].startswith("C 1 TEST")
    back = segy.read(spark, path).orderBy("i2").collect()
    assert np.allclose([r["trace"] for r in back], a) and [r["iline"] for r in back] == list(range(100, 109)) and back[3]["offset"] == 30 and back[0]["ns"] == 11
    heads = segy.read(spark, path, "head")
    assert "trace" not in heads.columns and heads.count() == 9


def test_ibm_floats():
    x = np.array([0.0, 1.0, -118.625, 1e-3, 3.14159e7])
    back = segy.ibm_to_float(segy.float_to_ibm(x).astype("u4"))
    assert np.allclose(back, x, rtol=1e-6)
    assert segy.float_to_ibm(np.array([-118.625]))[0] == 0xC276A000


def test_round_trip_of_traces(spark):
    a = RNG.normal(size=(3, 5))
    g = grid(spark, a)
    assert np.allclose(dense(from_traces(g.to_traces(), g.header)), a)


def test_order_statistics_of_odd_values(spark):
    """NaN and null do not count, nothing is NaN, ties, infinities and tiny ranges are told apart."""
    from hyperstrata.operators.rank import kth_smallest

    def kth(values, k):
        return kth_smallest(spark.createDataFrame([(v,) for v in values], "x double"), "x", k)

    nan, inf = float("nan"), float("inf")
    assert [kth([3.0, nan, 1.0, None, 2.0], k) for k in range(3)] == [1.0, 2.0, 3.0]
    assert math.isnan(kth([], 0)) and math.isnan(kth([nan, None], 0))
    assert kth([5.0, 5.0, 5.0], 2) == 5.0 and kth([1.0, 2.0], 9) == 2.0
    assert [kth([-inf, 0.0, inf], k) for k in range(3)] == [-inf, 0.0, inf]
    assert [kth([0.0, 5e-324, 1e-323], k) for k in range(3)] == [0.0, 5e-324, 1e-323]
    values = [float(x) for x in RNG.normal(size=500)]
    assert [kth(values, k) for k in (0, 250, 499)] == [sorted(values)[k] for k in (0, 250, 499)]


def test_native_write_counts_samples(spark, tmp_path):
    g = grid(spark, [[1.0, 2.0], [3.0, 4.0]])
    with pytest.raises(Exception, match="missing"):
        native.write(Grid(g.df.where("not (i1 = 1 and i2 = 0)"), g.header), str(tmp_path / "a.h"))
    with pytest.raises(Exception, match="missing"):
        native.write(Grid(g.df.where("i2 = 0").union(g.df.where("i2 = 0")), g.header), str(tmp_path / "b.h"))


def test_covariance_against_numpy(spark):
    from hyperstrata.operators import algebra

    x = RNG.normal(size=(7, 5))
    got = {(r["row"], r["col"]): r["a"] for r in algebra.covariance(grid(spark, x)).collect()}
    assert np.allclose([[got[i, j] for j in range(5)] for i in range(5)], x.T @ x / 7)
    one = {(r["row"], r["col"]): r["a"] for r in algebra.covariance(grid(spark, x[0])).collect()}
    assert np.allclose([[one[i, j] for j in range(5)] for i in range(5)], np.outer(x[0], x[0]))


def test_sobel3_is_zero_on_the_border_and_exact_on_a_ramp(spark):
    u = np.add.outer(np.add.outer(5.0 * np.arange(4), 3.0 * np.arange(4)), 2.0 * np.arange(4))
    for axis, slope in ((1, 2.0), (2, 3.0), (3, 5.0)):
        g = dense(frame.sobel3(grid(spark, u), axis))
        assert np.allclose(g[1:-1, 1:-1, 1:-1], 2 * slope * (4 * 5 + 4)) and not g[0].any() and not g[:, :, -1].any()
