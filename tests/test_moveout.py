"""Edge cases of moveout, interpolation filters, helices, solvers and user functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperstrata.functions import extend, solve
from hyperstrata.functions.header import Axis, Header
from hyperstrata.operators import algebra, figures, frame, helix, interpolate, inverse, moveout, panel, traces
from hyperstrata.operators.grid import Grid, from_traces


def grid(spark, a):
    a = np.asarray(a, "f8")
    rows = [(*map(int, reversed(i)), float(x)) for i, x in np.ndenumerate(a)]
    kinds = ", ".join(f"i{k} long" for k in range(1, a.ndim + 1)) + ", v double"
    return Grid(spark.createDataFrame(rows, kinds), Header(tuple(Axis(n) for n in reversed(a.shape))))


def dense(g, shape):
    out = np.full(shape, np.nan)
    for r in g.df.collect():
        out[tuple(r[f"i{k}"] for k in range(len(shape), 0, -1))] = r["v"]
    return out


def test_moved_nowhere_is_zero(spark):
    g = grid(spark, [[1.0, 2.0, 3.0]])
    assert (dense(moveout.moved(g, F.lit(None).cast("double")), (1, 3)) == 0).all()
    assert (dense(moveout.moved(g, F.lit(None).cast("double"), inverse=True), (1, 3)) == 0).all()
    assert dense(moveout.moved(g, g.x(1) + 1), (1, 3)).tolist() == [[2.0, 3.0, 0.0]]
    assert dense(moveout.moved(g, g.x(1) + 1, inverse=True), (1, 3)).tolist() == [[0.0, 1.0, 2.0]]


def test_smooth_derivative_against_dense_system(spark):
    rng, n = np.random.default_rng(1), 9
    a = rng.normal(size=(3, n))
    second = np.zeros((n - 2, n))
    for i in range(n - 2):
        second[i, i : i + 3] = 1, -2, 1
    y = np.linalg.solve(np.eye(n) + 0.3 * second.T @ second, a.T).T
    want = np.diff(y, axis=1)
    want = np.hstack([want, want[:, -1:]])
    assert np.allclose(dense(traces.smooth_derivative(grid(spark, a), 0.3), a.shape), want)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16])
def test_lifting_round_trip_of_any_length(n):
    x = np.random.default_rng(n).normal(size=n)
    assert np.allclose(traces.lifted(traces.lifted(x), inverse=True)[:n], x)


def test_blocks_of_ragged_lines(spark):
    """A block kernel sees lines of one length at a time; order and keys are kept."""
    lines = [[1.0, 2.0, 3.0], [4.0], [5.0, 6.0, 7.0], [], None, [8.0, 9.0]]
    df = spark.createDataFrame(list(enumerate(lines)), "i2 long, trace array<double>").coalesce(1)
    out = traces.apply(from_traces(df, Header((Axis(), Axis()))), lambda x: x[:, ::-1], block=True)
    got = {r["i2"]: r["trace"] for r in out.to_traces().collect()}
    assert got == {k: x[::-1] for k, x in enumerate(lines) if x}
    long = {(r["i2"], r["i1"]): r["v"] for r in out.df.collect()}
    assert long == {(k, i): v for k, x in got.items() for i, v in enumerate(x)}


def test_arrays_do_not_outlive_their_frame(spark):
    g = from_traces(spark.createDataFrame([(0, [1.0, 2.0])], "i2 long, trace array<double>"), Header((Axis(2), Axis(1))))
    assert g.with_v(F.col("v") * 10).to_traces().first()["trace"] == [10.0, 20.0]
    assert g.put(d1=0.5).to_traces().first()["trace"] == [1.0, 2.0]
    assert traces.fft1(grid(spark, [[1.0, 2.0]]).with_v(F.lit(0.0))).df.where("v.re <> 0").count() == 0


def test_helix_of_long_lags_and_empty_grids(spark):
    a = np.random.default_rng(3).normal(size=(4, 5))
    y = dense(helix.convolve(grid(spark, a), [1, 30], [0.5, 9.0]), a.shape).ravel()
    x = a.ravel()
    assert np.allclose(y, x + 0.5 * np.concatenate([[0], x[:-1]]))
    empty = Grid(grid(spark, a).df.where("false"), Header((Axis(5), Axis(4))))
    assert helix.convolve(empty, [1], [0.5]).df.count() == 0


def test_streaming_error_of_silence(spark):
    assert (dense(helix.streaming_error(grid(spark, np.zeros((1, 6))), 3, 0.5), (1, 6)) == 0).all()


def test_filters_find_samples_and_polynomials(spark):
    x = np.arange(8.0)
    g = grid(spark, [x**2])
    points = spark.createDataFrame([(0, 2.0), (0, 3.25), (0, 50.0)], "i2 long, p double")
    got = {r["p"]: r["v"] for r in interpolate.at_points(g, points, "p", "lagrange").collect()}
    assert got[2.0] == pytest.approx(4.0) and got[3.25] == pytest.approx(3.25**2) and got[50.0] == 0.0
    assert dense(interpolate.eno(g, F.col("i1") * 0.5, 15), (1, 15))[0] == pytest.approx((np.arange(15) / 2) ** 2)
    with pytest.raises(ValueError):
        interpolate.weights("none", F.lit(0.5))


def test_smoothing_keeps_constants(spark):
    assert dense(frame.smooth_axes(grid(spark, np.ones((5, 6))), {1: 3, 2: 4}), (5, 6)) == pytest.approx(np.ones((5, 6)))


def test_grid_derivative_of_one_sample(spark):
    assert dense(frame.grid_derivative(grid(spark, [[4.0]])), (1, 1)).tolist() == [[0.0]]
    assert dense(frame.grid_derivative(grid(spark, [[4.0]]), adjoint=True), (1, 1)).tolist() == [[0.0]]


def test_singular_system_and_zero_reference(spark):
    assert (dense(panel.solved(grid(spark, [[1.0, 1.0, 2.0], [1.0, 1.0, 3.0]])), (1, 2)) == 0).all()
    zero = grid(spark, [[0.0, 0.0]])
    assert algebra.relative_error(zero, zero).first()["error"] is None


def test_zeros_and_integration():
    got = solve.zeros(lambda x: x * x - np.array([2.0, 9.0, -1.0]), np.zeros(3), np.full(3, 4.0))
    assert got[:2] == pytest.approx([2**0.5, 3.0]) and np.isnan(got[2])
    assert solve.integrate(lambda y: -y, np.array([1.0, 2.0]), 1.0, 100) == pytest.approx(np.array([1.0, 2.0]) / np.e, abs=1e-6)


def test_weighted_median_and_patches(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (1, 1.0, 1.0), (1, 3.0, 5.0), (1, None, 9.0), (2, 4.0, 0.0), (3, 2.0, 1.0), (3, 2.0, 1.0)], "k int, v double, w double")
    got = {r["k"]: r["m"] for r in df.groupBy("k").agg(extend.weighted_median("v", "w").alias("m")).collect()}
    assert got == {1: 3.0, 2: None, 3: 2.0}
    patches = lambda n: [(r["start"], r["stop"]) for r in extend.Patches(F.lit(n), F.lit(4), F.lit(3)).collect()]
    assert patches(9) == [(0, 4), (3, 7), (5, 9)] and patches(2) == [(0, 2)] and patches(0) == []


def test_contours_of_flat_and_level_panels(spark):
    assert figures.crossings(grid(spark, np.ones((3, 3))), [1.0, 0.5]).count() == 0
    got = figures.crossings(grid(spark, [[0.0, 1.0, 0.0]]), [1.0, 0.25]).collect()
    assert sorted((r["level"], r["y"]) for r in got) == [(0.25, 0.25), (0.25, 1.75), (1.0, 1.0), (1.0, 1.0)]


def test_wiggles_are_clipped(spark):
    rows = figures.wiggles(grid(spark, [[-9.0, 0.5, 9.0]]), 1.0).orderBy("i1").collect()
    assert [(r["x"], r["fill"]) for r in rows] == [(-1.0, 0.0), (0.5, 0.5), (1.0, 1.0)]


def test_conjugate_directions_of_nothing(spark):
    data = grid(spark, np.zeros((1, 4)))
    assert (dense(inverse.conjugate_directions(inverse.causal_integration, data, data, 3), (1, 4)) == 0).all()
