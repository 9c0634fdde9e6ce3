"""Queries whose lines must not pass through the driver, and partial lines and panels."""

import pytest

from hyperstrata.functions.header import Axis, Header
from hyperstrata.operators import frame, helix, resample
from hyperstrata.operators.grid import Grid
from hyperstrata.plans import catalog

#: Nothing of these is broadcast, whatever the size of the tables.
LINES = """
inmo nmo nmo3 nmo3_ort pp2psang logstretch logwarp t2stretch t2warp t2warp_inverse remap1
taupmo_effective txpnmo velmod slant_stack taupmo veltran vscan_semblance
""".split()


@pytest.mark.parametrize("name", LINES)
def test_nothing_is_broadcast(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan.split("== Initial Plan ==")[0]


def test_lines_with_gaps_and_repeats(spark):
    rows = [(0, 0, 1.0), (3, 0, 4.0), (1, 1, 2.0), (1, 1, 3.0), (9, 2, 5.0)] + [(k, 3, float(k)) for k in range(4)]
    g = Grid(spark.createDataFrame(rows, "i1 long, i2 long, v double"), Header((Axis(4), Axis())))
    traces = {r["i2"]: r["trace"] for r in g.dense().collect()}
    assert traces == {0: [1.0, None, None, 4.0], 1: [None, 5.0, None, None], 2: [None] * 4, 3: [0.0, 1.0, 2.0, 3.0]}
    out = resample.remapped(g, resample.F.col("i1") + 0.5, n=4).df
    got = {(r["i1"], r["i2"]): r["v"] for r in out.collect()}
    want = {0: [0.5, 0.0, 2.0, 0.0], 1: [2.5, 2.5, 0.0, 0.0], 2: [0.0] * 4, 3: [0.5, 1.5, 2.5, 0.0]}
    assert got == {(i, k): v for k, line in want.items() for i, v in enumerate(line)}


def _partial(spark):
    """A panel of 4 by 3 whose last line is missing."""
    rows = [(i, k, float(1 + i + 4 * k)) for k in range(2) for i in range(4)]
    return Grid(spark.createDataFrame(rows, "i1 long, i2 long, v double"), Header((Axis(4), Axis(3))))


def _samples(grid):
    return {(r["i1"], r["i2"]): r["v"] for r in grid.df.collect()}


def test_helix_makes_no_samples(spark):
    out = _samples(helix.convolve(_partial(spark), [1, 5], [-0.5, 0.25]))
    line = [0.0] * 5 + [1.0 + k for k in range(8)]
    assert out == {(k % 4, k // 4): line[k + 5] - 0.5 * line[k + 4] + 0.25 * line[k] for k in range(8)}


def test_helix_division_makes_no_samples(spark):
    g = _partial(spark)
    gaps = Grid(g.df.where("i1 <> 2 or i2 <> 0"), g.header)
    for x in (g, gaps):
        out = _samples(helix.divide(helix.convolve(x, [1, 5], [-0.5, 0.25]), [1, 5], [-0.5, 0.25]))
        assert out == pytest.approx(_samples(x))


def test_triangle_of_partial_panels(spark):
    """Mirrored at the end of the axis, not at that of the samples; missing ones count 0."""
    out = _samples(frame.smooth_axes(_partial(spark), {2: 2}))
    assert out == {(i, k): [0.75 * (1 + i) + 0.25 * (5 + i), 0.25 * (1 + i) + 0.5 * (5 + i)][k] for i in range(4) for k in range(2)}
