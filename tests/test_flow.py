import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.test_grid import dense, grid

from hyperstrata.functions.expr import parse
from hyperstrata.plans import datasets
from hyperstrata.plans.flow import PROGRAMS, flow

RNG = np.random.default_rng(7)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2+3*4", 14), ("-2^2", -4), ("2^3^2", 512), ("2**-1", 0.5), ("(1+2)*-3", -9), ("10/4/5", 0.5), ("1e3 - .5", 999.5),
        ("sqrt(a^2+b^2)", 5), ("exp(log(a))", 3), ("sin(pi/2)", 1), ("erf(0.5)", math.erf(0.5)), ("erf(-3.2)", math.erf(-3.2)), ("erfc(2.6)", math.erfc(2.6)), ("abs(-a)", 3), ("sign(0-b)", -1),
    ],
)
def test_expressions(spark, text, want):
    df = spark.createDataFrame([(3.0, 4.0)], "a double, b double")
    assert df.select(parse(text, {"a": F.col("a"), "b": F.col("b")})).first()[0] == pytest.approx(want, rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("text", ["1 +", "(1", "foo(1)", "1 2", "a $ b", ""])
def test_bad_expressions(text):
    with pytest.raises(ValueError, match="."):
        parse(text, {"a": F.lit(1)})


def test_flows_are_lazy_chains(spark):
    a = RNG.normal(size=(4, 16))
    g = grid(spark, a, axis1=(0.0, 0.004))
    got = flow("sfwindow f1=2 n1=8 | add with=b scale=1,2 | stack axis=2 norm=n", {"input": g, "b": grid(spark, np.ones((4, 8)), axis1=(0.008, 0.004))})
    assert np.allclose(dense(got), (a[:, 2:10] + 2).sum(0))
    assert np.allclose(dense(flow("fft1 | fft1 inv=y", {"input": g})), a)
    assert np.allclose(dense(flow("fft3 axis=1 | fft3 axis=1 inv=y | real", {"input": g})), a)
    assert np.allclose(dense(flow("transp | cosft sign2=1 | cosft sign2=-1 | transp", {"input": g})), a)
    assert np.allclose(dense(flow("spray axis=3 n=2 | window f3=1 n3=1 | rotate rot1=3", {"input": g}))[0], np.roll(a, 3, 1))
    with pytest.raises(ValueError, match="unknown program"):
        flow("nonsense x=1", {"input": g})
    assert len(PROGRAMS) > 70


def test_every_simple_program_runs(spark):
    g = grid(spark, RNG.normal(size=(8, 16)) + 3, axis1=(0.0, 0.004))
    for text in [
        "scale axis=1", "semblance axis=2", "median axis=1", "pad beg1=1 end2=2 n1=0", "cat with=b axis=2", "interleave with=b axis=1", "dd type=int", "clip2 lower=2 upper=4", "tclip lowercut=2 uppercut=4",
        "threshold pclip=50", "mask min=2 max=4", "pow pow1=2", "costaper nw1=2 nw2=1", "igrad", "deriv", "boxsmooth rect1=3", "smooth rect1=3 rect2=2", "mf nfw=3", "mean nfw=3 how=mean boundary=y", "despike wide=3", "listminmax",
        "laplac", "grad2", "agc rect1=3", "ai2refl | refl2ai a0=2", "equal", "spectra all=y", "spectra2", "bandpass flo=10 fhi=80", "trapez frequency=5,10,60,80", "envelope", "ricker1 frequency=30", "halfint", "dwt", "burg na=2",
        "smoothreg eps=2", "recfilt a=-0.5", "spline n1=30 d1=0.002", "remap1 n1=30 d1=0.002", "nmo v0=2000", "inmo v0=2000", "logstretch o1=-5 d1=0.1 n1=10", "slant np=3 p0=0 dp=0.001", "vscan nv=3 v0=1500 dv=200 semblance=y",
        "autocorr n=4", "conv filt=1,-0.5", "rtoc | cabs", "cmplx with=b | arg", "heat nt=2", "expl2 cycle=2", "canny", "label", "dip rect1=2", "noise var=0.1", "mutter v0=2000", "div with=b mode=d", "cut f1=2 n1=3",
    ]:
        assert flow(text, {"input": g, "b": g}).df.count() > 0, text


def test_datasets(spark, tmp_path):
    a = RNG.normal(size=(3, 5))
    folder = str(tmp_path / "a")
    datasets.save(grid(spark, a, axis2=(1.0, 2.0)), folder)
    datasets.copy(spark, folder, str(tmp_path / "b"))
    assert datasets.put(str(tmp_path / "b"), o2=7.0, title="t").get("o2") == 7.0
    back = datasets.load(spark, str(tmp_path / "b"))
    assert np.allclose(dense(back), a) and back.axis(2).o == 7.0 and back.header.get("title") == "t"
    assert "15 elements" in datasets.describe(back)
    datasets.remove(folder)
    assert not (tmp_path / "a").exists()
