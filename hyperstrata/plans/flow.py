"""Flows: chains of named programs with ``key=value`` parameters, as lazy transformations.

``flow("window f1=2 n1=10 | stack axis=1 | scale dscale=2", {"input": grid})`` builds one
plan; nothing runs until its rows are asked for. Other grids are given by name. Numbers
1 to 9 at the end of a key name the axis.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from hyperstrata.functions.expr import parse
from hyperstrata.functions.header import Axis, parse_list, parse_parameters
from hyperstrata.operators import algebra, frame, inverse, panel, rank, reduce, resample, select, shape, traces
from hyperstrata.operators import generate as gen
from hyperstrata.operators.grid import Grid, combine

PROGRAMS: dict[str, Callable] = {}


class Parameters(dict):
    """Text parameters with typed look-ups."""

    def real(self, key: str, default=None):
        return float(self[key]) if key in self else default

    def whole(self, key: str, default=None):
        return int(float(self[key])) if key in self else default

    def flag(self, key: str, default=False):
        return self[key][:1].lower() in ("y", "t", "1") if key in self else default

    def reals(self, key: str, default=None):
        return parse_list(self[key]) if key in self else default

    def axes(self, key: str, kind=float) -> dict[int, object]:
        """Values of key1 .. key9 by axis."""
        return {k: kind(float(self[f"{key}{k}"])) for k in range(1, 10) if f"{key}{k}" in self}


def program(*names: str):
    def register(f):
        for n in names:
            PROGRAMS[n] = f
        return f

    return register


def flow(text: str, grids: dict[str, Grid]) -> Grid:
    """Run a chain of programs on the grid named ``input``; other names may be used as parameters."""
    grid = grids.get("input")
    for step in text.split("|"):
        name, _, rest = step.strip().partition(" ")
        name = name.removeprefix("sf")
        if name not in PROGRAMS:
            raise ValueError(f"unknown program {name}")
        grid = PROGRAMS[name](grid, Parameters(parse_parameters(rest)), grids)
    return grid


def _parts(p: Parameters) -> dict:
    spec: dict[int, dict] = {}
    for key, name, kind in (("f", "f", int), ("n", "n", int), ("j", "j", int), ("min", "start", float), ("max", "end", float), ("d", "step", float)):
        for k, v in p.axes(key, kind).items():
            spec.setdefault(k, {})[name] = v
    return {f"axis{k}": v for k, v in spec.items()}


@program("window")
def _window(g, p, _):
    out = select.window(g, **_parts(p))
    return select.squeeze(out) if p.flag("squeeze", True) else out


@program("cut")
def _cut(g, p, _):
    return select.cut(g, **_parts(p))


@program("math")
def _math(g, p, grids):
    names = {f"x{k}": g.x(k) for k in range(1, g.dims + 1)} | {"input": F.col("v")}
    df = g.df
    for name, other in grids.items():
        if name != "input" and name in p["output"]:
            df = df.join(other.df.select(*other.indices, F.col("v").alias(f"_{name}")), g.indices)
            names[name] = F.col(f"_{name}")
    return Grid(df.select(*g.indices, parse(p["output"], names).alias("v")), g.header)


@program("add", "mul", "div")
def _add(g, p, grids):
    with_ = [grids[n] for n in p["with"].split(",")]
    mode = {"a": "add", "p": "mul", "m": "mul", "d": "div"}[p.get("mode", "a")[0]]
    return combine([g, *with_], mode, p.reals("scale"), p.reals("add"))


@program("scale")
def _scale(g, p, _):
    axis = p.whole("axis", 0)
    if axis:
        g = select.scale_axis(g, axis)
    factor = p.real("dscale", 1.0) if "rscale" not in p else 1 / p.real("rscale")
    return g.with_v(F.col("v") * F.lit(factor))


@program("stack")
def _stack(g, p, _):
    how = next((h for h in ("rms", "min", "max", "prod") if p.flag(h)), "mean" if p.flag("norm", True) else "sum")
    return reduce.stack(g, p.whole("axis", 2), how)


@program("semblance")
def _semblance(g, p, _):
    return reduce.semblance(g, p.whole("axis", 2))


@program("median")
def _median(g, p, _):
    return reduce.median(g, p.whole("axis", 2))


@program("transp")
def _transp(g, p, _):
    plane = p.get("plane", "12")
    return shape.transp(g, int(plane[0]), int(plane[1]))


@program("reverse")
def _reverse(g, p, _):
    which = p.whole("which", (1 << g.dims) - 1)
    return shape.reverse(g, [k for k in range(1, g.dims + 1) if which >> (k - 1) & 1], p.get("opt", "y")[0])


@program("rotate")
def _rotate(g, p, _):
    return shape.rotate(g, p.axes("rot", int))


@program("pad")
def _pad(g, p, _):
    return shape.pad(g, p.axes("beg", int), p.axes("end", int), p.axes("n", int))


@program("spray")
def _spray(g, p, _):
    return shape.spray(g, p.whole("axis", 2), p.whole("n"), p.real("o", 0.0), p.real("d", 1.0), p.get("label", ""), p.get("unit", ""))


@program("cat", "merge", "rcat")
def _cat(g, p, grids):
    return shape.cat([g, *[grids[n] for n in p["with"].split(",")]], p.whole("axis", 3 if g.dims > 2 else g.dims), p.whole("nspace", 0))


@program("interleave")
def _interleave(g, p, grids):
    return shape.interleave([g, *[grids[n] for n in p["with"].split(",")]], p.whole("axis", 3 if g.dims > 2 else g.dims))


@program("put")
def _put(g, p, _):
    typed = {k: (int(v) if k[:-1] == "n" and k[-1:].isdigit() else float(v) if k[:-1] in ("o", "d") and k[-1:].isdigit() else v) for k, v in p.items()}
    return g.put(**typed)


@program("dd")
def _dd(g, p, _):
    """Type conversion: floats are rounded half away from zero on the way to whole numbers."""
    kind = {"float": "double", "int": "int", "short": "short", "double": "double", "long": "bigint", "uchar": "short"}[p["type"]]
    v = F.col("v") if kind == "double" else F.round("v")
    return g.with_v(v.cast(kind))


@program("clip")
def _clip(g, p, _):
    return g.with_v(select.clip(F.col("v"), p.real("clip"), p.real("value")))


@program("clip2")
def _clip2(g, p, _):
    return g.with_v(select.clip2(F.col("v"), p.real("lower"), p.real("upper")))


@program("tclip")
def _tclip(g, p, _):
    return g.with_v(select.threshold_clip(F.col("v"), p.real("lowercut"), p.real("uppercut")))


@program("threshold")
def _threshold(g, p, _):
    return select.soft_threshold(g, p.real("pclip"))


@program("mask")
def _mask(g, p, _):
    return g.with_v(select.mask(F.col("v"), p.real("min"), p.real("max")))


@program("pow", "tpow")
def _pow(g, p, _):
    return select.power_gain(g, p.axes("pow") or {1: p.real("tpow", 0.0)})


@program("costaper")
def _costaper(g, p, _):
    return select.cosine_taper(g, p.axes("nw", int))


@program("causint")
def _causint(g, p, _):
    return frame.causint(g, adjoint=p.flag("adj"))


@program("igrad")
def _igrad(g, p, _):
    return frame.igrad(g, adjoint=p.flag("adj"), square=p.flag("square"))


@program("deriv")
def _deriv(g, p, _):
    return frame.derivative(g)


@program("boxsmooth")
def _boxsmooth(g, p, _):
    for k, r in p.axes("rect", int).items():
        g = frame.boxsmooth(g, r, k, p.whole("repeat", 1))
    return g


@program("smooth")
def _smooth(g, p, _):
    for k, r in p.axes("rect", int).items():
        g = frame.triangle(g, r, k, p.whole("repeat", 1))
    return g


@program("mf", "mean")
def _mf(g, p, _):
    return frame.moving(g, p.whole("nfw", 5), p.get("how", "median"), boundary="edge" if p.flag("boundary") else "zero")


@program("despike")
def _despike(g, p, _):
    return frame.despike(g, p.whole("wide", 5))


@program("listminmax")
def _listminmax(g, p, _):
    return frame.running_extreme(g, least=p.get("choice", "min") == "min")


@program("laplac")
def _laplac(g, p, _):
    return frame.laplacian(g)


@program("laplac3d")
def _laplac3(g, p, _):
    return frame.laplacian(g, (1, 2, 3))


@program("grad2")
def _grad2(g, p, _):
    return frame.sobel(g)


@program("agc")
def _agc(g, p, _):
    return frame.gain_control(g, p.whole("rect1", 125))


@program("ai2refl")
def _ai2refl(g, p, _):
    return frame.reflectivity(g)


@program("refl2ai")
def _refl2ai(g, p, _):
    return frame.impedance(g, p.real("a0", 1.0))


@program("equal")
def _equal(g, p, _):
    return rank.equalise(g)


@program("fft1")
def _fft1(g, p, _):
    return traces.ifft1(g, p.flag("sym")) if p.flag("inv") else traces.fft1(g, p.flag("sym"))


@program("fft3")
def _fft3(g, p, _):
    axis = p.whole("axis", 2)
    turned = shape.transp(g, 1, axis) if axis != 1 else g
    out = traces.fft3(turned, p.flag("inv"), p.flag("sym"))
    return shape.transp(out, 1, axis) if axis != 1 else out


@program("cosft")
def _cosft(g, p, _):
    for k, sign in p.axes("sign", int).items():
        turned = shape.transp(g, 1, k) if k != 1 else g
        out = traces.cosft(turned, inverse=sign < 0)
        g = shape.transp(out, 1, k) if k != 1 else out
    return g


@program("spectra")
def _spectra(g, p, _):
    return traces.spectra(g, p.flag("all"))


@program("spectra2")
def _spectra2(g, p, _):
    return panel.spectra2(g)


@program("bandpass")
def _bandpass(g, p, _):
    return traces.bandpass(g, p.real("flo"), p.real("fhi"), p.whole("nphi", 6), not p.flag("phase"))


@program("trapez")
def _trapez(g, p, _):
    return traces.trapezoid(g, tuple(p.reals("frequency")))


@program("envelope")
def _envelope(g, p, _):
    return traces.envelope(g, p.real("phase", 90.0) if p.flag("hilb") else None)


@program("ricker1")
def _ricker(g, p, _):
    return traces.ricker(g, p.real("frequency"))


@program("halfint")
def _halfint(g, p, _):
    return traces.half_integral(g, p.flag("inv"))


@program("dwt")
def _dwt(g, p, _):
    return traces.dwt(g, p.flag("inv"))


@program("burg")
def _burg(g, p, _):
    return traces.prediction_filter(g, p.whole("na", 3))


@program("smoothreg")
def _smoothreg(g, p, _):
    return traces.implicit_smooth(g, p.real("eps", 1.0))


@program("recfilt")
def _recfilt(g, p, _):
    return traces.recursive_filter(g, p.reals("a"))


@program("roots")
def _roots(g, p, _):
    return traces.polynomial_roots(g)


def _axis(g, p) -> Axis:
    a = g.axis(1)
    return Axis(p.whole("n1", a.n), p.real("o1", a.o), p.real("d1", a.d))


@program("spline")
def _spline(g, p, _):
    return traces.spline(g, _axis(g, p))


@program("remap1")
def _remap(g, p, _):
    new, a = _axis(g, p), g.axis(1)
    at = (F.lit(float(new.o)) + F.col("i1") * F.lit(float(new.d)) - F.lit(float(a.o))) / F.lit(float(a.d))
    out = resample.remapped(g, at, n=new.n)
    return Grid(out.df, out.header.with_axis(1, o=new.o, d=new.d))


@program("nmo")
def _nmo(g, p, _):
    return resample.nmo(g, g.x(2), p.real("v0"), p.real("str"))


@program("inmo")
def _inmo(g, p, _):
    return resample.inverse_nmo(g, g.x(2), p.real("v0"))


@program("stretch", "logstretch", "t2stretch")
def _stretch(g, p, _):
    return resample.stretch(g, {"L": "log", "2": "t2"}.get(p.get("rule", "L"), p.get("rule", "log")), p.whole("n1", g.axis(1).n), p.real("o1"), p.real("d1"))


@program("slant")
def _slant(g, p, _):
    return resample.slant_stack(g, Axis(p.whole("np"), p.real("p0"), p.real("dp")))


@program("vscan")
def _vscan(g, p, _):
    return resample.velocity_scan(g, Axis(p.whole("nv"), p.real("v0"), p.real("dv")), p.flag("semblance"))


@program("autocorr")
def _autocorr(g, p, _):
    return algebra.autocorrelation(g, p.whole("n", 10))


@program("conv")
def _conv(g, p, _):
    return algebra.convolve(g, p.reals("filt"), p.whole("lag", 0), p.flag("adj"))


PROGRAMS |= {
    "real": lambda g, p, _: select.part(g, "re"),
    "imag": lambda g, p, _: select.part(g, "im"),
    "cabs": lambda g, p, _: select.part(g, "abs"),
    "arg": lambda g, p, _: select.part(g, "arg"),
    "rtoc": lambda g, p, _: select.to_complex(g, p.flag("pair")),
    "cmplx": lambda g, p, grids: select.cmplx(g, grids[p["with"]]),
    "heat": lambda g, p, _: panel.heat(g, p.whole("nt", 1), p.real("alpha", 0.25)),
    "expl2": lambda g, p, _: panel.diffuse(g, p.whole("cycle", 1), p.real("pclip", 50.0)),
    "lapfill": lambda g, p, _: panel.fill_missing(g, iterations=p.whole("niter", 200)),
    "dipfilter": lambda g, p, _: panel.dip_filter(g, p.real("low"), p.real("high"), p.flag("pass", True)),
    "canny": lambda g, p, _: panel.canny(g, p.real("min", 95.0), p.real("max", 98.0)),
    "label": lambda g, p, _: panel.components(g),
    "jacobi": lambda g, p, _: panel.eigenvalues(g),
    "svd": lambda g, p, _: panel.singular_values(g),
    "dip": lambda g, p, _: panel.local_slope(g, p.whole("rect1", 5)),
    "noise": lambda g, p, _: gen.noise(g, p.whole("seed", 1), p.real("var"), p.real("range"), p.real("mean", 0.0), not p.flag("type", True), p.flag("rep")),
    "mutter": lambda g, p, _: select.mutter(g, g.x(2), p.real("slope0", 1 / p.real("v0", 1.0)), p.real("slopep"), p.real("t0", 0.0), p.real("tp", 0.0), p.flag("inner")),
    "cgcausint": lambda g, p, _: inverse.conjugate_gradients(inverse.causal_integration, g, g.with_v(F.lit(0.0)), p.whole("niter", 10)),
}
