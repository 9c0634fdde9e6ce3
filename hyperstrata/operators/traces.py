"""Numerical kernels on whole lines: Arrow batches of arrays, one numpy call per line or batch.

Used where built-in expressions cannot say it: fast transforms, recursive filters,
splines, wavelets. A line must fit a task; lines are independent, so nothing else is
needed for scale than enough lines.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis
from hyperstrata.operators.grid import Grid, from_traces


def _lines(column) -> tuple[np.ndarray, np.ndarray]:
    """(all samples, offsets of the lines) of an Arrow column of arrays, complex where the samples are pairs."""
    import pyarrow as pa

    offsets, values = np.asarray(column.offsets), column.values
    if pa.types.is_struct(values.type):
        return np.asarray(values.field("re"), "f8") + 1j * np.asarray(values.field("im"), "f8"), offsets
    return np.asarray(values, "f8"), offsets


def apply(grid: Grid, kernel, axis: Axis | None = None, complex_out: bool = False, block: bool = False) -> Grid:
    """``kernel(line) -> line`` on every line of axis 1; ``axis`` describes the new axis 1.

    A ``block`` kernel takes the lines of one length of a batch at once, as rows. Null
    samples are NaN.
    """
    keys = grid.others(1)
    traces = grid.to_traces()
    kinds = dict(traces.dtypes)
    value = "array<struct<re: double, im: double>>" if complex_out else "array<double>"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            samples, offsets = _lines(batch.column(len(keys)))
            sizes, out = np.diff(offsets), [None] * batch.num_rows
            if block:
                for size in np.unique(sizes):
                    which = np.flatnonzero(sizes == size)
                    for k, line in zip(which, np.asarray(kernel(samples[offsets[which, None] + np.arange(size)]))):
                        out[k] = line
            else:
                out = [np.asarray(kernel(samples[i:j])) for i, j in zip(offsets[:-1], offsets[1:])]
            flat = np.concatenate(out) if out else np.zeros(0)
            if complex_out:
                values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat.real, "f8")), pa.array(np.ascontiguousarray(flat.imag, "f8"))], names=["re", "im"])
            else:
                values = pa.array(flat.astype("f8"))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype("i4")
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.ListArray.from_arrays(pa.array(ends), values)], names=[*keys, "trace"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + (", " if keys else "") + f"trace {value}"
    header = grid.header
    if axis is not None:
        header = header.with_axis(1, n=axis.n, o=axis.o, d=axis.d, label=axis.label, unit=axis.unit)
    return from_traces(traces.mapInArrow(run, schema), header)


def next_fast(n: int) -> int:
    """The least length not under n with factors 2, 3 and 5 alone."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def fft1(grid: Grid, sym: bool = False) -> Grid:
    """Real lines to complex spectra of non-negative frequencies, padded to a fast even length."""
    a = grid.axis(1)
    nt = 2 * next_fast((a.n + 1) // 2)
    scale = 1 / math.sqrt(nt) if sym else 1.0
    out = apply(grid, lambda x: np.fft.rfft(x, nt) * scale, Axis(nt // 2 + 1, 0.0, 1 / (nt * a.d), "Frequency", "Hz"), complex_out=True, block=True)
    return out.put(fft_n1=a.n, fft_o1=a.o, fft_nt=nt)


def ifft1(grid: Grid, sym: bool = False) -> Grid:
    n, o, nt = grid.header.get("fft_n1"), grid.header.get("fft_o1"), grid.header.get("fft_nt")
    d = 1 / (nt * grid.axis(1).d)
    scale = math.sqrt(nt) if sym else 1.0
    return apply(grid, lambda x: np.fft.irfft(x, nt)[:, :n] * scale, Axis(n, o, d), block=True)


def fft3(grid: Grid, inverse: bool = False, sym: bool = False) -> Grid:
    """Complex transform of axis 1 (transpose first for another), zero frequency in the middle."""
    a = grid.axis(1)
    n = a.n
    scale = 1 / math.sqrt(n) if sym else (1 / n if inverse else 1.0)
    kernel = (lambda x: np.fft.ifft(np.fft.ifftshift(x, 1)) * n * scale) if inverse else (lambda x: np.fft.fftshift(np.fft.fft(x), 1) * scale)
    d = 1 / (n * a.d)
    return apply(grid, kernel, Axis(n, 0.0 if inverse else -(n // 2) * d, d), complex_out=True, block=True)


def cosft(grid: Grid, inverse: bool = False) -> Grid:
    """Cosine transform: sums of v(i) cos(pi k (2i + 1) / 2n), and its inverse."""
    n = grid.axis(1).n
    table = np.cos(np.pi * np.outer(np.arange(n), 2 * np.arange(n) + 1) / (2 * n))
    weight = np.where(np.arange(n) == 0, 1.0, 2.0) / n
    return apply(grid, (lambda x: (x * weight) @ table) if inverse else (lambda x: x @ table.T), block=True)


def spectra(grid: Grid, average: bool = False) -> Grid:
    """Amplitude spectra scaled by the root of the length; or their mean over all lines."""
    a = grid.axis(1)
    nt = 2 * next_fast((a.n + 1) // 2)
    out = apply(grid, lambda x: np.abs(np.fft.rfft(x, nt)) / math.sqrt(nt), Axis(nt // 2 + 1, 0.0, 1 / (nt * a.d), "Frequency", "Hz"), block=True)
    if not average:
        return out
    df = out.df.groupBy("i1").agg(F.avg("v").alias("v"))
    from hyperstrata.functions.header import Header

    return Grid(df, Header((out.axis(1),)))


def butterworth(x: np.ndarray, cut: float, poles: int, high: bool) -> np.ndarray:
    """Cascade of second-order sections by the bilinear transform, on the rows; ``cut`` is in cycles per sample."""
    y = np.ascontiguousarray(x.T, "f8")  # samples first: all rows take a step at once
    warp = 2 * math.tan(math.pi * cut)
    for k in range(poles // 2):
        damping = 2 * math.sin(math.pi * (2 * k + 1) / (2 * poles))
        w2 = warp * warp
        a0 = 4 + 2 * damping * warp + w2
        a1, a2 = (2 * w2 - 8) / a0, (4 - 2 * damping * warp + w2) / a0
        b0, b1 = (4 / a0, -8 / a0) if high else (w2 / a0, 2 * w2 / a0)
        out = b0 * y
        out[1:] += b1 * y[:-1]
        out[2:] += b0 * y[:-2]
        for i in range(1, len(out)):
            out[i] -= a1 * out[i - 1]
            if i > 1:
                out[i] -= a2 * out[i - 2]
        y = out
    return y.T


def bandpass(grid: Grid, low: float | None = None, high: float | None = None, poles: int = 6, zero_phase: bool = True) -> Grid:
    """Butterworth high-pass at ``low`` and low-pass at ``high``; zero phase: half the poles, both ways."""
    d = grid.axis(1).d

    def kernel(x):
        n = 2 * max(1, poles // 4) if zero_phase else poles
        for cut, is_high in ((low, True), (high, False)):
            if cut is not None:
                x = butterworth(x, cut * d, n, is_high)
                if zero_phase:
                    x = butterworth(x[:, ::-1], cut * d, n, is_high)[:, ::-1]
        return x

    return apply(grid, kernel, block=True)


def trapezoid(grid: Grid, corners: tuple[float, float, float, float]) -> Grid:
    """Band filter whose response rises and falls between four frequencies."""
    a = grid.axis(1)

    def kernel(x):
        n = x.shape[1]
        nt = 2 * next_fast((n + 1) // 2)
        f = np.fft.rfftfreq(nt, a.d)
        return np.fft.irfft(np.fft.rfft(x, nt) * np.interp(f, corners, [0, 1, 1, 0], 0, 0), nt)[:, :n]

    return apply(grid, kernel, block=True)


def hilbert(x: np.ndarray) -> np.ndarray:
    """The transform of each row."""
    n = x.shape[-1]
    spectrum = np.fft.fft(x)
    spectrum[..., 1 : (n + 1) // 2] *= 2
    spectrum[..., n // 2 + 1 :] = 0
    return np.fft.ifft(spectrum).imag


def envelope(grid: Grid, phase: float | None = None) -> Grid:
    """The size of the analytic signal; with ``phase`` (degrees) the line turned by it."""
    if phase is None:
        return apply(grid, lambda x: np.hypot(x, hilbert(x)), block=True)
    c, s = math.cos(math.radians(phase)), math.sin(math.radians(phase))
    return apply(grid, lambda x: c * x + s * hilbert(x), block=True)


def half_integral(grid: Grid, inverse: bool = False) -> Grid:
    """Half-order integration (division of the spectrum by the root of i w), or differentiation."""

    def kernel(x):
        size = x.shape[1]
        n = 2 * next_fast(size)
        z = np.exp(1j * np.pi * 2 * np.arange(n // 2 + 1) / n)
        root = np.sqrt(np.maximum(np.abs(1 - 1 / z), 1e-3)) * np.exp(0.5j * np.angle(1 - 1 / z + 1e-30))
        return np.fft.irfft(np.fft.rfft(x, n) * (root if inverse else 1 / root), n)[:, :size]

    return apply(grid, kernel, block=True)


def ricker(grid: Grid, frequency: float) -> Grid:
    """Convolve with a Ricker wavelet of a peak frequency."""
    a = grid.axis(1)

    def kernel(x):
        n = x.shape[1]
        nt = 2 * next_fast(n)
        f = np.fft.rfftfreq(nt, a.d) / frequency
        return np.fft.irfft(np.fft.rfft(x, nt) * f * f * np.exp(1 - f * f), nt)[:, :n]

    return apply(grid, kernel, block=True)


def tridiagonal(lower: np.ndarray, diagonal: np.ndarray, upper: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solve a tridiagonal system by elimination."""
    n = len(rhs)
    c, x = np.zeros(n), np.array(rhs, "f8")
    pivot = diagonal[0]
    x[0] /= pivot
    for i in range(1, n):
        c[i - 1] = upper[i - 1] / pivot
        pivot = diagonal[i] - lower[i - 1] * c[i - 1]
        x[i] = (x[i] - lower[i - 1] * x[i - 1]) / pivot
    for i in range(n - 2, -1, -1):
        x[i] -= c[i] * x[i + 1]
    return x


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through knots, straight beyond the ends."""
    if len(x) < 3:
        return np.interp(at, x, y)
    h = np.diff(x)
    slope = np.diff(y) / h
    m = np.concatenate([[0], tridiagonal(h[1:-1], 2 * (h[:-1] + h[1:]), h[1:-1], 6 * np.diff(slope)), [0]])
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(h) - 1)
    t, hk = np.clip(at, x[0], x[-1]) - x[k], h[k]
    inside = y[k] + t * (slope[k] - hk * (2 * m[k] + m[k + 1]) / 6) + t * t * m[k] / 2 + t**3 * (m[k + 1] - m[k]) / (6 * hk)
    first, last = slope[0] - h[0] * m[1] / 6, slope[-1] + h[-1] * m[-2] / 6
    return inside + np.where(at < x[0], (at - x[0]) * first, 0) + np.where(at > x[-1], (at - x[-1]) * last, 0)


def spline(grid: Grid, axis: Axis) -> Grid:
    """Cubic spline resampling of axis 1."""
    a = grid.axis(1)
    at = axis.o + axis.d * np.arange(axis.n)
    return apply(grid, lambda y: natural_spline(a.o + a.d * np.arange(len(y)), y, at), axis)


def haar(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Orthonormal Haar wavelet transform of a line padded to a power of two."""
    n = 1 << max(0, len(x) - 1).bit_length()
    y = np.concatenate([x.astype("f8"), np.zeros(n - len(x))])
    sizes = [n >> k for k in range(n.bit_length() - 1)]
    for m in reversed(sizes) if inverse else sizes:
        half = m // 2
        if inverse:
            a, d = y[:half].copy(), y[half:m].copy()
            y[:m:2], y[1:m:2] = (a + d) / math.sqrt(2), (a - d) / math.sqrt(2)
        else:
            even, odd = y[:m:2].copy(), y[1:m:2].copy()
            y[:half], y[half:m] = (even + odd) / math.sqrt(2), (even - odd) / math.sqrt(2)
    return y


def dwt(grid: Grid, inverse: bool = False) -> Grid:
    n = 1 << max(0, grid.axis(1).n - 1).bit_length()
    return apply(grid, lambda x: haar(x, inverse), Axis(n, grid.axis(1).o, grid.axis(1).d))


def burg(x: np.ndarray, order: int) -> np.ndarray:
    """Prediction-error filter of a line by Burg's recursion."""
    f, b, a = x.astype("f8").copy(), x.astype("f8").copy(), np.array([1.0])
    for _ in range(order):
        ff, bb = f[1:], b[:-1]
        power = (ff @ ff + bb @ bb) or 1.0
        k = -2 * (ff @ bb) / power
        a = np.concatenate([a, [0]]) + k * np.concatenate([[0], a[::-1]])
        f, b = ff + k * bb, bb + k * ff
    return a


def prediction_filter(grid: Grid, order: int) -> Grid:
    return apply(grid, lambda x: burg(x, order), Axis(order + 1))


def implicit_smooth(grid: Grid, eps: float) -> Grid:
    """Solve (1 + eps D'D) y = x on each line, D the first difference."""

    def kernel(x):
        n = len(x)
        if n < 2:
            return x
        diagonal = np.full(n, 1 + 2 * eps)
        diagonal[[0, -1]] = 1 + eps
        return tridiagonal(np.full(n - 1, -eps), diagonal, np.full(n - 1, -eps), x)

    return apply(grid, kernel)


def polynomial_roots(grid: Grid) -> Grid:
    """Roots of each line's polynomial (complex samples, lowest power first), sorted by size."""
    return apply(grid, lambda c: sorted(np.roots(c[::-1]), key=lambda z: (round(abs(z), 9), z.imag)), Axis(grid.axis(1).n - 1), complex_out=True)


def recursive_filter(grid: Grid, taps: list[float]) -> Grid:
    """Polynomial division: y(i) = x(i) - sum taps(k) y(i - 1 - k)."""

    def kernel(x):
        y = np.zeros(len(x))
        for i in range(len(x)):
            y[i] = x[i] - sum(t * y[i - 1 - k] for k, t in enumerate(taps) if i - 1 - k >= 0)
        return y

    return apply(grid, kernel)


def smooth_derivative(grid: Grid, eps: float = 0.2) -> Grid:
    """First differences, over the step, of the line y that solves (1 + eps D'D) y = x, D the second difference.

    The last difference stands twice.
    """
    n, d = grid.axis(1).n, float(grid.axis(1).d)
    second = np.diff(np.eye(n), 2, axis=0)
    slope = np.diff(np.linalg.inv(np.eye(n) + eps * second.T @ second), axis=0) / d
    table = np.vstack([slope, slope[-1:]])
    return apply(grid, lambda x: x @ table.T, block=True)


def lifted(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Wavelet transform by linear lifting of a line padded to a power of two: odd samples less the mean of

    their neighbours, even ones plus a quarter of the differences beside them; edges repeat.
    """
    n = 1 << max(0, len(x) - 1).bit_length()
    y = np.concatenate([x.astype("f8"), np.zeros(n - len(x))])
    sizes = [n >> k for k in range(n.bit_length() - 1)]
    for m in reversed(sizes) if inverse else sizes:
        half = m // 2
        if inverse:
            even, odd = y[:half].copy(), y[half:m].copy()
        else:
            even, odd = y[:m:2].copy(), y[1:m:2].copy()
            odd -= (even + np.append(even[1:], even[-1:])) / 2
        quarter = (odd + np.append(odd[:1], odd[:-1])) / 4
        even += -quarter if inverse else quarter
        if inverse:
            odd += (even + np.append(even[1:], even[-1:])) / 2
            y[:m:2], y[1:m:2] = even, odd
        else:
            y[:half], y[half:m] = even, odd
    return y


def lifting(grid: Grid, inverse: bool = False) -> Grid:
    n = 1 << max(0, grid.axis(1).n - 1).bit_length()
    return apply(grid, lambda x: lifted(x, inverse), Axis(n, grid.axis(1).o, grid.axis(1).d))
