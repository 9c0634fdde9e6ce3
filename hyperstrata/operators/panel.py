"""Kernels on whole panels: one group of outer indices per task, dense numpy inside.

Finite-difference time loops, eikonal solvers and plane decompositions need all
samples of a panel at each step, which no row operator can express; panels are
independent, so many panels scale and one panel must fit a task.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis
from hyperstrata.operators.grid import Grid


def apply(grid: Grid, kernel, axes: int = 2, out: list[Axis] | None = None, held: bool = False) -> Grid:
    """``kernel(array) -> array`` on every block of the first ``axes`` axes.

    The array has the last of these axes first, as in C order: a 2-D panel is
    [i2, i1]. ``out`` describes new block axes. Places without a sample are 0; with ``held``
    the kernel is also told which have one, and only these come back.
    """
    keys = grid.others(*range(1, axes + 1))
    shape = tuple(grid.axis(k).n for k in range(axes, 0, -1))
    names = [f"i{k}" for k in range(1, axes + 1)]
    kinds = ", ".join(f"{c} long" for c in [*names, *keys]) + ", v double"

    def run(key, table):
        import pyarrow as pa

        dense = np.zeros(shape)
        at = tuple(np.asarray(table.column(f"i{k}")) for k in range(axes, 0, -1))
        dense[at] = np.asarray(table.column("v"))
        has = np.zeros(shape, bool)
        has[at] = True
        result = np.asarray(kernel(dense, has) if held else kernel(dense), "f8")
        kept = has.ravel() if held else np.ones(result.size, bool)
        places = np.meshgrid(*[np.arange(n) for n in result.shape], indexing="ij")
        columns = {names[k]: pa.array(places[result.ndim - 1 - k].ravel()[kept], "int64") for k in range(axes)}
        columns |= {c: pa.array(np.full(kept.sum(), k.as_py()), "int64") for c, k in zip(keys, key)}
        return pa.table({**columns, "v": pa.array(result.ravel()[kept])})

    df = grid.df.select(*names, *keys, F.col("v").cast("double").alias("v"))
    if not keys:
        df = df.withColumn("_one", F.lit(0))
        result = df.groupBy("_one").applyInArrow(lambda table: run((), table), kinds)
    else:
        result = df.groupBy(*keys).applyInArrow(run, kinds)
    header = grid.header
    for k, a in enumerate(out or [], 1):
        header = header.with_axis(k, n=a.n, o=a.o, d=a.d)
    return Grid(result.select(*grid.indices, "v"), header)


def laplacian_of(u: np.ndarray) -> np.ndarray:
    """Five-point Laplacian with mirrored edges."""
    p = np.pad(u, 1, mode="edge")
    return p[2:, 1:-1] + p[:-2, 1:-1] + p[1:-1, 2:] + p[1:-1, :-2] - 4 * u


def heat(grid: Grid, steps: int, alpha: float) -> Grid:
    """Explicit heat flow: steps of u += alpha * Laplacian (alpha at most 1/4 is stable)."""

    def kernel(u):
        for _ in range(steps):
            u = u + alpha * laplacian_of(u)
        return u

    return apply(grid, kernel)


def diffuse(grid: Grid, steps: int, contrast_percent: float = 50.0, step: float = 0.2) -> Grid:
    """Anisotropic diffusion: flow is weak where the gradient is over a percentile of itself."""

    def kernel(u):
        for _ in range(steps):
            d1, d2 = np.diff(u, axis=1), np.diff(u, axis=0)
            k = np.percentile(np.concatenate([np.abs(d1).ravel(), np.abs(d2).ravel()]), contrast_percent) or 1.0
            f1, f2 = d1 / (1 + (d1 / k) ** 2), d2 / (1 + (d2 / k) ** 2)
            flow = np.zeros_like(u)
            flow[:, :-1] += f1
            flow[:, 1:] -= f1
            flow[:-1] += f2
            flow[1:] -= f2
            u = u + step * flow
        return u

    return apply(grid, kernel)


def acoustic_wave(velocity: Grid, source: tuple[int, int], wavelet: list[float], dt: float) -> Grid:
    """Pressure after the last sample of a wavelet at (i1, i2), second order in time and space."""
    d1, d2 = velocity.axis(1).d, velocity.axis(2).d

    def kernel(v):
        before, now = np.zeros_like(v), np.zeros_like(v)
        c2 = (v * dt) ** 2
        for s in wavelet:
            p = np.pad(now, 1)
            lap = (p[1:-1, 2:] + p[1:-1, :-2] - 2 * now) / d1**2 + (p[2:, 1:-1] + p[:-2, 1:-1] - 2 * now) / d2**2
            before, now = now, 2 * now - before + c2 * lap
            now[source[1], source[0]] += s * dt * dt
        return now

    return apply(velocity, kernel)


def travel_times(velocity: Grid, source: tuple[int, int]) -> Grid:
    """First arrivals from (i1, i2): fast marching of the eikonal equation, first order."""
    h1, h2 = abs(velocity.axis(1).d), abs(velocity.axis(2).d)

    def kernel(v):
        slow = 1 / v
        n2, n1 = v.shape
        t, done = np.full(v.shape, np.inf), np.zeros(v.shape, bool)
        start = (source[1], source[0])
        t[start] = 0.0
        heap = [(0.0, start)]
        while heap:
            at, (b, a) = heapq.heappop(heap)
            if done[b, a]:
                continue
            done[b, a] = True
            for nb, na in ((b + 1, a), (b - 1, a), (b, a + 1), (b, a - 1)):
                if not (0 <= nb < n2 and 0 <= na < n1) or done[nb, na]:
                    continue
                t1 = min(t[nb, na - 1] if na else np.inf, t[nb, na + 1] if na + 1 < n1 else np.inf)
                t2 = min(t[nb - 1, na] if nb else np.inf, t[nb + 1, na] if nb + 1 < n2 else np.inf)
                s = slow[nb, na]
                best = min(t1 + h1 * s, t2 + h2 * s)
                if np.isfinite(t1) and np.isfinite(t2):
                    w1, w2 = 1 / h1**2, 1 / h2**2
                    mid, c = (w1 * t1 + w2 * t2) / (w1 + w2), (w1 * t1 * t1 + w2 * t2 * t2 - s * s) / (w1 + w2)
                    if mid * mid >= c and (root := mid + math.sqrt(mid * mid - c)) >= max(t1, t2):
                        best = root
                if best < t[nb, na]:
                    t[nb, na] = best
                    heapq.heappush(heap, (best, (nb, na)))
        return t

    return apply(velocity, kernel)


def fill_missing(grid: Grid, missing: float = 0.0, iterations: int = 200) -> Grid:
    """Replace missing cells so that the Laplacian vanishes there, by conjugate gradients."""

    def kernel(u):
        free = u == missing
        if not free.any() or free.all():
            return u
        x, r = u.copy(), np.where(free, laplacian_of(u), 0.0)
        p, rr = r.copy(), float((r * r).sum())
        for _ in range(iterations):
            if rr < 1e-20:
                break
            q = np.where(free, -laplacian_of(p), 0.0)
            step = rr / float((p * q).sum())
            x, r = x + step * p, r - step * q
            new = float((r * r).sum())
            p, rr = r + new / rr * p, new
        return x

    return apply(grid, kernel)


def dip_filter(grid: Grid, low: float, high: float, keep: bool = True) -> Grid:
    """Keep (or reject) apparent dips, in samples of axis 1 per sample of axis 2, between two bounds."""

    def kernel(u):
        k2, f1 = np.fft.fftfreq(u.shape[0])[:, None], np.fft.fftfreq(u.shape[1])[None]
        with np.errstate(divide="ignore", invalid="ignore"):
            dip = -k2 / f1
        inside = (dip >= low) & (dip <= high)
        inside[:, 0] = keep
        return np.fft.ifft2(np.fft.fft2(u) * (inside if keep else ~inside)).real

    return apply(grid, kernel)


def spectra2(grid: Grid) -> Grid:
    """2-D amplitude spectra: non-negative frequencies of axis 1, centred wavenumbers of axis 2."""
    n1, n2 = grid.axis(1).n, grid.axis(2).n
    d1, d2 = 1 / (n1 * grid.axis(1).d), 1 / (n2 * grid.axis(2).d)
    return apply(grid, lambda u: np.fft.fftshift(np.abs(np.fft.rfft2(u)), axes=0) / math.sqrt(u.size), out=[Axis(n1 // 2 + 1, 0.0, d1), Axis(n2, -(n2 // 2) * d2, d2)])


def canny(grid: Grid, low_percent: float = 95.0, high_percent: float = 98.0) -> Grid:
    """Edges: Sobel gradient, thinning across the edge, two percentile thresholds with growth."""

    def kernel(u):
        p = np.pad(u, 1, mode="edge")
        s1 = (p[:-2] + 2 * p[1:-1] + p[2:])[:, 2:] - (p[:-2] + 2 * p[1:-1] + p[2:])[:, :-2]
        s2 = (p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:])[2:] - (p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:])[:-2]
        g = s1**2 + s2**2
        sector = np.round(np.arctan2(s2, s1) / (np.pi / 4)).astype(int) % 4
        q, thin = np.pad(g, 1), np.zeros_like(g)
        n2, n1 = g.shape
        for k, (a, b) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
            ahead, behind = q[1 + a : 1 + a + n2, 1 + b : 1 + b + n1], q[1 - a : 1 - a + n2, 1 - b : 1 - b + n1]
            thin = np.where((sector == k) & (g >= ahead) & (g > behind), g, thin)
        weak, strong = thin > np.percentile(thin, low_percent), thin > np.percentile(thin, high_percent)
        while True:
            grown = np.pad(strong, 1)
            near = np.logical_or.reduce([grown[1 + a : 1 + a + n2, 1 + b : 1 + b + n1] for a in (-1, 0, 1) for b in (-1, 0, 1)])
            more = strong | (near & weak)
            if (more == strong).all():
                return strong.astype("f8")
            strong = more

    return apply(grid, kernel)


def components(grid: Grid) -> Grid:
    """Labels (from 1, by first sample) of 4-connected regions of non-zero samples."""

    def kernel(u):
        labels, count = np.zeros(u.shape, int), 0
        for b, a in zip(*np.nonzero(u)):
            if labels[b, a]:
                continue
            count += 1
            todo = [(b, a)]
            labels[b, a] = count
            while todo:
                y, x = todo.pop()
                for p, q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= p < u.shape[0] and 0 <= q < u.shape[1] and u[p, q] and not labels[p, q]:
                        labels[p, q] = count
                        todo.append((p, q))
        return labels

    return apply(grid, kernel)


def eigenvalues(grid: Grid) -> Grid:
    """Eigenvalues of each symmetric panel, largest absolute value first (on axis 1, one line)."""
    n = grid.axis(1).n
    return apply(grid, lambda u: np.array(sorted(np.linalg.eigvalsh(u), key=lambda x: -abs(x)))[None], out=[Axis(n), Axis(1)])


def singular_values(grid: Grid) -> Grid:
    n = min(grid.axis(1).n, grid.axis(2).n)
    return apply(grid, lambda u: np.linalg.svd(u, compute_uv=False)[None], out=[Axis(n), Axis(1)])


def local_slope(grid: Grid, rect: int = 5) -> Grid:
    """Dip of a panel, in samples per trace, by smoothed products of its derivatives."""

    def smooth(a):
        w = np.concatenate([np.arange(1, rect + 1), np.arange(rect - 1, 0, -1)]) / rect**2
        for axis in (0, 1):
            a = np.apply_along_axis(lambda x: np.convolve(np.pad(x, rect - 1, mode="symmetric"), w, "valid"), axis, a)
        return a

    def kernel(u):
        d2, d1 = np.gradient(u)
        below = smooth(d1 * d1)
        return -smooth(d1 * d2) / np.where(below > 1e-12, below, 1.0)

    return apply(grid, kernel)


def frequency_filter(grid: Grid, response) -> Grid:
    """Multiply the 2-D spectrum of each panel by ``response(f1, f2)``, in cycles per sample."""

    def kernel(u):
        f2, f1 = np.fft.fftfreq(u.shape[0])[:, None], np.fft.fftfreq(u.shape[1])[None]
        return np.fft.ifft2(np.fft.fft2(u) * response(f1, f2)).real

    return apply(grid, kernel)


def solved(grid: Grid) -> Grid:
    """x of A x = b for each panel: rows i2 of A, and b as its last column (i1 = n2). Singular panels give 0."""
    n = grid.axis(2).n

    def kernel(u):
        try:
            return np.linalg.solve(u[:, :n], u[:, n])[None]
        except np.linalg.LinAlgError:
            return np.zeros((1, n))

    return apply(grid, kernel, out=[Axis(n), Axis(1)])
