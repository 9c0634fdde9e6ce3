"""Operators with adjoints, the dot-product test and conjugate gradients on DataFrames.

An operator is a pair of functions from grid to grid. Each iteration is a few joins
and sums; lineage is cut with a reliable checkpoint every few iterations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F

from hyperstrata.operators import algebra, frame
from hyperstrata.operators.grid import Grid, checkpointed, combine


@dataclass(frozen=True)
class Operator:
    forward: Callable[[Grid], Grid]
    adjoint: Callable[[Grid], Grid]

    def __matmul__(self, other: Operator) -> Operator:
        return Operator(lambda m: self.forward(other.forward(m)), lambda d: other.adjoint(self.adjoint(d)))


causal_integration = Operator(lambda g: frame.causint(g), lambda g: frame.causint(g, adjoint=True))
gradient = Operator(lambda g: frame.igrad(g), lambda g: frame.igrad(g, adjoint=True))


def convolution(taps: list[float]) -> Operator:
    return Operator(lambda g: algebra.convolve(g, taps), lambda g: algebra.convolve(g, taps, adjoint=True))


def masking(weight: Grid) -> Operator:
    both = lambda g: combine([g, weight], "mul")
    return Operator(both, both)


def noise_like(grid: Grid, seed: int) -> Grid:
    """Uniform (0, 1) values that depend on the indices and the seed alone."""
    return grid.with_v(F.pmod(F.xxhash64(F.lit(seed), *grid.indices), F.lit(1 << 30)) / F.lit(float(1 << 30)))


def dot_test(op: Operator, model: Grid, data: Grid, seed: int = 2024) -> tuple[float, float]:
    """<L m, d> and <m, L' d> for pseudo-random m and d."""
    m, d = noise_like(model, seed), noise_like(data, seed + 1)
    return op.forward(m).dot(d), m.dot(op.adjoint(d))


def _keep(grid: Grid) -> Grid:
    return Grid(checkpointed(grid.df), grid.header)


def conjugate_gradients(op: Operator, data: Grid, start: Grid, iterations: int, every: int = 2) -> Grid:
    """Least squares |L m - d| by conjugate gradients from ``start``; only dot products reach the driver."""
    model = _keep(start)
    residual = _keep(combine([data, op.forward(model)], "add", scale=[1.0, -1.0]))
    gradient = _keep(op.adjoint(residual))
    direction, size = gradient, gradient.dot(gradient)
    for k in range(iterations):
        if not size:
            break
        moved = _keep(op.forward(direction))
        step = size / (moved.dot(moved) or 1.0)
        model = combine([model, direction], "add", scale=[1.0, step])
        residual = combine([residual, moved], "add", scale=[1.0, -step])
        if k % every == every - 1:
            model, residual = _keep(model), _keep(residual)
        gradient = _keep(op.adjoint(residual))
        new = gradient.dot(gradient)
        direction = _keep(combine([gradient, direction], "add", scale=[1.0, new / size]))
        size = new
    return model


def conjugate_directions(op: Operator, data: Grid, start: Grid, iterations: int, memory: int = 3) -> Grid:
    """Least squares by steps made conjugate to the last ``memory`` steps; needs no exact adjoint, only a useful one."""
    model = _keep(start)
    residual = _keep(combine([data, op.forward(model)], "add", scale=[1.0, -1.0]))
    past: list[tuple[Grid, Grid, float]] = []
    for _ in range(iterations):
        way = _keep(op.adjoint(residual))
        seen = _keep(op.forward(way))
        for old, old_seen, power in past:
            share = seen.dot(old_seen) / power
            way = combine([way, old], "add", scale=[1.0, -share])
            seen = combine([seen, old_seen], "add", scale=[1.0, -share])
        way, seen = _keep(way), _keep(seen)
        power = seen.dot(seen)
        if not power:
            break
        step = residual.dot(seen) / power
        model = _keep(combine([model, way], "add", scale=[1.0, step]))
        residual = _keep(combine([residual, seen], "add", scale=[1.0, -step]))
        past = [*past, (way, seen, power)][-memory:] if memory else []
    return model


def preconditioned(op: Operator, shaping: Operator, data: Grid, start: Grid, iterations: int) -> Grid:
    """Least squares for p in m = P p, by conjugate gradients from p = ``start``; the model m."""
    return shaping.forward(conjugate_gradients(op @ shaping, data, start, iterations))
