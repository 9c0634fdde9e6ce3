"""Small numerical solvers on arrays of independent problems."""

from __future__ import annotations

import numpy as np


def zeros(f, low: np.ndarray, high: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """A zero of each f in its bracket: false position with the kept end's value halved, bisection where that leaves the bracket.

    A bracket without a change of sign gives NaN.
    """
    a, b = np.array(low, "f8"), np.array(high, "f8")
    fa, fb = f(a), f(b)
    bad = fa * fb > 0
    x = a.copy()
    for _ in range(200):
        with np.errstate(divide="ignore", invalid="ignore"):
            x = b - fb * (b - a) / (fb - fa)
        outside = ~((x - a) * (x - b) <= 0)
        x = np.where(outside, (a + b) / 2, x)
        fx = f(x)
        crossed = fx * fb < 0
        a, fa = np.where(crossed, b, a), np.where(crossed, fb, fa / 2)
        b, fb = x, fx
        if (bad | (np.abs(fx) <= tolerance) | (np.abs(b - a) <= tolerance)).all():
            break
    return np.where(bad, np.nan, x)


def integrate(f, state: np.ndarray, time: float, steps: int) -> np.ndarray:
    """The states after a time by a third-order rule of three stages (Bogacki and Shampine), many problems at once."""
    h, y = time / steps, np.array(state, "f8")
    for _ in range(steps):
        k1 = f(y)
        k2 = f(y + h / 2 * k1)
        k3 = f(y + 3 * h / 4 * k2)
        y = y + h * (2 * k1 + 3 * k2 + 4 * k3) / 9
    return y
