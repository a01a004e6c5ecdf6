"""Minimisers that run on the driver around an objective, which may be a DataFrame aggregation."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np

Objective = Callable[[np.ndarray], float]
_GOLDEN = (5**0.5 - 1) / 2


def golden_section(f: Callable[[float], float], lo: float, hi: float, tolerance: float = 1e-8) -> float:
    """The place of a minimum between lo and hi."""
    a, b = lo, hi
    c, d = b - _GOLDEN * (b - a), a + _GOLDEN * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tolerance:
        if fc <= fd:
            b, d, fd = d, c, fc
            c = b - _GOLDEN * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + _GOLDEN * (b - a)
            fd = f(d)
    return (a + b) / 2


def gradient(f: Objective, x: np.ndarray, h: float = 1e-4) -> np.ndarray:
    """Forward differences."""
    base = f(x)
    out = np.zeros(len(x))
    for i in range(len(x)):
        y = x.copy()
        y[i] += h
        out[i] = (f(y) - base) / h
    return out


def gradient_descent(f: Objective, x: np.ndarray, rate: float = 0.01, steps: int = 1000, tolerance: float = 1e-8, grad: Callable | None = None, log: Callable[[str], None] | None = None) -> np.ndarray:
    x = np.array(x, float)
    for k in range(steps):
        g = grad(x) if grad else gradient(f, x)
        if log:
            log(f"{k} {f(x)}")
        if np.linalg.norm(g) < tolerance:
            break
        x = x - rate * g
    return x


def _line(f: Objective, x: np.ndarray, d: np.ndarray) -> float:
    """A step that is doubled while it gets better, then refined by golden section."""
    t, best = 1.0, f(x)
    while f(x + t * d) > best and t > 1e-12:
        t /= 2
    if t <= 1e-12:
        return 0.0
    while f(x + 2 * t * d) < f(x + t * d) and t < 1e12:
        t *= 2
    return golden_section(lambda s: f(x + s * d), 0.0, 2 * t, 1e-6 * t)


def lbfgs(f: Objective, x: np.ndarray, history: int = 5, steps: int = 200, tolerance: float = 1e-6, grad: Callable | None = None) -> np.ndarray:
    """Quasi-Newton steps from the last ``history`` changes of place and gradient."""
    x = np.array(x, float)
    g = grad(x) if grad else gradient(f, x)
    past: deque = deque(maxlen=history)
    for _ in range(steps):
        if np.linalg.norm(g) < tolerance:
            break
        q, held = g.copy(), []
        for s, y in reversed(past):
            a = s @ q / (y @ s)
            held.append(a)
            q = q - a * y
        if past:
            s, y = past[-1]
            q = q * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(held), strict=True):
            q = q + s * (a - y @ q / (y @ s))
        t = _line(f, x, -q)
        if t == 0:
            break
        new = x - t * q
        h = grad(new) if grad else gradient(f, new)
        if (h - g) @ (new - x) > 1e-14:
            past.append((new - x, h - g))
        x, g = new, h
    return x
