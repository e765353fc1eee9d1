"""Logistic regression by limited-memory BFGS, for models that are fitted on the driver from a bounded sample."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import sigmoid


def minimize(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 80, memory: int = 8, tol: float = 1e-5) -> np.ndarray:
    """A minimum of the smooth function ``f`` (value, gradient), from ``x``."""
    value, grad = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(grad).max(initial=0.0) < tol:
            break
        q, used = grad.copy(), []
        for s, y, rho in reversed(steps):
            a = rho * (s @ q)
            q -= a * y
            used.append(a)
        q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1.0 / max(1.0, np.linalg.norm(grad))
        for (s, y, rho), a in zip(steps, reversed(used), strict=True):
            q += (a - rho * (y @ q)) * s
        slope, t = -(grad @ q), 1.0
        for _ in range(25):
            new = x - t * q
            v, g = f(new)
            if v <= value + 1e-4 * t * slope:
                break
            t *= 0.5
        else:
            break
        s, y = new - x, g - grad
        if s @ y > 1e-12:
            steps = [*steps[-(memory - 1) :], (s, y, 1.0 / (s @ y))]
        x, value, grad = new, v, g
    return x


def fit_logistic(forward: Callable[[np.ndarray], np.ndarray], back: Callable[[np.ndarray], np.ndarray], y: np.ndarray, dim: int, l2: float, weight: np.ndarray | None = None, rounds: int = 80) -> tuple[np.ndarray, float]:
    """Weights and intercept; ``forward(w)`` is X w, ``back(g)`` is X' g. The intercept isn't penalised."""
    c = np.ones(len(y)) if weight is None else weight
    total = max(1e-9, c.sum())

    def f(p: np.ndarray) -> tuple[float, np.ndarray]:
        z = forward(p[:-1]) + p[-1]
        g = c * (sigmoid(z) - y) / total
        value = float((c * (np.logaddexp(0, z) - y * z)).sum() / total + 0.5 * l2 * (p[:-1] @ p[:-1]))
        return value, np.append(back(g) + l2 * p[:-1], g.sum())

    p = minimize(f, np.zeros(dim + 1), rounds)
    return p[:-1], float(p[-1])


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float, weight: np.ndarray | None = None, rounds: int = 80) -> tuple[np.ndarray, float]:
    x = x.astype(np.float64)  # once, not in every step
    return fit_logistic(lambda w: x @ w, lambda g: x.T @ g, y, x.shape[1], l2, weight, rounds)
