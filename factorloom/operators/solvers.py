"""Small dense solvers: Cholesky, non-negative least squares and the line search's polynomial."""

from __future__ import annotations

import numpy as np


def pack(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each entry of a packed upper triangle, column by column."""
    return tuple(np.array(x) for x in zip(*((i, j) for j in range(k) for i in range(j + 1)), strict=True))


def unpack(packed: np.ndarray, k: int) -> np.ndarray:
    """Symmetric matrices (.., k, k) from packed upper triangles (.., k (k + 1) / 2)."""
    i, j = pack(k)
    full = np.zeros((*packed.shape[:-1], k, k))
    full[..., i, j] = packed
    full[..., j, i] = packed
    return full


def cholesky(gram: np.ndarray, right: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Solves (gram + ridge I) x = right for a batch; fails if a matrix isn't positive definite."""
    matrix = gram + ridge[:, None, None] * np.eye(gram.shape[-1])
    try:
        lower = np.linalg.cholesky(matrix)
    except np.linalg.LinAlgError as e:
        raise ValueError("a system isn't positive definite; raise the regularisation") from e
    # rounding can hide a singular system from the factorization, but not from its pivots
    pivots = np.diagonal(lower, axis1=-2, axis2=-1) ** 2
    if (pivots <= 1e-14 * np.diagonal(matrix, axis1=-2, axis2=-1).max(axis=-1, initial=0, keepdims=True)).any():
        raise ValueError("a system isn't positive definite; raise the regularisation")
    # forward and back through the factor, a column at a time for the whole batch
    x = right.astype(float).copy()
    k = x.shape[-1]
    for i in range(k):
        x[:, i] = (x[:, i] - (lower[:, i, :i] * x[:, :i]).sum(axis=1)) / lower[:, i, i]
    for i in reversed(range(k)):
        x[:, i] = (x[:, i] - (lower[:, i + 1 :, i] * x[:, i + 1 :]).sum(axis=1)) / lower[:, i, i]
    return x


def nnls(gram: np.ndarray, right: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Minimises x'(gram + ridge I)x / 2 - right'x over x >= 0 by active sets, all rows of a batch together.

    A row frees the component with the strongest pull; where the free components' solution leaves the orthant, the row goes
    as far towards it as it can and holds what has reached 0.
    """
    n, k = right.shape
    if not n or not k:
        return np.zeros_like(right, dtype=float)
    matrix = gram + ridge[:, None, None] * np.eye(k)
    x, free = np.zeros((n, k)), np.zeros((n, k), bool)
    tol = 1e-12 * np.maximum(1.0, np.abs(right).max(axis=1))
    inside = np.zeros(n, bool)  # rows whose free components' solution isn't reached yet
    todo = np.arange(n)
    for _ in range(6 * k + 20):
        ready = todo[~inside[todo]]
        pull = np.where(free[ready], -np.inf, right[ready] - np.einsum("nij,nj->ni", matrix[ready], x[ready]))
        more = pull.max(axis=1) > tol[ready]
        free[ready[more], pull[more].argmax(axis=1)] = True
        inside[ready[more]] = True
        todo = todo[inside[todo]]
        if not len(todo):
            break
        both = free[todo][:, :, None] & free[todo][:, None, :]
        s = np.linalg.solve(np.where(both, matrix[todo], np.eye(k)), np.where(free[todo], right[todo], 0.0)[..., None])[..., 0]
        down = free[todo] & (s <= 0)
        good = ~down.any(axis=1)
        x[todo[good]], inside[todo[good]] = s[good], False
        at, s, down = todo[~good], s[~good], down[~good]
        step = np.where(down, x[at] / np.maximum(x[at] - s, 1e-300), np.inf).min(axis=1, keepdims=True, initial=np.inf)
        moved = x[at] + np.where(np.isfinite(step), step, 0.0) * (s - x[at])
        free[at] &= moved > 1e-14
        x[at] = np.where(free[at], moved, 0.0)
    return x


def horner(c: list[float], x: float) -> float:
    out = 0.0
    for a in reversed(c):
        out = out * x + a
    return out


def derivative(c: list[float]) -> list[float]:
    return [i * a for i, a in enumerate(c)][1:] or [0.0]


def newton(c: list[float], start: float, tol: float = 1e-8, steps: int = 11) -> float:
    """The zero of the polynomial's slope that up to ``steps`` Newton steps from ``start`` lead to, or NaN."""
    first, second = derivative(c), derivative(derivative(c))
    x = start
    for _ in range(steps):
        slope, bend = horner(first, x), horner(second, x)
        if abs(slope) <= tol:
            break
        if not np.isfinite(bend) or bend == 0:
            return float("nan")
        x -= slope / bend
    return x


def minimize(c: list[float], starts: list[float], tol: float = 1e-8, steps: int = 11) -> tuple[float, float]:
    """(x, value) of the lowest point that Newton's method finds from the starts, the first among equals.

    If no start leads to a minimum that is finite and not above the value at 0, the exact real zeros of the slope decide;
    0 itself is the last resort.
    """
    second = derivative(derivative(c))
    good = [(horner(c, x), n, x) for n, x in enumerate(newton(c, s, tol, steps) for s in starts) if np.isfinite(x) and horner(second, x) >= 0]
    value, _, x = min(good, default=(float("inf"), 0, 0.0))
    if value <= c[0]:
        return x, value
    trimmed = np.trim_zeros(np.array(derivative(c)[::-1], float), "f")
    zeros = np.roots(trimmed) if len(trimmed) > 1 else np.zeros(0)
    real = [(horner(c, z), z) for z in zeros[np.abs(zeros.imag) <= 1e-9 * (1 + np.abs(zeros))].real.tolist()]
    value, x = min([*real, (c[0], 0.0)])
    return x, value
