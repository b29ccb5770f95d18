"""Singular values and right singular vectors of a small triangular matrix.

Householder reflections make it bidiagonal, differential quotient-difference steps with shifts
(dqds) find its squared singular values to high relative accuracy, and a twisted factorisation
gives the vector of each of the largest. The matrix has the size of the model (columns by columns),
never that of the data.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
TINY = np.finfo(float).tiny


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and superdiagonal of U' r V, and the reflections that make up V.

    ``back`` turns right singular vectors of the bidiagonal matrix into those of ``r``.
    """
    a = np.array(r, float)
    n = len(a)
    reflections = []

    def reflector(x: np.ndarray) -> np.ndarray:
        """Unit v with (I - 2 v v') x along the first axis; zero if x is there already."""
        v = x.copy()
        if not np.any(v[1:]):
            return np.zeros_like(v)
        v /= np.abs(v).max()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 1:
            v = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            reflections.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def back(z: np.ndarray, reflections: list[np.ndarray]) -> np.ndarray:
    """V z: the vector in the coordinates of the matrix that was made bidiagonal."""
    z = z.copy()
    for v in reversed(reflections):
        part = z[len(z) - len(v):]
        part -= 2 * v * (v @ part)
    return z


def _dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """One step: the factors of the matrix less ``shift``, or None if that isn't positive."""
    n = len(q)
    new_q, new_e = np.empty(n), np.empty(max(n - 1, 0))
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0:
            return None
        new_q[i] = d + e[i]
        if new_q[i] == 0:
            # Nothing links this place to the next.
            new_e[i] = 0.0
            d = q[i + 1] - shift
            continue
        ratio = q[i + 1] / new_q[i]
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
    if d < 0:
        return None
    new_q[n - 1] = d
    return new_q, new_e


def dqds_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, largest first.

    Shifts never exceed the smallest value left: one that does gives a negative term, and the step
    is taken again with a smaller one. Without shift it always succeeds.
    """
    q, e = np.square(diagonal), np.square(above)
    values, moved = [], 0.0
    scale = q.max(initial=0.0) + e.max(initial=0.0)
    while len(q):
        n = len(q)
        if n > 1 and q[0] < q[-1]:
            # Graded the wrong way round; read from its other end it has the same values.
            q, e = q[::-1].copy(), e[::-1].copy()
        least = q[-1]
        for _ in range(40 * n + 400):
            if n == 1 or e[-1] <= (EPS * EPS) * (moved + q[-1]) or e[-1] <= TINY * max(scale, 1):
                break
            shift = _shift(q, e)
            step = None
            while step is None:
                step = _dqds(q, e, shift)
                if step is None:
                    shift = shift / 4 if shift > EPS * least else 0.0
            q, e = step
            moved += shift
            least = q[-1]
        values.append(moved + q[-1])
        q, e = q[:-1], e[:-1]
    return np.sort(np.array(values))[::-1]


def _shift(q: np.ndarray, e: np.ndarray) -> float:
    """A guess, mostly from below, of the smallest value: that of the last two places."""
    a, b, c = q[-2] + (e[-3] if len(e) > 2 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
    half = (a - b) / 2
    root = np.hypot(half, np.sqrt(c))
    low = b - c / (abs(half) + root) if half > 0 else min(a, b) - root
    return max(0.0, low * (1 - 4 * EPS)) if np.isfinite(low) else 0.0


def _twisted(q: np.ndarray, lower: np.ndarray, value: float) -> tuple[np.ndarray, ...]:
    """Factors of L D L' - value from both ends and the diagonal terms where they meet."""
    n = len(q)
    floor = TINY / EPS

    def safe(x: float) -> float:
        return x if abs(x) > floor else floor

    s, up = np.empty(n), np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        up[i] = q[i] * lower[i] / safe(s[i] + q[i])
        s[i + 1] = up[i] * lower[i] * s[i] - value
    p, down = np.empty(n), np.empty(max(n - 1, 0))
    p[n - 1] = q[n - 1] - value
    for i in range(n - 2, -1, -1):
        t = q[i] / safe(q[i] * lower[i] * lower[i] + p[i + 1])
        down[i] = lower[i] * t
        p[i] = p[i + 1] * t - value
    return up, down, s + p + value


def _vector(up: np.ndarray, down: np.ndarray, at: int) -> np.ndarray:
    """The solution that is 1 where the factors meet, at unit length."""
    n = len(up) + 1
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -down[i] * z[i]
        if not np.isfinite(z[i + 1]):
            z[i + 1] = 0.0
    z[~np.isfinite(z)] = 0.0
    return z / np.linalg.norm(z)


def leading_vectors(diagonal: np.ndarray, above: np.ndarray,
                    values: np.ndarray) -> np.ndarray:
    """Orthonormal right singular vectors (rows) of a bidiagonal matrix for its largest values.

    For a simple value the factors meet where the term on the diagonal is least. Equal or nearly
    equal values would all meet there; each later one takes the place of the least term whose
    vector is new, made orthogonal to the earlier ones. Where no such vector solves the equation
    to rounding, inverse iteration beside the earlier ones does.
    """
    if not len(values):
        return np.zeros((0, len(diagonal)))
    size = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    a = np.where(np.abs(diagonal) > EPS * EPS * size, diagonal, EPS * EPS * size)
    q, lower = np.square(a), above / a[:-1]
    rows: list[np.ndarray] = []
    for k, value in enumerate(values):
        up, down, meet = _twisted(q, lower, value)
        near = [rows[j] for j in range(k) if values[j] - value <= 1e-6 * values[0]]
        best = None
        for at in np.argsort(np.abs(meet))[:4 * (len(near) + 1)]:
            z = _vector(up, down, int(at))
            # What the matrix less its value leaves of z.
            rest = abs(meet[at] * z[at])
            z = _without(z, near)
            length = np.linalg.norm(z)
            if length > 0.1 and rest <= 64 * len(q) * EPS * values[0] * length:
                best = z / length
                break
        if best is None:
            best = _by_iteration(q, lower, value, rows)
        best = _without(best, rows)
        rows.append(best / np.linalg.norm(best))
    return np.array(rows).reshape(len(values), len(diagonal))


def _without(z: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """z less its parts along ``rows``; twice, since once leaves rounding."""
    for _ in range(2):
        for r in rows:
            z = z - r * (r @ z)
    return z


def _by_iteration(q: np.ndarray, lower: np.ndarray, value: float,
                  rows: list[np.ndarray]) -> np.ndarray:
    """Inverse iteration among the vectors orthogonal to ``rows``, for ties that nothing splits."""
    n = len(q)
    link = q[:-1] * lower
    full = (np.diag(q + np.append(0.0, link * lower)) + np.diag(link, 1) + np.diag(link, -1))
    shifted = full - (value + 8 * EPS * max(value, TINY / EPS)) * np.eye(n)
    z = _without(np.cos(np.arange(n) * 1.7 + 0.3), rows)
    for _ in range(6):
        z = _without(z / np.linalg.norm(z), rows)
        try:
            z = _without(np.linalg.solve(shifted, z), rows)
        except np.linalg.LinAlgError:
            shifted -= EPS * np.abs(full).max() * np.eye(n)
    return z / np.linalg.norm(z)
