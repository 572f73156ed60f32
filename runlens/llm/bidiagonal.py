"""Singular values and right singular vectors of a small matrix, accurate to the last
digits of each: pivoted Householder QR finds the rank, Householder reflections make the
rest bidiagonal, the differential qd algorithm with shifts (dqds) finds the squared
singular values, and twisted factorisations of the bidiagonal's LDL' form find the
vectors.

The matrix is what a blockwise QR of any number of rows leaves, so its size is the
rows' dimension; everything here is plain arithmetic on it.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
TINY = np.finfo(float).tiny
#: Relative distance of squared singular values under which vectors are made orthogonal one to the other.
CLOSE = 1e-5


def reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """``v, beta, alpha`` with (I - beta v v') x = alpha e1."""
    norm = float(np.linalg.norm(x))
    if norm == 0.0:
        return np.zeros_like(x), 0.0, 0.0
    alpha = -norm if x[0] >= 0 else norm
    v = x.copy()
    v[0] -= alpha
    return v, 2.0 / float(v @ v), alpha


def pivoted(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper trapezoid (rank rows) of a QR with column pivoting, and the columns' order."""
    a = a.copy()
    m, n = a.shape
    order = np.arange(n)
    limit = max(m, n) * EPS * float(np.sqrt((a * a).sum(axis=0)).max(initial=0.0))
    for k in range(min(m, n)):
        norms = np.sqrt((a[k:, k:] ** 2).sum(axis=0))
        j = k + int(norms.argmax())
        if norms[j - k] <= limit:
            return a[:k], order
        a[:, [k, j]] = a[:, [j, k]]
        order[[k, j]] = order[[j, k]]
        v, beta, alpha = reflector(a[k:, k])
        a[k:, k:] -= np.outer(beta * v, v @ a[k:, k:])
        a[k + 1:, k], a[k, k] = 0.0, alpha
    return a[:min(m, n)], order


def bidiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of U' a V for square ``a``, and V."""
    a = a.copy()
    n = len(a)
    right = np.eye(n)
    for k in range(n):
        v, beta, alpha = reflector(a[k:, k])
        a[k:, k:] -= np.outer(beta * v, v @ a[k:, k:])
        a[k:, k] = 0.0
        a[k, k] = alpha
        if k < n - 2:
            v, beta, alpha = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= np.outer(a[k:, k + 1:] @ v, beta * v)
            a[k, k + 1:] = 0.0
            a[k, k + 1] = alpha
            right[:, k + 1:] -= np.outer(right[:, k + 1:] @ v, beta * v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float], float] | None:
    """One dqds transform with the d's it met; None if the shift was too large."""
    qq, ee, ds, d = [], [], [], q[0] - shift
    for k in range(len(e)):
        if d < 0.0:
            return None
        ds.append(d)
        now = d + e[k]
        ratio = q[k + 1] / now if now > 0.0 else 0.0
        qq.append(now)
        ee.append(e[k] * ratio)
        d = d * ratio - shift
    if d < 0.0:
        return None
    ds.append(d)
    return [*qq, d], ee, ds, shift


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling."""
    out: list[float] = []
    todo = [((diagonal * diagonal).tolist(), (above * above).tolist(), 0.0)]
    while todo:
        q, e, base = todo.pop()
        rounds = 0
        while q:
            if len(q) == 1:
                out.append(q[0] + base)
                break
            # a negligible coupling splits the matrix; the last one gives a value
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= EPS * EPS * (q[k + 1] + base) or e[k] <= TINY), None)
            if cut is not None:
                if cut == len(e) - 1:
                    out.append(q.pop() + base)
                    e.pop()
                else:
                    todo.append((q[:cut + 1], e[:cut], base))
                    q, e = q[cut + 1:], e[cut + 1:]
                continue
            # of the unshifted transform, 1 / d is the diagonal of the inverse: the least value lies
            # between 1 / sum(1 / d), Newton's step, and the least d
            made = _step(q, e, 0.0)
            ds = made[2]
            safe = 1.0 / sum(1.0 / d for d in ds) if min(ds) > 0.0 else 0.0
            a, b, c = q[-2] + e[-2] if len(e) > 1 else q[-2], q[-1] + e[-1], q[-2] * e[-1]
            low = (a * b - c) / ((a + b) / 2 + float(np.sqrt(((a - b) / 2) ** 2 + c)))
            shift = safe * (1 - 4 * EPS * len(q))
            bold = low * (1 - 1e-2) if safe < low * (1 - 1e-2) < min(ds) else 0.0
            if shift > 0.0:
                made = (bold and _step(q, e, bold)) or _step(q, e, shift) or made
            q, e, ds, shift = made
            base += shift
            rounds += 1
            if rounds > 1000 * (len(e) + 1):
                raise ArithmeticError("dqds does not converge")
    return np.sort(np.array(out))[::-1]


def twisted(d: np.ndarray, low: np.ndarray, value: float) -> np.ndarray:
    """The unit eigenvector of L D L' (unit lower bidiagonal L) for an eigenvalue, from the
    twisted factorisation whose twist has the least remainder."""
    n = len(d)
    down, s = np.zeros(n), np.full(n, -value)
    up, p = np.zeros(n), np.full(n, d[-1] - value)
    for k in range(n - 1):
        pivot = s[k] + d[k]
        pivot = pivot if pivot != 0.0 else EPS * max(value, TINY)
        down[k] = d[k] * low[k] / pivot
        s[k + 1] = down[k] * low[k] * s[k] - value
    for k in range(n - 2, -1, -1):
        pivot = d[k] * low[k] * low[k] + p[k + 1]
        pivot = pivot if pivot != 0.0 else EPS * max(value, TINY)
        ratio = d[k] / pivot
        up[k] = low[k] * ratio
        p[k] = p[k + 1] * ratio - value
    r = int(np.abs(s + p + value).argmin())
    z = np.zeros(n)
    z[r] = 1.0
    for k in range(r - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(r, n - 1):
        z[k + 1] = -up[k] * z[k]
    return z / np.linalg.norm(z)


def _apart(z: np.ndarray, before: list[np.ndarray], d: np.ndarray, low: np.ndarray, value: float) -> np.ndarray:
    """``z`` made orthogonal to the vectors of close values; where little is left of it,
    another vector of the same space by inverse iteration."""
    for attempt in range(len(z) + 1):
        w = z.copy()
        for _ in range(2):
            for x in before:
                w -= (x @ w) * x
        size = float(np.linalg.norm(w))
        if size > 1e-3:
            return w / size
        w = np.cos(np.arange(len(z)) * (attempt + 1.0) + 1.0)
        t = np.diag(d + np.concatenate([[0.0], d[:-1] * low * low])) + np.diag(d[:-1] * low, 1) + np.diag(d[:-1] * low, -1)
        t -= (value * (1 + 64 * EPS)) * np.eye(len(z))
        for _ in range(3):
            for x in before:
                w -= (x @ w) * x
            w = np.linalg.solve(t, w)
            w /= np.linalg.norm(w)
        z = w
    raise ArithmeticError("no further vector for a repeated singular value")


def _block_vectors(diagonal: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values (falling) and vectors (columns) of an unreduced block."""
    values = dqds(diagonal, above)
    d, low = diagonal * diagonal, above / diagonal[:-1]
    vectors: list[np.ndarray] = []
    for i, value in enumerate(values):
        z = twisted(d, low, value)
        near = [vectors[j] for j in range(i) if values[j] - value <= CLOSE * values[j]]
        vectors.append(_apart(z, near, d, low, value) if near else z)
    return values, np.column_stack(vectors)


def principal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of ``a`` (falling, as many as its rank) and the matching
    unit right singular vectors as columns."""
    r, order = pivoted(a)
    rank = len(r)
    n = a.shape[1]
    if not rank:
        return np.zeros(0), np.zeros((n, 0))
    # r = square' basis', with orthonormal basis columns
    basis, square = np.linalg.qr(r.T)
    diagonal, above, right = bidiagonal(np.ascontiguousarray(square.T))
    values, vectors = np.zeros(rank), np.zeros((rank, rank))
    weak = np.abs(above) <= 8 * EPS * np.sqrt(np.abs(diagonal[:-1]) * np.abs(diagonal[1:]))
    cuts = [0, *(np.flatnonzero(weak) + 1), rank]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        values[lo:hi], vectors[lo:hi, lo:hi] = _block_vectors(diagonal[lo:hi], above[lo:hi - 1])
    by = np.argsort(-values, kind="stable")
    found = np.zeros((n, rank))
    found[order] = basis @ right @ vectors[:, by]
    return values[by], found
