"""Hashed byte n-gram features, and small linear models fitted with numpy on bounded samples."""

from __future__ import annotations

import numpy as np

#: Buckets of the hashed n-grams and the orders used.
BUCKETS = 4096
ORDERS = (2, 3)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and the capitals of the Latin-1 letters in UTF-8."""
    out = _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    if len(lead):
        tail = data[lead + 1]
        out[lead[(tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] + 1] += 0x20
    return out


def letters_only(data: np.ndarray) -> np.ndarray:
    """Anything ASCII but a letter becomes a space."""
    out = data.copy()
    out[(out < 97) | (out > 122) & (out < 128)] = 32
    return out


def gram_buckets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the n-grams of all orders, text by text; their bounds). N-grams don't cross texts."""
    n = len(data)
    wide = data.astype(np.uint32)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    parts, owners = [], []
    for k in ORDERS:
        m = n - k + 1
        if m <= 0:
            continue
        code = np.full(m, k, np.uint32)
        for i in range(k):
            code = code * np.uint32(0x01000193) ^ wide[i:i + m]
        code *= np.uint32(0x9E3779B1)
        same = text[:m] == text[k - 1:k - 1 + m]
        parts.append((code >> np.uint32(20)).astype(np.int64)[same])
        owners.append(text[:m][same])
    if not parts:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    counts = np.zeros(len(bounds) - 1, np.int64)
    for o in owners:
        counts += np.bincount(o, minlength=len(counts))
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(ends[-1], np.int64)
    at = ends[:-1].copy()
    for p, o in zip(parts, owners, strict=True):
        per = np.bincount(o, minlength=len(counts))
        first = np.cumsum(per) - per
        out[at[o] + np.arange(len(o)) - first[o]] = p
        at += per
    return out, ends


def sum_weights(weights: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean weight of each text's n-grams for each column of ``weights`` (BUCKETS x columns)."""
    total = np.zeros((len(bounds) - 1, weights.shape[1]))
    counts = np.zeros(len(bounds) - 1)
    n = len(data)
    wide = data.astype(np.uint32)
    lengths = np.diff(bounds)
    for k in ORDERS:
        m = n - k + 1
        has = np.flatnonzero(lengths >= k)
        if m <= 0 or not len(has):
            continue
        code = np.full(m, k, np.uint32)
        for i in range(k):
            code = code * np.uint32(0x01000193) ^ wide[i:i + m]
        code = ((code * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
        edges = np.stack([bounds[has], bounds[has + 1] - k + 1], 1).ravel()
        edges = edges[:-1] if edges[-1] >= m else edges
        for c in range(weights.shape[1]):
            total[has, c] += np.add.reduceat(weights[:, c][code], edges)[::2]
        counts[has] += lengths[has] - k + 1
    return total / np.maximum(counts, 1)[:, None]


def count_matrix(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Shares of the buckets, one row for each text."""
    grams, ends = gram_buckets(data, bounds)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(ends))
    flat = np.bincount(rows * BUCKETS + grams, minlength=(len(bounds) - 1) * BUCKETS).reshape(-1, BUCKETS)
    return (flat / np.maximum(np.diff(ends), 1)[:, None]).astype(np.float32)


def scale_of(x: np.ndarray) -> np.ndarray:
    return (1 / np.sqrt(x.mean(0) + 1e-5)).astype(np.float32)


def _fit(x: np.ndarray, y: np.ndarray, slope, ridge: float, steps: int, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the mean of a convex margin loss; ``slope``: its derivative by the margin."""
    n, d = x.shape
    w, b = np.zeros(d, np.float32), 0.0
    u, c = w.copy(), b
    power = np.random.default_rng(0).normal(size=d).astype(np.float32)
    for _ in range(8):
        power = x.T @ (x @ (power / np.linalg.norm(power)))
    rate = 1 / (2 * float(weight.max()) * (np.linalg.norm(power) / n + 1) + ridge)
    for t in range(1, steps + 1):
        g = (slope(y * (x @ u + c)) * y * weight / n).astype(np.float32)
        w2, b2 = u - rate * (x.T @ g + ridge * u), c - rate * float(g.sum())
        m = (t - 1) / (t + 2)
        u, c, w, b = w2 + m * (w2 - w), b2 + m * (b2 - b), w2, b2
    return w, b


def _balance(y: np.ndarray) -> np.ndarray:
    out = np.ones(len(y))
    for v in (-1, 1):
        if (y == v).any():
            out[y == v] = len(y) / (2 * (y == v).sum())
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss; ``y`` is -1 or 1."""
    return _fit(x, y, lambda m: -2 * np.maximum(0, 1 - m), ridge, steps, _balance(y))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    return _fit(x, y, lambda m: -1 / (1 + np.exp(np.minimum(m, 30))), ridge, steps, np.ones(len(y)))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's scale and shift with his smoothed targets, by Newton steps."""
    good, bad = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * margin + b)
        g = np.array([((p - t) * margin).sum() + 1e-3 * (a - 1), (p - t).sum()])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * margin * margin).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1, 2 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
    return float(a), float(b)
