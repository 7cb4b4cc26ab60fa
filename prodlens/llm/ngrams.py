"""Hashed byte n-gram features of whole texts, and small dense models over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import LOWER, buffers, pieces

DIM = 2048

#: Letters stay, in lower case; all other bytes count as a space.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = LOWER[97:123]
LETTERS[65:91] = LOWER[65:91]
LETTERS[128:] = np.arange(128, 256)


def counts(texts: pa.Array, table: np.ndarray = LETTERS, dim: int = DIM) -> np.ndarray:
    """A row for each text: how often each hashed 1-, 2- and 3-gram of its bytes, as the table maps them, occurs."""
    data, at = buffers(texts)
    out = np.zeros((len(at) - 1, dim), np.float32)
    for lo, hi in pieces(data, at, 1 << 18):
        part = at[lo : hi + 1] - at[lo]
        low = table[data[at[lo] : at[hi]]].astype(np.uint32)
        doc = np.repeat(np.arange(hi - lo), np.diff(part))
        left = part[1:][doc] - np.arange(len(low))
        key = np.zeros(len(low), np.uint32)
        total = np.zeros((hi - lo) * dim, np.int64)
        for n in (1, 2, 3):
            key[: len(low) - n + 1] = key[: len(low) - n + 1] * np.uint32(257) + low[n - 1 :]
            whole = left >= n
            where = doc[whole] * dim + ((key[whole] + np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(8)) % np.uint32(dim)
            total += np.bincount(where, minlength=(hi - lo) * dim)
        out[lo:hi] = total.reshape(hi - lo, dim)
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Square roots of counts, each row of length 1."""
    x = np.sqrt(x)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def ridge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float) -> np.ndarray:
    """Weighted least squares with a constant column: weights [d + 1, outputs]."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1).astype(np.float64)
    xw = x * weight[:, None]
    return np.linalg.solve(xw.T @ x + strength * np.eye(x.shape[1]), xw.T @ y)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, strength: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps (few columns) with a constant column: weights [d + 1]."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1).astype(np.float64)
    w, v = np.zeros(x.shape[1]), np.ones(len(x)) if weight is None else weight
    penalty = strength * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (v * (p - y)) + penalty @ w
        step = np.linalg.solve((x * (v * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def applied(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]
