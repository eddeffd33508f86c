"""Sparse features of texts and pages, and small linear models on them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from sparkloom.llm import words as W

#: A sparse vector: places, ascending, and values.
Sparse = tuple[np.ndarray, np.ndarray]


def unit(at: np.ndarray, n: np.ndarray) -> Sparse:
    """1 + log of counts, scaled to length 1."""
    x = 1 + np.log(n) if len(n) else np.zeros(0)
    return at.astype(np.int64), x / max(1e-12, float(np.sqrt(x @ x)))


def words(texts: pa.Array, dims: int, prefixes: tuple[int, ...] = (5, 7)) -> list[Sparse]:
    """Whether each text has hashed features: its words, A-Z in lower case and without ASCII punctuation, and
    the beginnings of longer words, so that words of one stem share some. Values are 1."""
    data, offs = W.text_buffers(texts)
    data, out, lo = _BLANK[data], [], 0
    while lo < len(offs) - 1:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + W.CHUNK_BYTES, "right")) - 1)
        part, at = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        start, stop = W.word_spans(part, at)
        rows, keys = [np.searchsorted(at, start, "right") - 1], [W.hash_spans(part, start, stop, True)]
        for k in prefixes:
            long = stop - start > k
            rows.append(rows[0][long])
            keys.append(W.mix(W.hash_spans(part, start[long], start[long] + k, True) + W.U64(k)))
        both = np.unique((np.concatenate(rows) << 32) + ((np.concatenate(keys) >> W.U64(32)) % W.U64(dims)).astype(np.int64))
        edge = np.searchsorted(both, np.arange(hi - lo + 1) << 32)
        place = (both & 0xFFFFFFFF).astype(np.int32)
        out += [(place[a:b], np.ones(b - a, np.float32)) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        lo = hi
    return out


#: ASCII punctuation but ' and - counts as space.
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[*range(0x21, 0x27), *range(0x28, 0x2D), 0x2E, 0x2F, *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 0x20


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def adagrad(rows: list[Sparse], dims: int, slope: Callable[[int, float], float], epochs: int, rate: float, l2: float, seed: int) -> np.ndarray:
    """Weights by AdaGrad steps, a row at a time in seeded order. slope(i, score) is the loss's derivative by
    row i's score; it may hold and move parameters of its own."""
    w, g2, rng = np.zeros(dims), np.full(dims, 1e-8), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            at, x = rows[i]
            g = slope(i, float(x @ w[at])) * x + l2 * w[at]
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
    return w


def logistic(rows: list[Sparse], labels: np.ndarray, dims: int, epochs: int = 4, rate: float = 0.5, l2: float = 1e-6, seed: int = 7) -> np.ndarray:
    """Weights of a logistic regression; labels 0 or 1, classes weighted evenly. The intercept is a feature."""
    share = max(1e-9, float(labels.mean()))
    weight = np.where(labels > 0, 0.5 / share, 0.5 / max(1e-9, 1 - share))
    return adagrad(rows, dims, lambda i, z: float(weight[i] * (sigmoid(z) - labels[i])), epochs, rate, l2, seed)


def scores(rows: list[Sparse], w: np.ndarray) -> np.ndarray:
    return np.array([float(x @ w[at]) for at, x in rows])


def platt(score: np.ndarray, label: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """a, b so that sigmoid(a * score + b) is calibrated: Newton steps on the log loss with smoothed targets."""
    if len(score) == 0:
        return 1.0, 0.0
    pos = float(label.sum())
    neg = len(label) - pos
    y = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, t = np.stack([score, np.ones_like(score)], 1), np.zeros(2)
    for _ in range(steps):
        p = sigmoid(x @ t)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (p - y))
        t -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(t[0]), float(t[1])
