"""Hashed features of texts and softmax regression on them, in numpy."""

from __future__ import annotations

import numpy as np

from quillspan.llm import textbuf

DIM = 1 << 16
_SHAPES = 64


def presence(words: textbuf.Words, rows: int, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature, each pair once and sorted: hashed words and their leading bytes."""
    row = words.row()
    both = [(row << 32) | (h >> np.uint64(48)).astype(np.int64) for h in (words.hash, *(words.prefix[p] for p in prefixes))]
    pairs = np.unique(np.concatenate(both)) if len(row) else np.zeros(0, np.int64)
    return pairs >> 32, (pairs & 0xFFFFFFFF) + _SHAPES


def shapes(offsets: np.ndarray, data: np.ndarray, words: textbuf.Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature for a text's shares of capitals, digits, symbols and distinct words, in eighths."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    is_letter = (data >= 128) | ((data | 32) >= 97) & ((data | 32) <= 122)
    marks = [(data >= 65) & (data <= 90), (data >= 48) & (data <= 57), (data > 32) & ~is_letter & ~((data >= 48) & (data <= 57))]
    out = []
    for i, mark in enumerate(marks):
        share = np.diff(np.concatenate([[0], np.cumsum(mark)])[offsets]) / size
        out.append(i * 9 + np.minimum(8, np.ceil(share * 12)).astype(np.int64))
    pairs = np.unique((words.row() << 32) | (words.hash >> np.uint64(32)).astype(np.int64))
    distinct = np.bincount(pairs >> 32, minlength=n) / np.maximum(np.diff(words.first), 1)
    out.append(27 + np.minimum(8, np.floor(distinct * 9)).astype(np.int64))
    row = np.tile(np.arange(n), len(out))
    return row, np.concatenate(out)


def join(n: int, *parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (n + 1) and features of all parts, by row."""
    row = np.concatenate([p[0] for p in parts])
    feature = np.concatenate([p[1] for p in parts])
    order = np.argsort(row, kind="stable")
    return np.searchsorted(row[order], np.arange(n + 1)), feature[order]


def scores(bounds: np.ndarray, feature: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logits (rows, classes); the last row of ``weights`` is the bias."""
    out = np.tile(weights[-1], (len(bounds) - 1, 1)).astype(np.float64)
    some = np.diff(bounds) > 0
    if some.any():
        out[some] += np.add.reduceat(weights[feature], bounds[:-1][some], axis=0)
    return out


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(bounds: np.ndarray, feature: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None, dim: int = DIM + _SHAPES, steps: int = 120, l2: float = 2e-4, rate: float = 0.05) -> np.ndarray:
    """Softmax regression by full-batch Adam; ``target`` (rows, classes) may be soft. Weights of shape (dim + 1, classes)."""
    n, k = target.shape
    w = np.zeros((dim + 1, k), np.float32)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    row = np.repeat(np.arange(n), np.diff(bounds))
    share = np.ones(n) if weight is None else weight
    share = (share / share.sum())[:, None]
    for step in range(1, steps + 1):
        d = (softmax(scores(bounds, feature, w)) - target) * share
        g = np.empty_like(w)
        for c in range(k):
            g[:-1, c] = np.bincount(feature, d[row, c], minlength=dim)
        g[-1] = d.sum(0)
        g[:-1] += l2 * w[:-1]
        m1 += 0.1 * (g - m1)
        m2 += 0.01 * (g * g - m2)
        w -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return w
