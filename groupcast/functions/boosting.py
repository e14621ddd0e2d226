"""Histogram-grown regression trees over the windows of one shard (a numpy helper of operators/profiles.importance_gbt).

Squared error, second-order gains: a split of a node with gradient sum G and n sequences gains
(GL^2 / (nL + lam) + GR^2 / (nR + lam) - G^2 / (n + lam)) / 2. Features are cut into quantile bins, once per
feature and for all its lags; of equal gains the first position and lowest cut wins. A window's bins are read
from the binned rows, so windows cost one byte a value.
"""

from __future__ import annotations

import numpy as np

TREES, DEPTH, RATE, LAMBDA, BINS = 100, 6, 0.3, 1.0, 64


def quantile_edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cut points between bins: a value's bin is the number of cut points at or below it."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="lower"))


def _histogram(codes: np.ndarray, grad: np.ndarray, base: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per (position, bin): gradient sum and count of these sequences."""
    key = (codes + base).ravel()
    weights = np.broadcast_to(grad[:, None], codes.shape).ravel()
    return np.bincount(key, weights=weights, minlength=size), np.bincount(key, minlength=size).astype(np.float64)


def _best(hist_g: np.ndarray, hist_n: np.ndarray, dim: int, bins: int, lam: float) -> tuple[float, int, int]:
    """(gain, position, last bin on the left) of the best split."""
    g, n = hist_g.reshape(dim, bins), hist_n.reshape(dim, bins)
    left_g, left_n = np.cumsum(g, axis=1)[:, :-1], np.cumsum(n, axis=1)[:, :-1]
    total_g, total_n = g[0].sum(), n[0].sum()
    right_g, right_n = total_g - left_g, total_n - left_n
    gain = 0.5 * (left_g**2 / (left_n + lam) + right_g**2 / (right_n + lam) - total_g**2 / (total_n + lam))
    gain[(left_n < 1) | (right_n < 1)] = -np.inf
    at = int(np.argmax(gain))
    return float(gain.flat[at]), at // (bins - 1), at % (bins - 1)


def split_gains(blocks: list[tuple[np.ndarray, np.ndarray]], width: int, dim: int, trees: int = TREES, depth: int = DEPTH,
                rate: float = RATE, lam: float = LAMBDA, bins: int = BINS, least_gain: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Boosted trees on a shard's (x, y) blocks. Per window position: summed gain and number of its splits."""
    rows = np.concatenate([x.reshape(-1, width) for x, _ in blocks])
    binned = np.column_stack([np.searchsorted(quantile_edges(rows[:, f], bins), rows[:, f], "right") for f in range(width)]).astype(np.uint8)
    y = np.concatenate([t for _, t in blocks])
    first = np.concatenate([[0], np.cumsum([len(x) // width for x, _ in blocks])])
    place = np.concatenate([f + np.arange(len(t)) for f, (_, t) in zip(first, blocks, strict=False)])
    codes = np.lib.stride_tricks.sliding_window_view(binned.ravel(), dim)[::width][place]
    base = np.arange(dim, dtype=np.int64) * bins
    gain, count = np.zeros(dim), np.zeros(dim)
    margin = np.full(len(y), y.mean())
    for _ in range(trees):
        grad = margin - y
        everyone = np.arange(len(y))
        level = [(everyone, *_histogram(codes, grad, base, dim * bins))]
        grown = 0
        for d in range(depth):
            below = []
            for seqs, hist_g, hist_n in level:
                best, pos, cut = _best(hist_g, hist_n, dim, bins, lam) if len(seqs) > 1 else (0.0, 0, 0)
                if not best > least_gain:
                    margin[seqs] -= rate * grad[seqs].sum() / (len(seqs) + lam)
                    continue
                gain[pos] += best
                count[pos] += 1
                grown += 1
                goes = codes[seqs, pos] <= cut
                left, right = seqs[goes], seqs[~goes]
                if d + 1 == depth:
                    for part in (left, right):
                        margin[part] -= rate * grad[part].sum() / (len(part) + lam)
                    continue
                # The smaller child is counted, the other is what remains.
                small = left if len(left) <= len(right) else right
                hist = _histogram(codes[small], grad[small], base, dim * bins)
                rest = (hist_g - hist[0], hist_n - hist[1])
                below += [(left, *hist), (right, *rest)] if small is left else [(left, *rest), (right, *hist)]
            level = below
        if not grown:
            break
    return gain, count
