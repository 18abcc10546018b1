"""Small numerical parts of the classifiers: sparse logistic regression by L-BFGS."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0)))


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, keep: int = 8) -> np.ndarray:
    """Minimise a smooth function that returns its value and gradient."""
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, alphas = -g, []
        for s, y, rho in reversed(steps):
            alphas.append(a := rho * (s @ d))
            d = d - a * y
        if steps:
            s, y, _rho = steps[-1]
            d = d * (s @ y) / max(y @ y, 1e-300)
        for (s, y, rho), a in zip(steps, reversed(alphas), strict=True):
            d = d + s * (a - rho * (y @ d))
        slope = g @ d
        if slope >= 0 or np.abs(g).max() < 1e-7:
            break
        t = 1.0 if steps else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        for _try in range(25):
            new = x + t * d
            v2, g2 = f(new)
            if v2 <= value + 1e-4 * t * slope:
                break
            t *= 0.5
        else:
            break
        s, y = new - x, g2 - g
        if s @ y > 1e-12:
            steps = [*steps[-keep + 1 :], (s, y, 1.0 / (s @ y))]
        done = value - v2 < 1e-9 * max(1.0, abs(value))
        x, value, g = new, v2, g2
        if done:
            break
    return x


class Rows:
    """Rows of a binary matrix, each held as its column numbers or, if those take more room, as one bit a column.

    So a row takes at most ``n_columns / 8`` bytes, and a block of rows at a time is spelled out.
    """

    def __init__(self, rows: list[bytes], n_columns: int, block: int = 1 << 20) -> None:
        self.rows, self.n_columns = rows, n_columns
        self.packed_size = -(-n_columns // 8)
        self.lens = np.array([int(np.bitwise_count(np.frombuffer(r, np.uint8)).sum()) if len(r) == self.packed_size else len(r) // 4 for r in rows], np.int64)
        ends = np.concatenate([[0], np.cumsum(self.lens)])
        self.cuts = [0]
        while self.cuts[-1] < len(rows):
            at = self.cuts[-1]
            self.cuts.append(max(at + 1, int(np.searchsorted(ends, ends[at] + block, "right")) - 1))

    @staticmethod
    def pack(columns: np.ndarray, n_columns: int) -> bytes:
        if 4 * len(columns) < -(-n_columns // 8):
            return columns.astype(np.uint32).tobytes()
        flags = np.zeros(n_columns, np.uint8)
        flags[columns] = 1
        return np.packbits(flags).tobytes()

    def blocks(self):  # noqa: ANN201
        """(first row, end, column numbers one row after another, starts of the rows)."""
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            parts = [np.flatnonzero(np.unpackbits(np.frombuffer(r, np.uint8), count=self.n_columns)).astype(np.uint32) if len(r) == self.packed_size else np.frombuffer(r, np.uint32) for r in self.rows[a:b]]
            yield a, b, np.concatenate(parts), np.concatenate([[0], np.cumsum(self.lens[a : b - 1])])


def fit_sparse_logistic(rows: Rows, scale: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on binary rows whose columns are multiplied by ``scale``."""
    total, n_columns = weight.sum(), rows.n_columns

    def f(w: np.ndarray) -> tuple[float, np.ndarray]:
        scaled, loss, g = w[:-1] * scale, 0.0, np.zeros(n_columns + 1)
        for a, b, ids, starts in rows.blocks():
            z, lens = np.full(b - a, w[-1]), rows.lens[a:b]
            if len(ids):
                z[lens > 0] += np.add.reduceat(scaled[ids], starts[lens > 0])
            loss += (weight[a:b] * (np.logaddexp(0, z) - y[a:b] * z)).sum() / total
            e = weight[a:b] * (sigmoid(z) - y[a:b]) / total
            g[:-1] += np.bincount(ids, np.repeat(e, lens), n_columns)
            g[-1] += e.sum()
        g[:-1] = g[:-1] * scale + l2 * w[:-1]
        return loss + 0.5 * l2 * (w[:-1] @ w[:-1]), g

    w = lbfgs(f, np.zeros(n_columns + 1), rounds)
    return w[:-1], float(w[-1])
