"""Cumulative-link ordinal regression on sparse hashed features."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Rows:
    """Sparse rows of features, each counted as often as it occurs, scaled by the root of their length; rows shorter than
    `SHORT` count as that long."""

    SHORT = 40
    CHUNK = 20_000

    def __init__(self, rows: list[np.ndarray], joined: bool = False):
        """With `joined` the rows are joined once, for many passes over them; else chunk by chunk in every pass."""
        self.rows = rows
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.scale = 1 / np.sqrt(np.maximum(self.lengths, self.SHORT))
        self.joined = None
        if joined:
            self.joined = list(self._chunks())

    def _chunks(self):
        if self.joined is not None:
            yield from self.joined
            return
        for at in range(0, len(self.rows), self.CHUNK):
            part = slice(at, at + self.CHUNK)
            yield part, np.concatenate(self.rows[part])

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.rows))
        for part, index in self._chunks():
            lengths = self.lengths[part]
            if len(index):
                sums = np.add.reduceat(np.r_[w[index], 0.0], np.r_[0, np.cumsum(lengths)[:-1]])
                out[part] = np.where(lengths > 0, sums, 0.0) * self.scale[part]
        return out

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for part, index in self._chunks():
            out += np.bincount(index, np.repeat((g * self.scale)[part], self.lengths[part]), minlength=size)
        return out


class OrdinalModel:
    """P(grade >= k) = sigmoid(w x - cut_k): one weight vector for all thresholds, which rise with the grade."""

    def __init__(self, size: int, grades: int):
        self.w, self.cuts = np.zeros(size), np.arange(grades - 1, dtype=float)

    def fit(self, x: Rows, grade: np.ndarray, weight: np.ndarray, l2: float = 1e-5, rounds: int = 120, rate: float = 0.2) -> "OrdinalModel":
        """Weighted maximum likelihood by Adam over all rows, from the weights as they are; deterministic."""
        n, size = weight.sum(), len(self.w)
        if not self.w.any():
            for k in range(len(self.cuts)):
                share = np.clip((weight * (grade > k)).sum() / n, 1e-4, 1 - 1e-4)
                self.cuts[k] = max(-np.log(share / (1 - share)), self.cuts[k - 1] + 0.1 if k else -35)
        m, v = np.zeros(size + len(self.cuts)), np.zeros(size + len(self.cuts))
        for t in range(1, rounds + 1):
            z = x.dot(self.w)
            bounds = np.r_[-np.inf, self.cuts, np.inf]
            # P = F(upper - z) - F(lower - z) for the logistic F, so d log P / dz = F(upper - z) + F(lower - z) - 1.
            up, low = sigmoid(bounds[grade + 1] - z), sigmoid(bounds[grade] - z)
            gz = weight * (up + low - 1)
            gap = np.maximum(up - low, 1e-12)
            g_cut = np.array([(weight * ((grade == k) * up * (1 - up) - (grade == k + 1) * low * (1 - low)) / gap).sum() for k in range(len(self.cuts))])
            g = np.r_[x.back(gz, size) / n - l2 * self.w, g_cut / n]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            self.w += step[:size]
            self.cuts = np.sort(self.cuts + 0.2 * step[size:])
        return self

    def severity(self, z: np.ndarray) -> np.ndarray:
        """Expected grade."""
        return sigmoid(z[:, None] - self.cuts[None, :]).sum(1)

    def at_least_one(self, z: np.ndarray) -> np.ndarray:
        return sigmoid(z - self.cuts[0])
