"""Hashed text features and small linear models, fitted in numpy on bounded samples."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np

BITS = 18
#: Buckets in fewer training rows than this keep weight zero: rare words say nothing about other texts.
MIN_ROWS = 6
#: So do buckets whose share of the two classes' rows differs by less than so many standard errors.
MIN_Z = 4.0
WORDS = re.compile(r"[^\W\d_]+")


def word_features(text: str) -> np.ndarray:
    """Buckets of a text's distinct words and of their beginnings (4 and 5 letters), each once, in order: at most 2**BITS."""
    words = set(WORDS.findall(text.lower()))
    mask = (1 << BITS) - 1
    out = {zlib.crc32(w.encode()) & mask for w in words}
    out |= {zlib.crc32(b"^" + w[:n].encode()) & mask for n in (4, 5) for w in words if len(w) > n}
    return np.sort(np.fromiter(out, np.int64, len(out)))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Rows:
    """Rows of buckets, end to end: row i is ``buckets[ends[i - 1] : ends[i]]``."""

    buckets: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Rows:
        return cls(np.concatenate(rows) if rows else np.zeros(0, np.int64), np.cumsum([len(r) for r in rows], dtype=np.int64))

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(np.r_[0, self.ends])

    def __len__(self) -> int:
        return len(self.ends)

    def take(self, at: np.ndarray) -> Rows:
        size = self.sizes[at]
        ends = np.cumsum(size)
        return Rows(self.buckets[np.arange(int(size.sum())) + np.repeat(self.ends[at] - ends, size)], ends)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        upto = np.r_[0.0, np.cumsum(weights[self.buckets])]
        return upto[self.ends] - upto[self.ends - self.sizes]


def telling(rows: Rows, y: np.ndarray) -> np.ndarray:
    """Which buckets tell the classes apart."""
    size = 1 << BITS
    n, ones = np.bincount(rows.buckets, minlength=size), np.bincount(rows.buckets[np.repeat(y, rows.sizes) == 1], minlength=size)
    n_one, n_zero = max((y == 1).sum(), 1), max((y == 0).sum(), 1)
    share = n / len(y)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n_one + 1 / n_zero))
    return (n >= MIN_ROWS) & (np.abs(ones / n_one - (n - ones) / n_zero) >= MIN_Z * error)


class SparseLogistic:
    """Logistic regression on rows of buckets plus dense columns plus a given offset, by Adagrad; deterministic."""

    def __init__(self, dense: int = 0, l2: float = 1e-6):
        self.w, self.d, self.b, self.l2 = np.zeros(1 << BITS), np.zeros(dense), 0.0, l2

    def logit(self, rows: Rows, dense: np.ndarray) -> np.ndarray:
        return rows.sums(self.w) + dense @ self.d + self.b

    def fit(self, rows: Rows, dense: np.ndarray, y: np.ndarray, offset: np.ndarray | None = None, epochs: int = 12, rate: float = 0.3, batch: int = 64, seed: int = 1) -> SparseLogistic:
        if not len(y):
            self.b = -30.0  # nothing is known of the category, so nothing is in it
            return self
        rng = np.random.default_rng(seed)
        known = np.flatnonzero(telling(rows, y))
        place = np.full(1 << BITS, -1)
        place[known] = np.arange(len(known))
        at = place[rows.buckets]  # only buckets that are kept, numbered anew
        rows = Rows(at[at >= 0], np.r_[0, np.cumsum(at >= 0)][rows.ends])
        w, gw, gd, gb = np.zeros(len(known)), np.full(len(known), 1e-4), np.full(dense.shape[1], 1e-4), 1e-4
        if offset is None:
            share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
            self.b = float(np.log(share / (1 - share)))
        fixed = np.zeros(len(y)) if offset is None else offset
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for first in range(0, len(y), batch):
                part = order[first : first + batch]
                own, x = rows.take(part), dense[part]
                err = sigmoid(own.sums(w) + x @ self.d + self.b + fixed[part]) - y[part]
                g = np.bincount(own.buckets, np.repeat(err, own.sizes), len(known)) / len(part)
                g += self.l2 * w * (g != 0)
                gw += g * g
                w -= rate * g / np.sqrt(gw)
                g = x.T @ err / len(part) + self.l2 * self.d
                gd += g * g
                self.d -= rate * g / np.sqrt(gd)
                g = err.mean()
                gb += g * g
                self.b -= rate * g / np.sqrt(gb)
        self.w[known] = w
        return self
