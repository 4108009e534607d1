"""Hashed n-gram features and logistic regression on a bounded sample, in numpy.

A text's features are the shares of its n-grams that fall into each bucket, by family (characters,
words, word pairs). A linear score is therefore a mean of bucket weights, which is computed for a whole
block of texts at once without building its features.
"""

from __future__ import annotations

import numpy as np

from signalmill.llm.common import SpanHash, mix, runs_of, spans, text_points

#: Buckets of a family, and families: character n-grams, words, word pairs.
BUCKETS, FAMILIES = 1 << 16, 3
CHAR_N = 3


def is_blank(points: np.ndarray) -> np.ndarray:
    """White space between words: U+0020 and U+0009 to U+000D."""
    return (points == 32) | ((points >= 9) & (points <= 13))


class Block:
    """N-grams of a block of texts: for each family the bucket of every n-gram and each text's first one."""

    def __init__(self, texts: list[str | None]):
        self.points, self.offsets = text_points(texts)
        self.n = len(texts)
        self.hash = SpanHash(self.points)
        self.word_start, self.word_end = spans(~is_blank(self.points), self.offsets[1:-1])
        self.words = self.hash.of(self.word_start, self.word_end)
        self.first_word = np.searchsorted(self.word_start, self.offsets)

    def grams(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(buckets, first n-gram of each text) by family."""
        shift = np.uint64(48)
        p = self.points.astype(np.uint32)
        n = max(0, len(p) - CHAR_N + 1)
        chars = np.zeros(n, np.uint32)
        for k in range(CHAR_N):
            chars = chars * np.uint32(0x9E3779B1) + p[k : k + n]
        chars = ((chars * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int64)
        pairs = runs_of(self.words, 2) >> shift
        pairs[self.words[1:] == self.words[: len(pairs)]] = 0  # a repeated word is one feature, whichever word it is
        words = mix(self.words) >> shift
        out = []
        for values, first, width in (
            (chars, self.offsets, CHAR_N), (words.astype(np.int64), self.first_word, 1),
            (pairs.astype(np.int64), self.first_word, 2),
        ):
            # N-grams that begin in the last places of a text would run on into the next one.
            inside = np.ones(len(values) + 1, bool)
            for back in range(1, width):
                at = first[1:] - back
                inside[at[(at >= 0) & (at <= len(values))]] = False
            kept = np.flatnonzero(inside[:-1])
            out.append((values[kept], np.searchsorted(kept, first)))
        return out

    def linear(self, weights: np.ndarray) -> np.ndarray:
        """For each text the sum over families of the mean weight of its n-grams."""
        total = np.zeros(self.n)
        for family, (buckets, first) in enumerate(self.grams()):
            sums = np.concatenate([[0.0], np.cumsum(weights[family * BUCKETS + buckets])])
            count = np.diff(first)
            total += (sums[first[1:]] - sums[first[:-1]]) / np.maximum(count, 1)
        return total

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its features: sorted places and shares."""
        grams = self.grams()
        out = []
        for t in range(self.n):
            places, shares = [], []
            for family, (buckets, first) in enumerate(grams):
                own = buckets[first[t] : first[t + 1]]
                if len(own):
                    place, times = np.unique(own, return_counts=True)
                    places.append(place + family * BUCKETS)
                    shares.append(times / len(own))
            out.append((np.concatenate(places), np.concatenate(shares)) if places else (np.zeros(0, int), np.zeros(0)))
        return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, rounds: int = 100, rate: float = 2.0, l2: float = 1e-5):
    """Weights (``size`` by classes) and biases of softmax regression for ``y`` in 0..k-1, classes weighted equally."""
    classes = int(y.max()) + 1
    used, place = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    value = np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    # Rare buckets have small shares: each is scaled by its root mean square, weights are scaled back at the end.
    scale = np.sqrt(np.bincount(place, value**2, len(used)) / len(rows)) + 1e-4
    value = value / scale[place] / np.sqrt(len(used))
    target = np.eye(classes)[y]
    share = (1.0 / np.bincount(y, minlength=classes))[y][:, None] / classes
    w, b = np.zeros((len(used), classes)), np.zeros(classes)
    gw2, gb2 = np.full(w.shape, 1e-8), np.full(b.shape, 1e-8)
    for _ in range(rounds):
        z = np.stack([np.bincount(owner, value * w[place, c], len(rows)) for c in range(classes)], 1) + b
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        g = (p - target) * share
        gw = np.stack([np.bincount(place, value * g[owner, c], len(used)) for c in range(classes)], 1) + l2 * w
        gb = g.sum(axis=0)
        gw2, gb2 = gw2 + gw**2, gb2 + gb**2
        w -= rate * gw / np.sqrt(gw2)
        b -= rate / 20 * gb / np.sqrt(gb2)
    out = np.zeros((size, classes))
    out[used] = w / scale[:, None] / np.sqrt(len(used))
    return out, b


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn scores into probabilities (Newton's method, smoothed targets)."""
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(1e-9, float(np.abs(z).max()))
    x = np.stack([z / scale, np.ones(len(z))], 1)
    c = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])

    def loss(c: np.ndarray) -> float:
        v = x @ c
        return float(np.sum(np.logaddexp(0, v) - t * v) + 1e-4 * c @ c)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -500, 500)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 2e-4 * np.eye(2)
        step, size, now = np.linalg.solve(h, x.T @ (p - t) + 2e-4 * c), 1.0, loss(c)
        while size > 1e-6 and loss(c - size * step) > now:
            size /= 2
        c = c - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(c[0] / scale), float(c[1])
