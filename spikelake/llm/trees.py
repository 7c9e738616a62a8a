"""Boosted trees, random forests and isotonic calibration on dense features, in numpy.

Trees are complete binary trees kept as arrays, so that a whole batch goes down a level at a time. Fitting is
deterministic. It takes a bounded sample in memory; scoring runs wherever a batch is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


def _edges(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]


def _grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float, rng: np.random.Generator, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree that minimises the second-order loss: features and limits of 2**depth - 1 nodes, values of 2**depth leaves.

    Each node looks at a random share of the features. A node that gains nothing sends all rows left.
    """
    n, f = binned.shape
    features, limits = np.zeros(2**depth - 1, np.int32), np.full(2**depth - 1, np.inf)
    node = np.zeros(n, np.int64)
    columns = np.arange(f)
    for level in range(depth):
        width = 2**level
        place = ((node[:, None] * f + columns) * BINS + binned).ravel()
        shape = (width, f, BINS)
        gs = np.bincount(place, np.repeat(g, f), width * f * BINS).reshape(shape).cumsum(2)
        hs = np.bincount(place, np.repeat(h, f), width * f * BINS).reshape(shape).cumsum(2)
        gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
        gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
        gain[(hs < least) | (ht - hs < least)] = -1
        if share < 1:
            gain[rng.random((width, f)) >= share] = -1
        best = gain.reshape(width, -1).argmax(1)
        good = np.take_along_axis(gain.reshape(width, -1), best[:, None], 1)[:, 0] > 1e-9
        feature, cut = best // BINS, best % BINS
        for k in np.flatnonzero(good):
            if cut[k] < len(edges[feature[k]]):
                features[width - 1 + k], limits[width - 1 + k] = feature[k], edges[feature[k]][cut[k]]
            else:
                good[k] = False
        right = good[node] & (binned[np.arange(n), feature[node]] > cut[node])
        node = node * 2 + right
    size = 2**depth
    return features, limits, -np.bincount(node, g, size) / (np.bincount(node, h, size) + ridge)


@dataclass
class Trees:
    """Trees whose leaves add up, on top of a base value."""

    base: float
    features: list[np.ndarray] = field(default_factory=list)
    limits: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for features, limits, leaves in zip(self.features, self.limits, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaves)))):
                node = 2 * node + 1 + (x[rows, features[node]] > limits[node])
            out += leaves[node - len(features)]
        return out


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.2, least: float = 2.0, ridge: float = 1.0, seed: int = 7) -> Trees:
    """Gradient boosting of the log loss; raw() gives log odds."""
    rng, edges = np.random.default_rng(seed), _edges(x)
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Trees(float(np.log(share / (1 - share))))
    score = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        features, limits, leaves = _grow(binned, edges, p - y, p * (1 - p), depth, least * 0.25, ridge, rng, 1.0)
        leaves = leaves * rate
        for parts, new in ((model.features, features), (model.limits, limits), (model.leaves, leaves)):
            parts.append(new)
        score += Trees(0.0, [features], [limits], [leaves]).raw(x)
    return model


def forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 7, least: float = 3.0, share: float = 0.4, seed: int = 7) -> Trees:
    """A random forest: bootstrap rows, a random share of the features at each node; raw() gives the mean share of ones."""
    rng, edges = np.random.default_rng(seed), _edges(x)
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    model = Trees(0.0)
    for _ in range(trees):
        times = rng.multinomial(len(y), np.full(len(y), 1 / len(y))).astype(float)
        features, limits, leaves = _grow(binned, edges, -times * y, times, depth, least, 1e-6, rng, share)
        for parts, new in ((model.features, features), (model.limits, limits), (model.leaves, leaves / trees)):
            parts.append(new)
    return model


@dataclass
class Isotonic:
    """A rising step function from scores to probabilities, by pooling adjacent violators."""

    x: np.ndarray
    y: np.ndarray

    @classmethod
    def fit(cls, scores: np.ndarray, labels: np.ndarray) -> Isotonic:
        """A pseudo count of one half keeps each pool's probability within (0, 1)."""
        order = np.argsort(scores, kind="stable")
        pools: list[list[float]] = []  # sum, count, first and last score
        for s, v in zip(scores[order].tolist(), labels[order].tolist()):
            if pools and pools[-1][3] == s:
                pools[-1][0] += v
                pools[-1][1] += 1
            else:
                pools.append([v, 1.0, s, s])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                v2, n2, _, last = pools.pop()
                pools[-1][0] += v2
                pools[-1][1] += n2
                pools[-1][3] = last
        share = [(v + 0.5) / (n + 1) for v, n, _, _ in pools]
        x = [e for p in pools for e in (p[2], p[3])]
        return cls(np.array(x), np.maximum.accumulate(np.repeat(share, 2)))

    def __call__(self, scores: np.ndarray) -> np.ndarray:
        return np.interp(scores, self.x, self.y)
