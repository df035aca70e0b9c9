"""A generalised additive model with pairwise interactions, boosted in cycles over its features.

Each feature is cut into bins; each round adds, feature by feature, a small step of a tree of at most three leaves to
that feature's lookup table.  Then the strongest pairs, by what they explain of the remaining residuals, get tables
of their own in the same way with trees of four leaves.  A score is a sum of table entries.
"""

from __future__ import annotations

import json

import numpy as np

BINS = 32
COARSE = 8
ROUNDS = 120
PAIR_ROUNDS = 60
PAIRS = 8
RATE = 0.1
SMOOTH = 2.0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins)) if len(values) else np.zeros(0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins in two; no cut: gain 0."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + SMOOTH) + (all_g - left_g) ** 2 / (all_h - left_h + SMOOTH)
    gain -= all_g**2 / (all_h + SMOOTH)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree with at most three leaves."""
    parts = [(0, len(g))]
    for _ in range(2):
        gain, at, part = max(
            ((gain, a + k, (a, b)) for a, b in parts for gain, k in [_best_cut(g[a:b], h[a:b])]), key=lambda x: x[0]
        )
        if gain <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], at), (at, part[1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SMOOTH)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by cell: the best cut along one side, then one along the other in each half."""
    best, out = 0.0, np.full(g.shape, g.sum() / (h.sum() + SMOOTH))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for k in range(1, len(a)):
            value, total = np.zeros(a.shape), -(a.sum() ** 2) / (b.sum() + SMOOTH)
            for rows in (slice(0, k), slice(k, None)):
                ga, hb = a[rows].sum(axis=0), b[rows].sum(axis=0)
                _, at = _best_cut(ga, hb)
                for cols in (slice(0, at), slice(at, None)):
                    sg, sh = ga[cols].sum(), hb[cols].sum() + SMOOTH
                    value[rows, cols] = sg / sh
                    total += sg**2 / sh
            if total > best:
                best, out = total, value.T if turned else value
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> str:
    """The model as JSON text: intercept, edges, tables and pairs of features."""
    n, width = x.shape
    edges = [_edges(x[:, j], BINS) for j in range(width)]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    base = (weight @ y + 1) / (weight.sum() + 2)
    intercept = float(np.log(base / (1 - base)))
    margin = np.full(n, intercept)
    tables = [np.zeros(len(e) + 1) for e in edges]
    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            p = sigmoid(margin)
            g = np.bincount(b, weight * (y - p), len(tables[j]))
            h = np.bincount(b, weight * p * (1 - p), len(tables[j]))
            step = RATE * _tree(g, h)
            tables[j] += step
            margin += step[b]
    coarse = [_edges(x[:, j], COARSE) for j in range(width)]
    cells = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        cell, p = cells[a] * shape[1] + cells[b], sigmoid(margin)
        size = shape[0] * shape[1]
        g = np.bincount(cell, weight * (y - p), size).reshape(shape)
        return g, np.bincount(cell, weight * p * (1 - p), size).reshape(shape)

    strength = {}
    for a in range(width):
        for b in range(a):
            g, h = sums(a, b)
            strength[a, b] = float((g**2 / (h + SMOOTH)).sum())
    chosen = sorted(strength, key=lambda k: (-strength[k], k))[:PAIRS]
    pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in chosen]
    for _ in range(PAIR_ROUNDS):
        for t, (a, b) in zip(pair_tables, chosen, strict=True):
            step = RATE * _pair_tree(*sums(a, b))
            t += step
            margin += step[cells[a], cells[b]]
    pairs = [{"of": [a, b], "table": t.tolist()} for (a, b), t in zip(chosen, pair_tables, strict=True)]
    lists = {"edges": edges, "tables": tables, "coarse": coarse}
    return json.dumps({"intercept": intercept, "pairs": pairs} | {k: [v.tolist() for v in x] for k, x in lists.items()})


class Model:
    """The mean of models that share their edges, such as those of one sample under different weights."""

    def __init__(self, texts: list[str]):
        parts = [json.loads(t) for t in texts]
        share = 1 / max(1, len(parts))
        self.edges = [np.array(e) for e in parts[0]["edges"]]
        self.coarse = [np.array(e) for e in parts[0]["coarse"]]
        self.intercept = sum(p["intercept"] for p in parts) * share
        self.tables = [share * sum(np.array(p["tables"][j]) for p in parts) for j in range(len(self.edges))]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        for p in parts:
            for q in p["pairs"]:
                key = tuple(q["of"])
                self.pairs[key] = self.pairs.get(key, 0) + share * np.array(q["table"])

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, j], side="right")]
        used = {j for pair in self.pairs for j in pair}
        cells = {j: np.searchsorted(self.coarse[j], x[:, j], side="right") for j in used}
        for (a, b), t in self.pairs.items():
            out += t[cells[a], cells[b]]
        return sigmoid(out)
