"""Second-order gradient boosting of small regression trees over binned features, in numpy.

Trees are flattened to node arrays, so a batch is scored by array steps, one for each level. A feature can be
held to a monotonic effect (+1: the score never falls as it rises, -1: never rises): splits that break the
order are refused, and the children's values are bounded by the midpoint on the way down.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Flat nodes of all trees; ``feature`` is -1 at a leaf; a row goes left if x <= threshold."""

    bias: float = 0.0
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    depth: int = 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                goes_left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))

    def paths(self) -> list[tuple[tuple[int, bool, float], ...]]:
        """Each node but the roots as its path: conditions (feature, x <= threshold, threshold)."""
        out: list[tuple[tuple[int, bool, float], ...]] = []

        def walk(node: int, path: tuple) -> None:
            if path:
                out.append(path)
            if self.feature[node] >= 0:
                f, t = int(self.feature[node]), float(self.threshold[node])
                walk(int(self.left[node]), (*path, (f, True, t)))
                walk(int(self.right[node]), (*path, (f, False, t)))

        for root in self.roots:
            walk(int(root), ())
        return list(dict.fromkeys(out))


def fit(x, y, *, rounds=60, depth=3, rate=0.2, ridge=1.0, min_rows=10, bins=64, monotone=None) -> Trees:
    """Boosted trees for labels 0/1. With one class or no rows: the constant of that class's rate."""
    n, width = x.shape
    rate_1 = (float(y.sum()) + 1) / (n + 2)
    model = Trees(bias=float(np.log(rate_1 / (1 - rate_1))))
    if n == 0 or y.min() == y.max():
        return model
    monotone = monotone or {}
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], axis=1)
    nodes: list[list] = []
    margin = np.full(n, model.bias)
    roots = []

    def grow(rows, g, h, level, low, high) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        here = len(nodes)
        nodes.append([-1, 0.0, -1, -1, rate * float(np.clip(-gs / (hs + ridge), low, high))])
        if level == depth or len(rows) < 2 * min_rows:
            return here
        best = (1e-6, None)
        for j in range(width):
            size = len(edges[j]) + 1
            if size < 2:
                continue
            b = binned[rows, j]
            gl, hl, cl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], None))
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            gain[(cl < min_rows) | (len(rows) - cl < min_rows)] = -1
            if sign := monotone.get(j):
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
                gain[sign * (vr - vl) < 0] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (j, k, -gl[k] / (hl[k] + ridge), -(gs - gl[k]) / (hs - hl[k] + ridge)))
        if best[1] is None:
            return here
        j, k, vl, vr = best[1]
        goes_left = binned[rows, j] <= k
        sign, mid = monotone.get(j, 0), float(np.clip((vl + vr) / 2, low, high))
        bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[sign]
        a = grow(rows[goes_left], g, h, level + 1, *bounds[0])
        c = grow(rows[~goes_left], g, h, level + 1, *bounds[1])
        nodes[here][:4] = [j, float(edges[j][k]), a, c]
        return here

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        start = len(nodes)
        roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-9), 0, -np.inf, np.inf))
        tree = _flat(nodes, [start], 0.0, depth)
        margin += tree.margin(x)
    return _flat(nodes, roots, model.bias, depth)


def _flat(nodes: list[list], roots: list[int], bias: float, depth: int) -> Trees:
    f, t, a, c, v = zip(*nodes, strict=True)
    return Trees(bias, np.array(roots, np.int32), np.array(f, np.int32), np.array(t), np.array(a, np.int32), np.array(c, np.int32), np.array(v), depth)
