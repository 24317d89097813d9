"""Histogram gradient boosting of regression trees that grow leaf by leaf.

A fit is one task over a bounded sample of rows; many fits (origins, folds, settings) run side by side, and predictions are made where the rows are.
Nulls are a bin of their own, which each split sends to the better side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bins of a feature beside that of nulls; and of each histogram.
BINS = 63


@dataclass(frozen=True)
class Params:
    """loss: squared, absolute, huber (slope held to `delta`), tweedie (log link, variance power `power`) or logistic."""

    loss: str = "squared"
    trees: int = 500
    rate: float = 0.03
    leaves: int = 31
    least: int = 50
    rows: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    delta: float = 0.9
    power: float = 1.5
    seed: int = 42


def slopes(p: Params, y: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss by the score."""
    if p.loss == "squared":
        return s - y, np.ones(len(y))
    if p.loss == "absolute":
        return np.sign(s - y), np.ones(len(y))
    if p.loss == "huber":
        return np.clip(s - y, -p.delta, p.delta), np.ones(len(y))
    if p.loss == "tweedie":
        a, b = np.exp((1 - p.power) * s), np.exp((2 - p.power) * s)
        return b - y * a, np.maximum((2 - p.power) * b - (1 - p.power) * y * a, 1e-9)
    if p.loss == "logistic":
        q = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
        return q - y, np.maximum(q * (1 - q), 1e-9)
    raise ValueError(f"unknown loss: {p.loss}")


def loss(p: Params, y: np.ndarray, s: np.ndarray, w: np.ndarray) -> float:
    """Weighted mean loss of the scores."""
    d = np.abs(s - y)
    each = {
        "squared": lambda: d * d,
        "absolute": lambda: d,
        "huber": lambda: np.where(d <= p.delta, d * d / 2, p.delta * (d - p.delta / 2)),
        "tweedie": lambda: np.exp((2 - p.power) * s) / (2 - p.power) - y * np.exp((1 - p.power) * s) / (1 - p.power),
        "logistic": lambda: np.logaddexp(0, s) - y * s,
    }[p.loss]()
    return float((w * each).sum() / w.sum())


def weighted_median(x: np.ndarray, w: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    upto = np.cumsum(w[order])
    return float(x[order][np.searchsorted(upto, upto[-1] / 2)])


def start(p: Params, y: np.ndarray, w: np.ndarray, offset: np.ndarray) -> float:
    """The best constant beside the offset; for Huber's loss the median."""
    if p.loss in ("absolute", "huber"):
        return weighted_median(y - offset, w)
    if p.loss == "squared":
        return float(np.average(y - offset, weights=w))
    if p.loss == "tweedie":
        a = (w * np.exp((1 - p.power) * offset) * y).sum() / max((w * np.exp((2 - p.power) * offset)).sum(), 1e-300)
        return float(np.log(max(a, 1e-9)))
    q = np.clip(np.average(y, weights=w), 1e-6, 1 - 1e-6)
    return float(np.log(q / (1 - q)))


class Model:
    """Edges of the bins and trees as arrays; scores add up in the order of the trees."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base = edges, base
        self.trees: list[tuple[np.ndarray, ...]] = []

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bins of a matrix: 0 for missing values, else 1 and up."""
        out = np.zeros(x.shape, np.uint8)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(e, x[:, j], "left") + 1)
        return out

    def score(self, x: np.ndarray, offset: np.ndarray | float = 0.0, trees: int | None = None) -> np.ndarray:
        c = self.codes(np.asarray(x, float))
        s = np.full(len(c), self.base) + offset
        for tree in self.trees[:trees]:
            s += leaf_values(tree, c)
        return s


def leaf_values(tree: tuple[np.ndarray, ...], codes: np.ndarray) -> np.ndarray:
    feature, cut, missing, left, right, value = tree
    at = np.zeros(len(codes), np.int64)
    while True:
        rows = np.flatnonzero(feature[at] >= 0)
        if not len(rows):
            return value[at]
        node = at[rows]
        c = codes[rows, feature[node]]
        at[rows] = np.where(np.where(c == 0, missing[node], c <= cut[node]), left[node], right[node])


def expected(tree: tuple[np.ndarray, ...], codes: np.ndarray) -> np.ndarray:
    """The mean value of each node over the rows that reach it; of a node that none reaches, the plain mean below it."""
    feature, cut, missing, left, right, value = tree
    out, n = value.astype(float), np.zeros(len(feature))
    at = np.zeros(len(codes), np.int64)
    while (feature[at] >= 0).any():
        c = codes[np.arange(len(codes)), np.maximum(feature[at], 0)]
        down = np.where(np.where(c == 0, missing[at], c <= cut[at]), left[at], right[at])
        at = np.where(feature[at] >= 0, down, at)
    n += np.bincount(at, minlength=len(n))
    for k in range(len(feature) - 1, -1, -1):  # children stand behind their parent
        if feature[k] >= 0:
            a, b = left[k], right[k]
            n[k] = n[a] + n[b]
            out[k] = (out[a] * n[a] + out[b] * n[b]) / n[k] if n[k] else (out[a] + out[b]) / 2
    return out


def contributions(model: Model, x: np.ndarray) -> np.ndarray:
    """What each feature adds to each row's score: the changes of the expected value along the row's paths. With the expected score they sum to the score."""
    codes = model.codes(np.asarray(x, float))
    out = np.zeros(codes.shape)
    for tree in model.trees:
        feature, cut, missing, left, right, _ = tree
        mean = expected(tree, codes)
        at = np.zeros(len(codes), np.int64)
        while len(rows := np.flatnonzero(feature[at] >= 0)):
            node = at[rows]
            c = codes[rows, feature[node]]
            down = np.where(np.where(c == 0, missing[node], c <= cut[node]), left[node], right[node])
            np.add.at(out, (rows, feature[node]), mean[down] - mean[node])
            at[rows] = down
    return out


def bin_edges(x: np.ndarray) -> list[np.ndarray]:
    """At most BINS - 1 cuts between values of each column, by its quantiles."""
    out = []
    for j in range(x.shape[1]):
        v = np.unique(x[~np.isnan(x[:, j]), j])
        if len(v) > BINS:
            v = np.unique(np.quantile(x[~np.isnan(x[:, j]), j], np.linspace(0, 1, BINS), method="lower"))
        out.append((v[:-1] + v[1:]) / 2)
    return out


class _Grower:
    def __init__(self, p: Params, codes: np.ndarray):
        self.p, self.codes, self.k = p, codes, codes.shape[1]
        self.flat = codes.astype(np.int32) + (np.arange(self.k, dtype=np.int32) * (BINS + 1))[None, :]

    def sums(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Gradient, curvature and count by feature and bin."""
        at, n = self.flat[rows].ravel().astype(np.intp), self.k * (BINS + 1)
        count = np.bincount(at, minlength=n).astype(float)
        curved = count * h[0] if self.even else np.bincount(at, np.repeat(h[rows], self.k), n)
        return np.stack([np.bincount(at, np.repeat(g[rows], self.k), n), curved, count]).reshape(3, self.k, BINS + 1)

    def best(self, sums: np.ndarray, able: np.ndarray) -> tuple:
        """gain, feature, cut, side of nulls (true: left) of the best split."""
        total = sums.sum(2)[:, :1]
        worth = lambda g, h: g * g / (h + self.p.l2)
        left = np.cumsum(sums[:, :, 1:], 2)[:, :, :-1]
        found = (1e-9, -1, 0, False)
        some = sums[2, :, 0].any()
        for nulls in (True, False) if some else (False,):
            a = left + sums[:, :, :1] if nulls else left
            b = total[:, :, None] - a
            gain = worth(a[0], a[1]) + worth(b[0], b[1]) - worth(*total[:2])[:, None]
            gain = np.where((a[2] >= self.p.least) & (b[2] >= self.p.least) & able[:, None], gain, -np.inf)
            j, c = divmod(int(gain.argmax()), gain.shape[1])
            if gain[j, c] > found[0]:
                found = (float(gain[j, c]), j, c + 1, nulls)
        return found

    def tree(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray, able: np.ndarray, refit) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """A tree grown on `rows`, and its values for all rows."""
        self.even = bool((h == h[0]).all())
        feature, cut, missing, left, right, value = [-1], [0], [False], [0], [0], [0.0]
        leaves = {0: (rows, s := self.sums(rows, g, h), self.best(s, able))}
        while len(leaves) < self.p.leaves:
            node = max(leaves, key=lambda n: leaves[n][2][0])
            own, s, (gain, j, c, nulls) = leaves[node]
            if j < 0:
                break
            code = self.codes[own, j]
            go = np.where(code == 0, nulls, code <= c)
            a, b = own[go], own[~go]
            small = self.sums(a if len(a) <= len(b) else b, g, h)
            sa, sb = (small, s - small) if len(a) <= len(b) else (s - small, small)
            del leaves[node]
            feature[node], cut[node], missing[node] = j, c, nulls
            for side, part, ss in ((left, a, sa), (right, b, sb)):
                side[node] = len(feature)
                leaves[len(feature)] = (part, ss, self.best(ss, able))
                for column, v in ((feature, -1), (cut, 0), (missing, False), (left, 0), (right, 0), (value, 0.0)):
                    column.append(v)
        out = np.full(len(self.codes), np.nan)
        for node, (own, _, _) in leaves.items():
            value[node] = out[own] = self.p.rate * refit(own)
        tree = tuple(map(np.array, (feature, cut, missing, left, right, value)))
        rest = np.flatnonzero(np.isnan(out))
        out[rest] = leaf_values(tree, self.codes[rest])
        return tree, out


def fit(x: np.ndarray, y: np.ndarray, p: Params, w: np.ndarray | None = None, offset: np.ndarray | None = None, watch=None, patience: int = 0) -> Model:
    """Boosted trees of `y` on `x` (missing: NaN). Leaves of the absolute loss are medians of what is left to explain.

    watch(model, tree): called after each tree, returns a validation loss; with `patience` the fit ends after so many trees without a better one, and the
    model keeps the trees up to the best.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    w = np.ones(len(y)) if w is None else np.asarray(w, float)
    offset = np.zeros(len(y)) if offset is None else np.asarray(offset, float)
    model = Model(bin_edges(x), start(p, y, w, offset) if len(y) else 0.0)
    if not len(y):
        return model
    grower, rng = _Grower(p, model.codes(x)), np.random.default_rng(p.seed)
    s = model.base + offset
    best, at = np.inf, 0
    for t in range(p.trees):
        g, h = slopes(p, y, s)
        g, h = g * w, h * w
        rows = np.flatnonzero(rng.random(len(y)) < p.rows) if p.rows < 1 else np.arange(len(y))
        able = np.zeros(x.shape[1], bool)
        able[rng.permutation(x.shape[1])[: max(1, round(p.columns * x.shape[1]))]] = True
        if p.loss == "absolute":
            refit = lambda own: weighted_median(y[own] - s[own], w[own]) if len(own) else 0.0  # noqa: E731, B023
        else:
            refit = lambda own: -g[own].sum() / (h[own].sum() + p.l2)  # noqa: E731, B023
        tree, add = grower.tree(rows, g, h, able, refit)
        model.trees.append(tree)
        s = s + add
        if watch is not None:
            now = watch(model, tree)
            if now < best:
                best, at = now, t + 1
            if patience and t + 1 - at >= patience:
                break
    if patience:
        del model.trees[at:]
    return model
