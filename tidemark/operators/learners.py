"""Learners of a binary outcome over arrays: logistic regression, forest, boosting, Shapley values.

They fit one bounded table inside one task; `models` deals the fits out. Trees
see quantile codes of the features. An ensemble is a dictionary of arrays over
all nodes of its trees: `feature` (-1 at leaves), `threshold` (at or below goes
left), `left`, `right`, `cover`, `value`, and `roots`.
"""

from __future__ import annotations

import math

import numpy as np

BINS = 64
LEAF = ("feature", "threshold", "left", "right", "cover", "value")


def quantile_codes(x: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, list[np.ndarray]]:
    """(codes, edges per feature): a code is how many edges lie below the value."""
    codes, edges = np.empty(x.shape, np.int32), []
    for j in range(x.shape[1]):
        e = np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins, method="lower")) if len(x) else np.zeros(0)
        e = e[e < x[:, j].max()] if len(x) else e
        codes[:, j] = np.searchsorted(e, x[:, j], side="left")
        edges.append(e)
    return codes, edges


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float, steps: int = 100) -> dict:
    """Newton steps on standardised columns; the penalty 1 / C is on all but the constant."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    beta, ridge = np.zeros(z.shape[1]), np.r_[0.0, np.full(x.shape[1], 1 / c)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ beta))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(ridge) + 1e-12 * np.eye(len(ridge)), z.T @ (y - p) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    return {"kind": "logistic", "mean": mean, "scale": scale, "beta": beta}


def _table(nodes: list[tuple]) -> dict[str, np.ndarray]:
    a = np.array(nodes, float).reshape(-1, 6)
    return {"feature": a[:, 0].astype(np.int16), "threshold": a[:, 1], "left": a[:, 2].astype(np.int32), "right": a[:, 3].astype(np.int32), "cover": a[:, 4].astype(np.float32), "value": a[:, 5]}


def joined(trees: list[dict]) -> dict[str, np.ndarray]:
    """One ensemble of all trees; children are numbered over all nodes."""
    size = np.array([len(t["feature"]) for t in trees], np.int64)
    roots = np.cumsum(size) - size
    out = {k: np.concatenate([t[k] for t in trees]) for k in LEAF}
    shift = np.repeat(roots, size).astype(np.int32)
    for side in ("left", "right"):
        out[side] = np.where(out["feature"] >= 0, out[side] + shift, -1).astype(np.int32)
    return {**out, "roots": roots.astype(np.int32)}


def _forest_tree(codes: np.ndarray, edges: list[np.ndarray], y: np.ndarray, leaf: int, rng: np.random.Generator) -> dict:
    """One tree on a resample, level by level: all nodes of a level are split
    together, each by the best of sqrt(k) features of its own; gini, at least `leaf` different rows a side."""
    n, k = codes.shape
    m = max(1, int(math.sqrt(k)))
    weight = np.bincount(rng.integers(0, n, n), minlength=n)
    rows = np.flatnonzero(weight)
    w, pos = weight[rows].astype(float), weight[rows] * y[rows]
    at = np.zeros(len(rows), np.int64)  # the row's place among the nodes of the level
    nodes: list[list] = [[-1, 0.0, -1, -1, w.sum(), pos.sum() / max(w.sum(), 1)]]
    level = np.array([0])
    while len(rows):
        a = len(level)
        chosen = np.argsort(rng.random((a, k)), axis=1)[:, :m]
        cell = ((at[:, None] * m + np.arange(m)) * BINS + np.take_along_axis(codes[rows], chosen[at], axis=1)).ravel()
        size = a * m * BINS
        count, ws, ps = (np.bincount(cell, None if v is None else np.repeat(v, m), size).reshape(a, m, BINS).cumsum(axis=2) for v in (None, w, pos))
        all_c, all_w, all_p = count[:, :, -1:], ws[:, :, -1:], ps[:, :, -1:]

        def purity(weights, positives):
            return (positives**2 + (weights - positives) ** 2) / np.maximum(weights, 1e-12)

        gain = purity(ws, ps) + purity(all_w - ws, all_p - ps) - purity(all_w, all_p)
        gain[(count < leaf) | (all_c - count < leaf)] = -1.0
        flat = gain.reshape(a, -1)
        best = flat.argmax(axis=1)
        split = flat[np.arange(a), best] > 1e-9
        if not split.any():
            break
        slot, bin_ = best // BINS, best % BINS
        feature = chosen[np.arange(a), slot]
        child = np.full((a, 2), -1)
        for i in np.flatnonzero(split):
            f, b = int(feature[i]), int(bin_[i])
            lw, lp, tw, tp = ws[i, slot[i], b], ps[i, slot[i], b], all_w[i, 0, 0], all_p[i, 0, 0]
            child[i] = len(nodes), len(nodes) + 1
            nodes[level[i]][:4] = [f, edges[f][b], *child[i].tolist()]
            nodes.append([-1, 0.0, -1, -1, lw, lp / lw])
            nodes.append([-1, 0.0, -1, -1, tw - lw, (tp - lp) / (tw - lw)])
        keep = split[at]
        rows, w, pos, at = rows[keep], w[keep], pos[keep], at[keep]
        right = codes[rows, feature[at]] > bin_[at]
        number = np.full(a * 2, -1)
        number[np.flatnonzero(np.repeat(split, 2))] = np.arange(2 * split.sum())
        at = number[at * 2 + right]
        level = child[split].ravel()
    return _table([tuple(v) for v in nodes])


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int, leaf: int, seed: int) -> dict:
    codes, edges = quantile_codes(x)
    rng = np.random.default_rng(seed)
    return {"kind": "random_forest", "base": 0.0, "scale": 1.0 / trees, **joined([_forest_tree(codes, edges, y, leaf, rng) for _ in range(trees)])}


def _best_split(hist: np.ndarray, leaf: int, l2: float) -> tuple[float, int, int]:
    """(gain, feature slot, code) of histograms [gradient, hessian, count] x features x codes."""
    left = hist.cumsum(axis=2)
    total = left[:, :, -1:]
    right = total - left
    worth = lambda s: s[0] ** 2 / (s[1] + l2)
    gain = worth(left) + worth(right) - worth(total)
    gain[(left[2] < leaf) | (right[2] < leaf) | (left[1] < 1e-3) | (right[1] < 1e-3)] = -1.0
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


def _boosted_tree(codes: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, feats: np.ndarray, leaves: int, leaf: int, l2: float, rate: float) -> tuple[dict, np.ndarray]:
    """A tree grown leaf by leaf, the most gainful first, and each row's value in it (all rows of `codes`)."""
    offset = np.arange(len(feats)) * BINS

    def histogram(at: np.ndarray) -> np.ndarray:
        cell = (codes[at][:, feats] + offset).ravel()
        return np.stack([np.bincount(cell, v, len(feats) * BINS).reshape(-1, BINS) for v in (np.repeat(grad[at], len(feats)), np.repeat(hess[at], len(feats)), None)])

    def value(h: np.ndarray) -> tuple[float, float]:
        g, s, c = h[:, 0, :].sum(axis=1)
        return float(c), float(-rate * g / (s + l2))

    first = histogram(rows)
    nodes: list[list] = [[-1, 0.0, -1, -1, *value(first)]]
    place = np.zeros(len(codes), np.int32)  # the leaf of every row, in the bag or not
    open_ = {0: (rows, first, _best_split(first, leaf, l2))}
    for _ in range(leaves - 1):
        node = max(open_, key=lambda i: open_[i][2][0])
        at, hist, (gain, slot, code) = open_.pop(node)
        if gain <= 1e-12:
            break
        f = int(feats[slot])
        goes = codes[at, f] <= code
        sides = [at[goes], at[~goes]]
        small = int(len(sides[1]) < len(sides[0]))
        hists = [None, None]
        hists[small] = histogram(sides[small])
        hists[1 - small] = hist - hists[small]
        nodes[node][:4] = [f, edges[f][code], len(nodes), len(nodes) + 1]
        inside = place == node
        place[inside] = np.where(codes[inside, f] <= code, len(nodes), len(nodes) + 1)
        for part, h in zip(sides, hists, strict=True):
            open_[len(nodes)] = (part, h, _best_split(h, leaf, l2))
            nodes.append([-1, 0.0, -1, -1, *value(h)])
    table = _table([tuple(v) for v in nodes])
    return table, table["value"][place]


def fit_boosting(x: np.ndarray, y: np.ndarray, rounds: int, rate: float, leaves: int, seed: int, leaf: int = 40, l2: float = 1.0, rows: float = 0.8, columns: float = 0.8) -> dict:
    """Gradient boosting of the log loss, each tree on a share of rows and columns."""
    codes, edges = quantile_codes(x)
    rng = np.random.default_rng(seed)
    n, k = codes.shape
    mean = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    base = math.log(mean / (1 - mean))
    score, trees = np.full(n, base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        bag = np.sort(rng.permutation(n)[: max(1, int(rows * n))])
        feats = np.sort(rng.permutation(k)[: max(1, math.ceil(columns * k))])
        tree, step = _boosted_tree(codes, edges, p - y, p * (1 - p), bag, feats, leaves, leaf, l2, rate)
        score += step
        trees.append(tree)
    return {"kind": "boosting", "base": base, "scale": 1.0, **joined(trees)}


def fit_model(kind: str, params: dict, x: np.ndarray, y: np.ndarray, seed: int, trees: int) -> dict:
    if kind == "logistic":
        return fit_logistic(x, y, params["c"])
    if kind == "random_forest":
        return fit_forest(x, y, trees, params["leaf"], seed)
    return fit_boosting(x, y, params["rounds"], params["rate"], params["leaves"], seed, params.get("leaf", 40))


def margin(model: dict, x: np.ndarray, at_once: int = 2_000_000) -> np.ndarray:
    """Sum of the trees' values, or the linear predictor."""
    if model["kind"] == "logistic":
        return model["beta"][0] + ((x - model["mean"]) / model["scale"]) @ model["beta"][1:]
    roots = model["roots"]
    out = np.empty(len(x))
    step = max(1, at_once // max(len(roots), 1))
    for i in range(0, len(x), step):
        part = x[i : i + step]
        node = np.broadcast_to(roots, (len(part), len(roots))).copy()
        while True:
            f = model["feature"][node]
            inner = f >= 0
            if not inner.any():
                break
            r, c = np.nonzero(inner)
            at = node[r, c]
            node[r, c] = np.where(part[r, f[r, c]] <= model["threshold"][at], model["left"][at], model["right"][at])
        out[i : i + step] = model["base"] + model["scale"] * model["value"][node].sum(axis=1)
    return out


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    m = margin(model, x)
    return m if model["kind"] == "random_forest" else 1 / (1 + np.exp(-m))


def tree_shap(model: dict, x: np.ndarray) -> np.ndarray:
    """Shapley values (rows x features) of an ensemble, features out of play
    averaged along each tree's own cover.

    A leaf depends only on the features of its path. For each leaf the path's
    feature weights `one` (does the row follow?) and `zero` (share of cover that
    does) give the polynomial whose coefficients the Shapley weights act on; all rows go together.
    """
    n, k = x.shape
    phi = np.zeros((n, k))
    feature, threshold, left, right, cover, value = (model[c] for c in LEAF)

    def leaf(path: dict[int, tuple[float, np.ndarray]], v: float) -> None:
        m = len(path)
        poly = np.zeros((m + 1, n))
        poly[0] = 1.0
        for zero, one in path.values():
            nxt = poly * zero
            nxt[1:] += poly[:-1] * one
            poly = nxt
        for f, (zero, one) in path.items():
            rest, total, weight = poly[0] / zero, 0.0, 1.0 / m
            for j in range(m):
                total = total + rest * weight
                if j < m - 1:
                    rest = (poly[j + 1] - rest * one) / zero
                    weight *= (j + 1) / (m - j - 1)
            phi[:, f] += (one - zero) * total * (v * model["scale"])

    def walk(at: int, path: dict[int, tuple[float, np.ndarray]]) -> None:
        f = int(feature[at])
        if f < 0:
            if path:
                leaf(path, float(value[at]))
            return
        goes = x[:, f] <= threshold[at]
        for child, follows in ((int(left[at]), goes), (int(right[at]), ~goes)):
            zero, one = path.get(f, (1.0, np.ones(n)))
            walk(child, {**path, f: (zero * float(cover[child]) / float(cover[at]), one * follows)})

    for root in model["roots"]:
        walk(int(root), {})
    return phi
