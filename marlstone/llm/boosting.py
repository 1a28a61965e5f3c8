"""Gradient-boosted trees on small tables: fitted in numpy, applied as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fit_tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: int, l2: float = 1.0) -> dict:
    """A tree of the greatest gain in the second-order sense; ties go to the first feature and the lowest cut."""
    g, h = grad.sum(), hess.sum()
    best = (1e-6, None, None)
    if depth and len(x) >= 2 * least:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, cg, ch = x[order, f], np.cumsum(grad[order]), np.cumsum(hess[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            at = at[(at + 1 >= least) & (len(v) - at - 1 >= least)]
            if len(at):
                gain = cg[at] ** 2 / (ch[at] + l2) + (g - cg[at]) ** 2 / (h - ch[at] + l2) - g * g / (h + l2)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, (v[at[k]] + v[at[k] + 1]) / 2)
    if best[1] is None:
        return {"leaf": float(-g / (h + l2))}
    low = x[:, best[1]] <= best[2]
    return {"feature": int(best[1]), "cut": float(best[2]), "low": _fit_tree(x[low], grad[low], hess[low], depth - 1, least, l2), "high": _fit_tree(x[~low], grad[~low], hess[~low], depth - 1, least, l2)}


def _apply(tree: dict, x: np.ndarray) -> np.ndarray:
    if "leaf" in tree:
        return np.full(len(x), tree["leaf"])
    return np.where(x[:, tree["feature"]] <= tree["cut"], _apply(tree["low"], x), _apply(tree["high"], x))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.4, least: int = 5) -> list[dict]:
    """Trees whose sum is the log odds of y = 1; leaves carry the learning rate."""
    out, score = [], np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _scaled(_fit_tree(x, p - y, p * (1 - p), depth, least), rate)
        score += _apply(tree, x)
        out.append(tree)
    return out


def _scaled(tree: dict, rate: float) -> dict:
    if "leaf" in tree:
        return {"leaf": tree["leaf"] * rate}
    return tree | {"low": _scaled(tree["low"], rate), "high": _scaled(tree["high"], rate)}


def predict(trees: list[dict], x: np.ndarray) -> np.ndarray:
    return sum((_apply(t, x) for t in trees), np.zeros(len(x)))


def _depth(tree: dict) -> int:
    return 0 if "leaf" in tree else 1 + max(_depth(tree["low"]), _depth(tree["high"]))


def _full(tree: dict, depth: int) -> tuple[list[list[tuple[int, float]]], list[float]]:
    """Cuts by level, and leaves, of the tree as a full one of this depth; what it lacks always goes low."""
    if depth == 0:
        return [], [tree["leaf"]]
    leaf = "leaf" in tree
    own = (0, 1e300) if leaf else (tree["feature"], tree["cut"])
    low, high = (_full(tree if leaf else tree[side], depth - 1) for side in ("low", "high"))
    return [[own], *(x + y for x, y in zip(low[0], high[0], strict=True))], low[1] + high[1]


def expression(trees: list[dict], features: Column) -> Column:
    """The summed score of the trees for an array of features.

    Trees are data: literal arrays of full trees, walked from level to level, so the plan doesn't grow with their number.
    """
    depth = max(map(_depth, trees))
    full = [_full(t, depth) for t in trees]
    cuts = [[c for level in t[0] for c in level] for t in full]
    numbers = lambda xs, kind: F.split(F.lit(",".join(repr(x) for x in xs)), ",").cast(f"array<{kind}>")
    which, where = numbers([c[0] for t in cuts for c in t], "int"), numbers([c[1] for t in cuts for c in t], "double")
    leaves = numbers([x for t in full for x in t[1]], "double")
    inner, outer = (1 << depth) - 1, 1 << depth

    def walk(total: Column, t: Column) -> Column:
        node = F.lit(0)
        for _ in range(depth):
            at = t * inner + node
            node = node * 2 + 1 + (F.get(features, F.get(which, at)) > F.get(where, at)).cast("int")
        return total + F.get(leaves, t * outer + node - inner)

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(trees) - 1)), F.lit(0.0), walk)


def threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest cut of held-out scores above which at least `precision` of the rows are positive, moved halfway to the
    next score below; infinite if there is none."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    last = np.flatnonzero(np.concatenate([s[1:] < s[:-1], [True]])) if len(s) else np.empty(0, int)
    good = [k for k in last if hit[k] >= precision * (k + 1)]
    if not good:
        return float("inf")
    k = good[-1]
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])
