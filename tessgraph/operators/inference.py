"""Labelings of region graphs that use edges: one graph of regions per image, solved where it lies.

Scores (image, sid, label, score), edges (image, hi, lo and bins), model as from models.pair_model. The energy of a
labeling is minus the sum of its node scores and pair weights, and every method looks for a small one. Images are
independent: they are grouped and solved in parallel; one task holds the region graph of one image, never its pixels.
Sums and ties are fixed: regions in order of sid, and the lowest class wins.
"""

from __future__ import annotations

from collections import deque
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

METHODS = ("max", "icm", "max_product", "mean_field", "sampling", "min_cut", "expansion", "exact")


def energy(u: np.ndarray, ends: np.ndarray, w: np.ndarray, y: np.ndarray) -> float:
    """u[node, class] scores, ends[edge] = (hi, lo), w[edge, class of hi, class of lo] weights."""
    return float(-u[np.arange(len(u)), y].sum() - (w[np.arange(len(ends)), y[ends[:, 0]], y[ends[:, 1]]].sum() if len(ends) else 0))


def around(n: int, ends: np.ndarray, w: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
    """Of each node its neighbors, with the weights as [own class, neighbor's class]."""
    out: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n)]
    for (a, b), t in zip(ends.tolist(), w, strict=True):
        out[a].append((b, t))
        out[b].append((a, t.T))
    return out


def icm(u: np.ndarray, ends: np.ndarray, w: np.ndarray, y: np.ndarray | None = None, sweeps: int = 10, least: float = 0.0) -> np.ndarray:
    """Iterated conditional modes: regions in order take their best class given their neighbors; ends when a sweep gains at most least."""
    y = np.argmax(u, 1) if y is None else y.copy()
    nb = around(len(u), ends, w)
    for _ in range(sweeps):
        gained = 0.0
        for i in range(len(u)):
            s = u[i] + sum((t[:, y[j]] for j, t in nb[i]), np.zeros(u.shape[1]))
            best = int(np.argmax(s))
            if s[best] > s[y[i]]:
                gained += s[best] - s[y[i]]
                y[i] = best
        if gained <= least:
            break
    return y


def max_product(u: np.ndarray, ends: np.ndarray, w: np.ndarray, rounds: int = 100, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """(labels, beliefs) by loopy max-product messages in the log domain, all edges at once in every round."""
    if not len(ends):
        return np.argmax(u, 1), u
    a, b = ends.T
    down, up = np.zeros((len(ends), u.shape[1])), np.zeros((len(ends), u.shape[1]))  # to lo, to hi

    def beliefs() -> np.ndarray:
        out = u.astype(float).copy()
        np.add.at(out, b, down)
        np.add.at(out, a, up)
        return out

    for _ in range(rounds):
        s = beliefs()
        new_down = (w + (s[a] - up)[:, :, None]).max(1)
        new_up = (w + (s[b] - down)[:, None, :]).max(2)
        new_down -= new_down.max(1, keepdims=True)
        new_up -= new_up.max(1, keepdims=True)
        change = max(np.abs(new_down - down).max(), np.abs(new_up - up).max())
        down, up = new_down, new_up
        if change < tolerance:
            break
    s = beliefs()
    return np.argmax(s, 1), s


def mean_field(u: np.ndarray, ends: np.ndarray, w: np.ndarray, rounds: int = 50, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """(labels, marginals) of the fully factorised approximation, regions updated in order."""
    soft = lambda s: np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    q = np.array([soft(s) for s in u.astype(float)]).reshape(u.shape)
    nb = around(len(u), ends, w)
    for _ in range(rounds):
        change = 0.0
        for i in range(len(u)):
            new = soft(u[i] + sum((t @ q[j] for j, t in nb[i]), np.zeros(u.shape[1])))
            change, q[i] = max(change, float(np.abs(new - q[i]).max())), new
        if change < tolerance:
            break
    return np.argmax(q, 1), q


def sampling(u: np.ndarray, ends: np.ndarray, w: np.ndarray, temperature: float = 0.001, sweeps: int = 1, chains: int = 1, seed: int = 0) -> np.ndarray:
    """Gibbs sweeps; chain k starts anew at temperature / 10^k and the labeling of the smallest energy, of the first chain in a tie, is kept."""
    nb, best = around(len(u), ends, w), None
    for k in range(chains):
        rng, y = np.random.default_rng([seed, k]), np.argmax(u, 1)
        for _ in range(sweeps):
            for i in range(len(u)):
                s = (u[i] + sum((t[:, y[j]] for j, t in nb[i]), np.zeros(u.shape[1]))) / (temperature / 10**k)
                p = np.exp(s - s.max())
                y[i] = rng.choice(len(p), p=p / p.sum())
        e = energy(u, ends, w, y)
        if best is None or e < best[0]:
            best = (e, y.copy())
    return best[1]


def submodular(w: np.ndarray, margin: float = 1e-8) -> bool:
    """Whether no edge of two classes gains by unequal labels, up to a margin."""
    return w.shape[1] == 2 and bool((w[:, 0, 1] + w[:, 1, 0] <= w[:, 0, 0] + w[:, 1, 1] + margin).all())


def max_flow(n: int, source: np.ndarray, sink: np.ndarray, arcs: list[tuple[int, int, float]]) -> np.ndarray:
    """Nodes on the source's side of a minimum cut, by shortest augmenting paths in layers."""
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, there: float, back: float = 0.0) -> None:
        out[a].append(len(to)), to.append(b), room.append(there)
        out[b].append(len(to)), to.append(a), room.append(back)

    for i in range(n):
        arc(n, i, float(source[i])), arc(i, n + 1, float(sink[i]))
    for a, b, c in arcs:
        arc(a, b, c)
    while True:
        layer, queue = {n: 0}, deque([n])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-12 and to[e] not in layer:
                    layer[to[e]] = layer[a] + 1
                    queue.append(to[e])
        if n + 1 not in layer:
            return np.array([i in layer for i in range(n)], bool)
        at, path, a = [0] * (n + 2), [], n
        while True:
            if a == n + 1:
                c = min(room[e] for e in path)
                for e in path:
                    room[e] -= c
                    room[e ^ 1] += c
                k = next(i for i, e in enumerate(path) if room[e] <= 1e-12)
                a, path = to[path[k] ^ 1], path[:k]
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if room[e] > 1e-12 and layer.get(to[e]) == layer[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(out[a]):
                path.append(out[a][at[a]])
                a = to[path[-1]]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                at[a] += 1
            else:
                break


def min_cut(u: np.ndarray, ends: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The labeling of smallest energy with two classes and no edge that gains by unequal labels; ties go to class 0."""
    if not submodular(w) and len(ends):
        raise ValueError("a minimum cut needs two classes and edges that do not gain by unequal labels")
    cost = (-u).astype(float)
    arcs = []
    for (a, b), t in zip(ends.tolist(), -w, strict=True):
        # t = t00 + (t10 - t00) [a=1] + (t11 - t10) [b=1] + rest [a=0, b=1]
        cost[a, 1] += t[1, 0] - t[0, 0]
        cost[b, 1] += t[1, 1] - t[1, 0]
        arcs.append((b, a, max(float(t[0, 1] + t[1, 0] - t[0, 0] - t[1, 1]), 0.0)))
    d = cost[:, 1] - cost[:, 0]
    return max_flow(len(u), np.maximum(-d, 0), np.maximum(d, 0), arcs).astype(int)


def expansion(u: np.ndarray, ends: np.ndarray, w: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Alpha-expansion: every class in turn may take over any regions by one minimum cut; moves that do not lower the energy are dropped."""
    y = np.argmax(u, 1)
    best = energy(u, ends, w, y)
    for _ in range(rounds):
        start = best
        for c in range(u.shape[1]):
            two = np.stack([u[np.arange(len(u)), y], u[:, c]], 1)
            a, b = (y[ends[:, k]] for k in (0, 1)) if len(ends) else (y[:0], y[:0])
            k = np.arange(len(ends))
            t = np.stack([np.stack([w[k, a, b], w[k, a, c]], 1), np.stack([w[k, c, b], w[k, c, c]], 1)], 1) if len(ends) else np.zeros((0, 2, 2))
            over = np.maximum(t[:, 0, 1] + t[:, 1, 0] - t[:, 0, 0] - t[:, 1, 1], 0)
            t[:, 0, 1] -= over  # what keeps the move from being a cut is taken from the pair that it makes worse
            new = np.where(min_cut(two, ends, t) == 1, c, y)
            e = energy(u, ends, w, new)
            if e < best - 1e-12:
                best, y = e, new
        if best >= start - 1e-12:
            break
    return y


def exact(u: np.ndarray, ends: np.ndarray, w: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """The first labeling of smallest energy, by trying all; an error beyond most of them."""
    n, k = u.shape
    if k**n > most:
        raise ValueError(f"{k}^{n} labelings are too many to try")
    return np.array(min(product(range(k), repeat=n), key=lambda y: energy(u, ends, w, np.array(y, int))), int)


def chosen(method: str, ends: np.ndarray, w: np.ndarray, cuts: bool = True) -> str:
    """The method to use: none of the edge methods without edges; a cut instead of messages where it is exact, if allowed."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if not len(ends):
        return "max"
    return "min_cut" if cuts and method in ("max_product", "icm") and submodular(w) else method


def solve(method: str, u: np.ndarray, ends: np.ndarray, w: np.ndarray, **options) -> np.ndarray:
    if method == "max":
        return np.argmax(u, 1)
    found = {"icm": icm, "max_product": max_product, "mean_field": mean_field, "sampling": sampling, "min_cut": min_cut, "expansion": expansion, "exact": exact}[method](u, ends, w, **options)
    return found[0] if isinstance(found, tuple) else found


def labeled(scores: DataFrame, edges: DataFrame, model: DataFrame, classes: int, method: str = "max_product", cuts: bool = True, **options) -> DataFrame:
    """image, sid, label of every region of every image, by one of METHODS.

    scores: image, sid, label, score; edges: image, hi, lo with the bins that model tells apart. Regions without a
    score for a class count 0 for it; edges to unknown regions are an error; an empty table gives an empty table."""
    bins = [c for c in ("distance_idx", "orientation_idx", "gradient_idx") if c in edges.columns]
    table: dict[tuple, np.ndarray] = {}
    for r in model.collect():  # a model: bins times classes squared
        if all(r[c] == 0 for c in ("distance_idx", "orientation_idx") if c not in bins):
            table.setdefault(tuple(r[c] for c in bins), np.zeros((classes, classes)))[r["pair"] // classes, r["pair"] % classes] = r["weight"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"image": [], "sid": [], "label": []}).astype("int64")
        sids = np.unique(left["sid"])
        u = np.zeros((len(sids), classes))
        u[np.searchsorted(sids, left["sid"]), left["label"]] = left["score"]
        right = right.sort_values(["hi", "lo"])
        ends = np.stack([np.searchsorted(sids, right["hi"]), np.searchsorted(sids, right["lo"])], 1) if len(right) else np.zeros((0, 2), int)
        if len(right) and not (np.isin(right["hi"], sids).all() and np.isin(right["lo"], sids).all()):
            raise ValueError("an edge ends at a region without scores")
        w = np.array([table[tuple(k)] for k in right[bins].itertuples(index=False)]) if len(right) else np.zeros((0, classes, classes))
        y = solve(chosen(method, ends, w, cuts), u, ends, w, **options)
        return pd.DataFrame({"image": left["image"].iloc[0], "sid": sids, "label": y})

    return scores.groupBy("image").cogroup(edges.groupBy("image")).applyInPandas(lambda a, b: run(a, b), "image long, sid long, label long")
