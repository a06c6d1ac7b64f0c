"""Spanning-tree algorithms over one small weight matrix: what runs inside a group.

Random trees and their sums take the logarithms of weights, as weights may lie below any double.

An edge relation has n * (n - 1) / 2 rows whatever the number of observations, so one tree is
the work of one task, and many trees (one per run or step) are grouped by their key.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

import numpy as np

from arbora.functions.portable import Draws, numbers

Edge = tuple[int, int]


class Random(Protocol):
    """Anything that draws from [0, 1): a generator of numpy, or portable.Draws."""

    def random(self) -> float: ...


class Forest:
    """Disjoint sets; ``join`` tells whether the two were apart."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.weight = [1] * n

    def top(self, x: int) -> int:
        root = x
        while self.up[root] != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a == b:
            return False
        if self.weight[a] < self.weight[b]:
            a, b = b, a
        self.up[b] = a
        self.weight[a] += self.weight[b]
        return True


def spanning_forest(edges: Iterable[tuple[float, int, int]], n: int, largest: bool = False, skip_zero: bool = False) -> list[Edge]:
    """Kruskal's forest. Ties go by (weight, i, j), all descending for the largest."""
    forest, out = Forest(n), []
    for w, i, j in sorted(edges, reverse=largest):
        if (w or not skip_zero) and forest.join(i, j):
            out.append((min(i, j), max(i, j)))
            if len(out) == n - 1:
                break
    return out


def matrix(i: np.ndarray, j: np.ndarray, log_weight: np.ndarray, n: int) -> np.ndarray:
    """Logarithms of a symmetric matrix of weights; minus infinity where there is no edge."""
    w = np.full((n, n), -np.inf)
    w[i, j] = w[j, i] = log_weight
    np.fill_diagonal(w, -np.inf)
    return w


def log_sum(x: np.ndarray) -> float:
    top = x.max(initial=-np.inf)
    return float(top + np.log(np.exp(x - top).sum())) if top > -np.inf else -np.inf


def log_minor(w: np.ndarray, floor: float = 0.1) -> float:
    """ln det of the Laplacian without row and column 0, from the logarithms of the weights.

    Vertices are taken out one by one: the weights at one are added up to a pivot, and every two of its
    neighbours get an edge of the product of theirs, divided by the pivot. Nothing is subtracted, so
    no digit is lost however far the weights lie apart. A singular minor, that of a graph that is not
    connected, gets ``floor`` added to its diagonal: an edge of that weight from each vertex to 0.
    """
    a, total = w.copy(), 0.0
    for v in range(len(a) - 1, 0, -1):
        near = a[v, :v]
        pivot = log_sum(near)
        if pivot == -np.inf:
            if not floor:
                return -np.inf
            grounded = w.copy()
            grounded[0, 1:] = grounded[1:, 0] = np.logaddexp(w[0, 1:], np.log(floor))
            return log_minor(grounded, 0.0)
        total += pivot
        a[:v, :v] = np.logaddexp(a[:v, :v], near[:, None] + (near[None, :] - pivot))
    return total


def tree_by_determinants(w: np.ndarray, rng: Random, epsilon: float = 0.1) -> list[Edge]:
    """A spanning tree drawn with probability proportional to the product of its weights; ``w`` has their logarithms.

    Edges at vertex 0 are looked at in turn. One is left out with the probability that a tree
    avoids it (a ratio of determinants) or else taken, and its ends become one vertex. Of two
    edges that meet by this, one is drawn to stand for both, by weight; ``epsilon`` is added to
    that draw's total and to singular minors (0 is the exact law).
    """
    w = w.copy()
    names = {(a, b): (a, b) for a in range(len(w)) for b in range(a + 1, len(w))}
    extra = np.log(epsilon) if epsilon else -np.inf
    tree: list[Edge] = []
    at = 1
    while len(w) > 1:
        near = np.flatnonzero(w[0] > -np.inf)
        if not len(near):
            raise ValueError("the graph is not connected: no tree can be drawn")
        if len(near) == 1:
            at = int(near[0])
        elif at >= len(w):
            at = 1
        if len(near) > 1:
            without = w.copy()
            without[0, at] = without[at, 0] = -np.inf
            if w[0, at] == -np.inf or rng.random() < np.exp(log_minor(without, epsilon) - log_minor(w, epsilon)):
                w, at = without, at + 1
                continue
        tree.append(names[0, at])
        # the two ends become vertex 0; the others keep their order
        rest = [x for x in range(1, len(w)) if x != at]
        merged = np.full((len(rest) + 1, len(rest) + 1), -np.inf)
        merged[1:, 1:] = w[np.ix_(rest, rest)]
        merged[0, 1:] = merged[1:, 0] = np.logaddexp(w[0, rest], w[at, rest])
        renamed = {(a + 1, b + 1): names[rest[a], rest[b]] for a in range(len(rest)) for b in range(a + 1, len(rest))}
        for a, x in enumerate(rest):
            own = rng.random() < (np.exp(w[0, x] - np.logaddexp(merged[0, a + 1], extra)) if w[0, x] > -np.inf else 0.0)
            renamed[0, a + 1] = names[0, x] if own else names[min(at, x), max(at, x)]
        w, names, at = merged, renamed, 1
    return [(min(e), max(e)) for e in tree]


def tree_by_walks(w: np.ndarray, rng: Random, root: int = 0, most_steps: int | None = None) -> tuple[list[Edge], int, int]:
    """Wilson's loop-erased walks over the logarithms of weights: (tree, walks that fell back to uniform steps, walks).

    A step depends on the weights at one vertex only, which are raised relative to their largest. A walk of more
    than ``most_steps`` steps (2 * n * n), and any step from a vertex without weight, goes on uniformly.
    """
    n = len(w)
    most = 2 * n * n if most_steps is None else most_steps
    top = w.max(axis=1)
    w = np.exp(w - np.where(top > -np.inf, top, 0.0)[:, None])
    cdf, total = np.cumsum(w, axis=1), w.sum(axis=1)
    inside = np.zeros(n, dtype=bool)
    inside[root] = True
    step_to = np.full(n, -1)
    tree, fallbacks, walks = [], 0, 0
    for start in range(n):
        if inside[start]:
            continue
        walks += 1
        v, steps = start, 0
        while not inside[v]:
            if steps < most and total[v] > 0:
                u = int(np.searchsorted(cdf[v], rng.random() * total[v], side="right"))
            else:
                u = int(rng.random() * (n - 1))
                u += u >= v
            step_to[v] = min(u, n - 1)  # the last exit from a vertex is what loop erasure leaves
            v, steps = int(step_to[v]), steps + 1
        fallbacks += steps > most
        v = start
        while not inside[v]:
            inside[v] = True
            u = int(step_to[v])
            tree.append((min(u, v), max(u, v)))
            v = u
    return tree, fallbacks, walks


def spanning_forests(i: np.ndarray, j: np.ndarray, weights: np.ndarray, n: int, largest: bool = False, skip_zero: bool = False) -> np.ndarray:
    """Which edges are in ``spanning_forest``, for each row of ``weights``; the edges (i, j), i < j, are in order."""
    runs, m = weights.shape
    order = m - 1 - np.argsort(-weights[:, ::-1], axis=1, kind="stable") if largest else np.argsort(weights, axis=1, kind="stable")
    part, chosen, at = np.tile(np.arange(n), (runs, 1)), np.zeros((runs, m), dtype=bool), np.arange(runs)
    for rank in range(m):
        edge = order[:, rank]
        a, b = part[at, i[edge]], part[at, j[edge]]
        apart = a != b if not skip_zero else (a != b) & (weights[at, edge] != 0)
        chosen[at, edge] = apart
        rows = np.flatnonzero(apart)
        own = part[rows]
        part[rows] = np.where(own == b[rows, None], a[rows, None], own)
    return chosen


def trees_by_walks(w: np.ndarray, runs: np.ndarray, seed: int, root: int = 0, most_steps: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``tree_by_walks`` of many matrices with Draws(seed, run), all walking at once: (row, i, j) of each edge, fallbacks and walks by row."""
    rows, n, _ = w.shape
    most = 2 * n * n if most_steps is None else most_steps
    top = w.max(axis=2)
    w = np.exp(w - np.where(top > -np.inf, top, 0.0)[:, :, None])
    cdf, total = np.cumsum(w, axis=2), w.sum(axis=2)
    inside = np.zeros((rows, n), dtype=bool)
    inside[:, root] = True
    step_to = np.full((rows, n), -1)
    drawn = runs.astype(np.int64) * Draws.STRIDE
    fallbacks, walks, edges = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64), []
    for start in range(n):
        begun = np.flatnonzero(~inside[:, start])
        walks[begun] += 1
        at, v, steps = begun, np.full(len(begun), start), 0
        while len(at):
            x = numbers(drawn[at], seed)
            drawn[at] += 1
            u = (x * (n - 1)).astype(np.int64)
            u += u >= v
            if steps < most:
                own = total[at, v]
                u = np.where(own > 0, (cdf[at, v] <= (x * own)[:, None]).sum(axis=1), u)
            u = np.minimum(u, n - 1)
            step_to[at, v] = u
            steps += 1
            there = inside[at, u]
            if steps > most:
                fallbacks[at[there]] += 1
            at, v = at[~there], u[~there]
        at, v = begun, np.full(len(begun), start)
        while len(at):
            inside[at, v] = True
            u = step_to[at, v]
            edges.append((at, np.minimum(u, v), np.maximum(u, v)))
            on = ~inside[at, u]
            at, v = at[on], u[on]
    row, i, j = (np.concatenate(x) for x in zip(*edges, strict=True)) if edges else (np.zeros(0, dtype=np.int64),) * 3
    return row, i, j, fallbacks, walks


def swap_rounded(x: np.ndarray, rng: Random) -> np.ndarray:
    """Pairs of fractional entries trade mass, keeping sum and mean, until one at most is left.

    Of a pair one entry rises and the other falls by the same amount until either is 0 or 1; which
    one rises is drawn such that neither moves on average. One trade settles an entry at least.
    """
    x = x.astype(float).copy()
    for _ in range(2 * len(x)):
        open_ = np.flatnonzero((x > 1e-10) & (x < 1 - 1e-10))
        if len(open_) < 2:
            break
        i = open_[int(rng.random() * len(open_))]
        others = open_[open_ != i]
        j = others[int(rng.random() * len(others))]
        rise, fall = min(1 - x[i], x[j]), min(x[i], 1 - x[j])  # what i may gain, or lose, to j
        total = x[i] + x[j]
        up = rng.random() * (rise + fall) < fall
        x[i] = x[i] + rise if up else x[i] - fall
        x[j] = total - x[i]
    return x


def tree_from_code(code: np.ndarray) -> list[Edge]:
    """The labelled tree that a Pruefer code of length n - 2 stands for."""
    n, code = len(code) + 2, np.asarray(code, dtype=np.int64)
    left = np.bincount(code, minlength=n) + 1
    out = []
    for x in code.tolist():
        leaf = int(np.flatnonzero(left == 1)[0])
        out.append((min(leaf, x), max(leaf, x)))
        left[leaf], left[x] = 0, left[x] - 1
    a, b = np.flatnonzero(left == 1).tolist()
    return [*out, (a, b)]


def is_tree(edges: list[Edge], n: int) -> bool:
    forest = Forest(n)
    return len(edges) == n - 1 and all(forest.join(a, b) for a, b in edges)
