"""Trees of many runs at once are those of one run after another."""

import numpy as np
import pytest

from arbora.functions.portable import Draws
from arbora.operators import blocks, local_trees, trees


@pytest.mark.parametrize("n, most", [(2, None), (4, 3), (6, None), (9, None)])
def test_walks_of_many_runs(n, most):
    """all walk at once; logarithms far apart, edges that are missing, vertices without any."""
    rng = np.random.default_rng(n)
    w = rng.normal(size=(60, n, n)) * np.repeat([1, 100, 3000], 20)[:, None, None]
    w[rng.random(w.shape) < 0.1] = -np.inf
    w[7] = -np.inf
    w = np.maximum(w, w.transpose(0, 2, 1))
    w[:, np.arange(n), np.arange(n)] = -np.inf
    runs = np.arange(60) + 5_999_950
    row, i, j, fallbacks, walks = local_trees.trees_by_walks(w, runs, 7, 0, most)
    for r in range(60):
        tree, fell, walked = local_trees.tree_by_walks(w[r], Draws(7, int(runs[r])), 0, most)
        assert sorted(zip(i[row == r].tolist(), j[row == r].tolist(), strict=True)) == sorted(tree) and (fallbacks[r], walks[r]) == (fell, walked)


@pytest.mark.parametrize("largest", [False, True])
@pytest.mark.parametrize("skip_zero", [False, True])
def test_forests_of_many_runs(largest, skip_zero):
    i, j = blocks.pair_ends(6)
    w = np.random.default_rng(1).integers(0, 4, size=(200, 15)).astype(float)
    chosen = local_trees.spanning_forests(i, j, w, 6, largest, skip_zero)
    for x, c in zip(w.tolist(), chosen, strict=True):
        want = local_trees.spanning_forest(zip(x, i.tolist(), j.tolist(), strict=True), 6, largest, skip_zero)
        assert sorted(want) == sorted(zip(i[c].tolist(), j[c].tolist(), strict=True))


def test_runs_of_the_same_and_of_other_edges(spark, monkeypatch):
    """Runs are taken at once where they agree in their edges, and one by one elsewhere, over the edges of batches."""
    rows = [(r, i, j, float((r * 7 + i * 3 + j * 5) % 11)) for r in range(3000) for i, j in blocks.pairs_of(4) if r != 1700 or j < 3]
    w = spark.createDataFrame(rows, "run long, i int, j int, weight double").coalesce(1)
    by = {}
    for r, i, j, x in rows:
        by.setdefault(r, []).append((x, i, j))
    for held in (100, 1 << 17):
        monkeypatch.setattr(trees, "HELD", held)
        got = {}
        for r in trees.spanning_tree(w, 4, run="run").collect():
            got.setdefault(r["run"], []).append((r["i"], r["j"]))
        assert {r: sorted(x) for r, x in got.items()} == {r: sorted(local_trees.spanning_forest(x, 4)) for r, x in by.items()}


def test_trajectories_are_the_trees_of_their_weights(spark):
    """trees taken within blocks are those of the weights of all steps, and need no exchange of all edges."""
    from arbora.plans.learners import ForestDensity, PlainForestDensity, WalkMajority
    from arbora.sources.events import K, planted
    from conftest import DATA, rows_of

    for kind in (ForestDensity, PlainForestDensity, WalkMajority):
        learner = kind(planted(spark, DATA), K, 7)
        assert rows_of(learner.trajectory(150)) == rows_of(learner.structure(learner.all_weights(150), "t").select("t", "i", "j"))
