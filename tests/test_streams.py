"""What a stream holds of an edge: rows in any order leave piece by piece."""

import numpy as np
import pandas as pd
import pytest

from arbora.operators import trees
from arbora.operators.blocks import pair_ends
from arbora.streaming import online
from conftest import rows_of
from pyspark.sql import functions as F


def frames(t, size=7):
    return [pd.DataFrame({"t": t[a : a + size], "u": t[a : a + size] % 3}) for a in range(0, len(t), size)]


@pytest.mark.parametrize("last, n", [(0, 1), (0, 100), (37, 64), (5, 63), (0, 0)])
def test_rows_in_any_order(last, n):
    """F4 to F8: the rows of a batch leave in order, and in pieces."""
    t = np.random.default_rng(n).permutation(n) + last + 1
    got = list(online.in_order(frames(t), last, {"u": "int32"}, piece=16))
    assert [x for steps, _ in got for x in steps.tolist()] == list(range(last + 1, last + 1 + n))
    assert all(len(steps) <= 16 and (u == steps % 3).all() for steps, u in got)


def test_pieces_leave_before_the_last_row_is_there():
    """F4 to F8: rows that come in order aren't held, however many there are."""
    read = []

    def batches():
        for x in frames(np.arange(1, 10_001), 10):
            read.append(len(x))
            yield x

    for k, (steps, _) in enumerate(online.in_order(batches(), 0, {"u": "int8"}, piece=100)):
        assert len(steps) == 100 and sum(read) == 100 * (k + 1)


@pytest.mark.parametrize("t", [[1, 3], [2, 3], [1, 1], [1, 2, 2], [0, 1], [1, 2, 40], [*range(1, 33), 5], [*range(17, 33)]])
def test_gaps_and_repeats_are_errors(t):
    with pytest.raises(ValueError, match="without gap or repeat"):
        list(online.in_order(frames(np.array(t)), 0, {"u": "int8"}, piece=16))


@pytest.mark.parametrize("order", ["rising", "falling", "any", "every other"])
def test_steps_go_to_an_edge_together(spark, order):
    """F3 to F6: an edge gets few rows, each of about 1 KB, whatever the order of the table, and every step of them."""
    n, k = 20_000, 3
    rng = np.random.default_rng(1)
    t = {"rising": np.arange(1, n + 1), "falling": np.arange(n, 0, -1), "any": rng.permutation(n) + 1, "every other": 2 * np.arange(n) + 1}[order]
    wide = pd.DataFrame({"t": t, **{f"v{i}": rng.integers(0, k, n).astype("int32") for i in range(3)}})
    wide.loc[wide["t"] == 7, "v1"] = k  # a step that pairs with v1 don't have
    rows = online.packed_pairs(spark.createDataFrame(wide, "t long, v0 int, v1 int, v2 int").repartition(2), k).toPandas()
    assert len(rows) <= 3 * (n / online.APART + 4) and rows["cells"].map(len).max() <= online.FOLLOWING and rows["steps"].map(len).max() <= 8 * online.APART
    for (i, j), own in rows.groupby(["i", "j"]):
        got = pd.concat(online.unpacked([own], online.code_type(k))).sort_values("t")
        want = wide[(wide[f"v{i}"] < k) & (wide[f"v{j}"] < k)].sort_values("t")
        assert got["t"].tolist() == want["t"].tolist() and (got["cell"].to_numpy() == (want[f"v{i}"] * k + want[f"v{j}"]).to_numpy()).all()


@pytest.mark.parametrize(("k", "size"), [(1, 1), (16, 1), (17, 2), (300, 4)])
def test_cells_of_any_alphabet_fit(k, size):
    cells = np.array([0, k * k - 1], dtype=online.code_type(k))
    assert cells.dtype.itemsize == size and cells.tolist() == [0, k * k - 1]


def test_lists_of_steps_hold_what_steps_hold():
    """F3 to F6: the values of GRID steps leave in one row."""
    t, path = np.arange(5, 5 + 300), np.arange(300) / 7
    one, many = (online.given((0, 2), t, "x", path, lists) for lists in (False, True))
    assert len(one) == 300 and len(many) == -(-300 // online.GRID) and np.concatenate(many["x"].tolist()).tolist() == one["x"].tolist()
    assert many["t"].tolist() == t[:: online.GRID].tolist() and (many[["i", "j"]] == [0, 2]).all(axis=None)


def test_trees_of_lists_are_those_of_rows(spark):
    """the trees of a batch of lists, also where an edge has no value at the last steps."""
    rng = np.random.default_rng(5)
    pairs, steps = [(i, j) for i in range(4) for j in range(i + 1, 4)], np.arange(online.PIECE - 150, online.PIECE + 151)
    rows = [online.given(e, own := steps[: len(steps) - (10 if e == (1, 2) else 0)], "x", rng.random(len(own)), True) for e in pairs]
    batch = spark.createDataFrame([(r.t, r.i, r.j, r.x.tolist()) for r in pd.concat(rows).itertuples()], "t long, i int, j int, x array<double>").repartition(3)
    flat = batch.select("t", "i", "j", F.posexplode("x").alias("pos", "weight")).select((F.col("t") + F.col("pos")).alias("t"), "i", "j", "weight")
    got = online.by_steps(batch, 4, "x", lambda t, w: trees.known_forests(t, w, 4))
    assert rows_of(got) == rows_of(trees.spanning_tree(flat, 4, run="t")) and got.count() == 3 * len(steps)
    got = online.by_steps(batch, 4, "x", lambda t, w: trees.walks(t, (*pair_ends(4), w), 4, 7)[:3])
    assert rows_of(got) == rows_of(trees.walk_tree(flat.withColumnRenamed("weight", "log_weight"), 4, 7, run="t").select("t", "i", "j"))
