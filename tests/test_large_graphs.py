"""Graphs beyond one task, typed state, direction of trees, and logarithms of weights."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.operators import information, joins, large_graphs, metrics
from arbora.operators.counts import cpt
from arbora.operators.local_trees import is_tree
from arbora.sources.events import K, N, natural, planted
from conftest import DATA, rows_of
from test_learning import K4, MARGINALS


def edges_of(spark, weight):
    return spark.createDataFrame([(i, j, float(x)) for (i, j), x in weight.items()], "i int, j int, weight double")


def test_first_rings_have_the_law(spark):
    """Exits of a vertex are proportional to its weights, and those of its next draw are others."""
    n = 6000
    weight = {1: 1.0, 2: 2.0, 3: 5.0}
    runs = spark.range(n).select(F.explode(F.array(*(F.struct(F.lit(v).alias("v"), F.lit(w).alias("w")) for v, w in weight.items()))).alias("e"), "id")
    for pops in (0, 1):
        ring = large_graphs.waiting(F.col("id"), F.col("e.v"), F.lit(pops), F.ln("e.w"), 5).alias("at")
        got = Counter(r["v"] for r in runs.groupBy("id").agg(F.min(F.struct(ring, F.col("e.v").alias("v"))).alias("m")).select("m.v").collect())
        for v, w in weight.items():
            assert abs(got[v] / n - w / 8) < 4.5 * math.sqrt(w / 8 * (1 - w / 8) / n)


def test_popped_trees_have_the_law(spark):
    """Many copies of a graph of four vertices, joined at the root, are one graph with as many independent trees."""
    copies = 1500
    place = lambda c, v: 0 if v == 0 else 3 * c + v
    rows = [(place(c, i), place(c, j), w) for c in range(copies) for (i, j), w in K4.items()]
    tree = large_graphs.popped_tree(spark.createDataFrame(rows, "i int, j int, weight double"), 3 * copies + 1, 11).collect()
    assert is_tree([(r["i"], r["j"]) for r in tree], 3 * copies + 1)
    seen = Counter()
    for r in tree:
        seen[tuple(sorted(0 if v == 0 else (v - 1) % 3 + 1 for v in (r["i"], r["j"])))] += 1
    for e, p in MARGINALS.items():
        assert abs(seen[e] / copies - p) < 4.5 * math.sqrt(p * (1 - p) / copies)


@pytest.mark.parametrize("root", [0, 3])
def test_cycles_by_joins_are_those_of_one_task(spark, root):
    rng = np.random.default_rng(4)
    n = 40
    exits = spark.createDataFrame([(v, int(rng.choice([u for u in range(n) if u != v]))) for v in range(n) if v != root], "v long, nxt long")
    here = rows_of(large_graphs.on_cycles(exits, n, root))
    assert here == rows_of(large_graphs.on_cycles(exits, n, root, local=0)) and sum(here.values()) > 1


def test_popped_tree_by_joins_only(spark):
    w = edges_of(spark, {(i, j): 1 + (i * 7 + j) % 5 for i in range(6) for j in range(i + 1, 6)})
    tree = large_graphs.popped_tree(w, 6, 3)
    assert is_tree([tuple(r) for r in tree.collect()], 6)
    assert rows_of(tree) == rows_of(large_graphs.popped_tree(w, 6, 3, local=0))


def test_popped_tree_without_edges_goes_anywhere(spark):
    w = spark.createDataFrame([(0, 1, -3000.0), (1, 2, -9000.0)], "i int, j int, log_weight double")
    tree = [tuple(r) for r in large_graphs.popped_tree(w, 5, 3).collect()]
    assert is_tree(tree, 5) and (1, 2) in tree


@pytest.mark.parametrize(("n", "block"), [(500, 128), (30, 7), (9, 16)])
def test_log_partition_by_blocks(spark, n, block):
    rng = np.random.default_rng(n)
    pairs = [(i, i + 1) for i in range(n - 1)] + [tuple(sorted(rng.choice(n, 2, replace=False).tolist())) for _ in range(4 * n)]
    weight = {e: float(rng.uniform(0.1, 4)) for e in pairs}
    m = np.zeros((n, n))
    for (i, j), x in weight.items():
        m[i, j] = m[j, i] = x
    minor, want = (np.diag(m.sum(axis=1)) - m)[1:, 1:], 0.0
    for p in range(n - 1):
        want += math.log(minor[p, p])
        minor[p + 1 :, p + 1 :] -= minor[p + 1 :, p, None] * minor[p, None, p + 1 :] / minor[p, p]
    got = large_graphs.log_partition(edges_of(spark, weight), n, root=n // 2, block=block).first()[0]
    assert got == pytest.approx(want, rel=1e-10)


def test_log_partition_of_no_tree(spark):
    w = edges_of(spark, {(0, 1): 2.0, (1, 2): 3.0})
    assert large_graphs.log_partition(w, 4).first()[0] == -math.inf
    m = np.array([[5.0, -3.0, 0.0], [-3.0, 3.0, 0.0], [0.0, 0.0, 0.0]]) + 0.1 * np.eye(3)
    assert large_graphs.log_partition(w, 4, floor=0.1, block=2).first()[0] == pytest.approx(np.linalg.slogdet(m)[1])
    small = spark.createDataFrame([(0, 1, -2000.0), (1, 2, -2001.0)], "i int, j int, log_weight double")
    assert large_graphs.log_partition(small, 3).first()[0] == pytest.approx(-4001)


def test_lookup_of_frequent_keys(spark):
    rows = spark.createDataFrame([(k, 7 if k % 2 else k) for k in range(3000)], "v long, at long")
    table = spark.createDataFrame([(k, k * k) for k in range(0, 3000, 7)], "to long, square long")
    got = rows_of(joins.looked_up(rows, "at", table, "to"))
    assert got == rows_of(rows.join(table, rows["at"] == table["to"])) and sum(got.values()) > 1500


def test_typed_state_after_a_stop(spark, tmp_path):
    """A stream that ended in the middle goes on from its store, and ends where the closed form does."""
    from arbora.streaming import stateful

    wide = natural(spark, DATA).where("t <= 90")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(wide.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    before = spark.conf.get(stateful.PROVIDER)
    for first in (1, 46):
        for a in range(first, first + 45, 15):
            wide.where(F.col("t").between(a, a + 14)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = stateful.drained_with_rocksdb(stateful.loss_stream(stream, 4), str(tmp_path / "out"))
        last = {(r["i"], r["j"]): r["cum_phi"] for r in got.where(F.col("t") == first + 44).collect()}
        want = {(r["i"], r["j"]): r["cum_phi"] for r in information.phi_terminal(wide.where(F.col("t") <= first + 44), 4).collect()}
        assert last == pytest.approx(want, abs=1e-9) and len(last) == 10
    assert got.count() == 900 and spark.conf.get(stateful.PROVIDER) == before


def test_trees_are_directed_away_from_their_roots(spark):
    tree = spark.createDataFrame([(0, 3), (1, 3), (1, 4), (5, 6)], "i int, j int")
    assert rows_of(metrics.oriented(tree, 4)) == Counter([(1, 4), (3, 1), (0, 3), (6, 5)])  # columns by name: child, parent
    with pytest.raises(ValueError, match="cycle"):
        metrics.oriented(spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "i int, j int"), 0)


def test_rooted_score_is_the_same_for_every_root(spark):
    """Tables of counts without zeros: a tree's score doesn't depend on its root, and is that of the joint distribution."""
    wide = planted(spark, DATA)
    tree = spark.createDataFrame([(0, 1), (1, 3), (2, 5)], "i int, j int")
    got = [metrics.rooted_log_likelihood(wide, wide, tree, N, K, root).first()[0] for root in (0, 3, 5)]
    assert got == pytest.approx([got[0]] * 3, abs=1e-9)
    mi = {(r["i"], r["j"]): r["mi"] for r in information.mutual_information(wide).collect()}
    own = 0.0
    for v in range(N):
        counts = [r["count"] for r in wide.groupBy(f"v{v}").count().collect()]
        own += sum(c / 1000 * math.log(c / 1000) for c in counts)
    assert got[0] == pytest.approx(own + mi[0, 1] + mi[1, 3] + mi[2, 5], abs=1e-9)
    assert metrics.rooted_log_likelihood(wide.where("t < 0"), wide, tree, N, K).first()[0] is None
    assert cpt(wide, N, K).where("prob = 0").count() == 0
