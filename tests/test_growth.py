"""Queries whose work must grow no faster than their tables."""

import numpy as np

from arbora.functions.portable import Draws, uniform
from arbora.operators import trees
from arbora.sources import synthetic
from conftest import rows_of
from pyspark.sql import functions as F


def test_rounding_reads_its_trees_once(spark, tmp_path):
    """blocks run at once over one reading of the trees, and agree with one block whatever their lead."""
    rng = np.random.default_rng(3)
    rows = [(t, a, b) for t in range(1, 401) for a, b in [((0, 1), (0, 2), (1, 2))[x] for x in rng.choice(3, 2, replace=False)] if t != 250]
    read = spark.sparkContext.accumulator(0)
    frame = spark.createDataFrame(rows, "t long, i int, j int")

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    want = rows_of(trees.rounding_steps(frame, 3, 400, 7))
    assert sum(want.values()) == 1200
    for block, lead in ((64, 64), (150, 40)):
        read.value = 0
        assert rows_of(trees.rounding_steps(frame.mapInArrow(counted, frame.schema), 3, 400, 7, block, lead)) == want
        assert read.value <= 2 * len(rows)
    # a lead that is too short is found out
    assert rows_of(trees.rounding_steps(frame, 3, 400, 7, 100, 1)) == want


def test_graphs_of_many_vertices(spark):
    """numbers of edges go beyond 32 bits."""
    n = 60_000
    got = synthetic.random_graph(spark, n, 42).where(f"i >= {n - 30}")
    pairs = spark.range(n - 30, n).select(F.col("id").alias("i")).crossJoin(spark.range(n - 30, n).select(F.col("id").alias("j"))).where("i < j")
    assert rows_of(got) == rows_of(pairs.where(uniform(F.col("i") * n + F.col("j"), 42) < 0.6))
    assert synthetic.random_graph(spark, 1, 42).count() == 0 == synthetic.random_graph(spark, 0, 42).count()


def test_samples_by_a_plain_loop(spark):
    """samples that are drawn together are those drawn one by one."""
    edges, n = [(0, 2), (1, 2), (2, 3), (3, 4)], 5
    near = np.zeros((n, n), dtype=bool)
    for a, b in edges:
        near[a, b] = near[b, a] = True
    for k, by_insertion in ((2, False), (3, True), (9, False)):
        want = []
        for t in range(11, 211):
            rng = Draws(22, t)
            root = int(rng.random() * n)
            x = np.full(n, -1)
            x[root] = int(rng.random() > 0.2)
            for v in range(n):
                if v != root:
                    seen = x[near[v] & (x >= 0)]
                    p = 0.7 * np.bincount(seen, minlength=k)[:k] / len(seen) + (1 - 0.7) / k if len(seen) else np.full(k, 1 / k)
                    x[v] = min(int(np.searchsorted(np.cumsum(p / p.sum()), rng.random(), side="right")), k - 1)
            x = np.where(np.array([rng.random() for _ in range(n)]) > 0.4, x, k - 1 - x)
            want.append((t, *(x[[root, *(v for v in range(n) if v != root)]] if by_insertion else x).tolist()))
        got = synthetic.samples(spark, edges, n, k, 200, 0.4, first=11, by_insertion=by_insertion)
        assert sorted(map(tuple, got.collect())) == want


def test_trees_of_lists_in_sql(spark):
    """one statement takes many runs at once, without a partition for each."""
    from arbora.functions import tables
    from arbora.operators.blocks import pairs_of

    tables.register(spark)
    rows = [(r, i, j, float((r * 7 + i * 3 + j * 5) % 11)) for r in range(300) for i, j in pairs_of(4)]
    w = spark.createDataFrame(rows, "run long, i int, j int, weight double")
    lists = w.groupBy("run").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "j", "weight"))), lambda x: x["weight"]).alias("weights"))
    got = spark.sql("SELECT * FROM minimum_trees(TABLE(SELECT run, weights FROM {w}))", w=lists)
    assert rows_of(got) == rows_of(trees.spanning_tree(w, 4, run="run"))
