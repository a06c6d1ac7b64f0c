"""Statistics over time by blocks of steps, against plain loops and against one block."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from arbora import queries
from arbora.operators import counts, information, weights
from arbora.sources.events import K, N, planted
from conftest import DATA, rows_of

#: Steps with a gap, a null and values outside of 0..2.
ODD = [(1, 0, 1, 2), (2, 0, None, 2), (3, 0, 1, 2), (5, 5, 1, -4), (6, 0, 1, 2), (9, 5, 1, -4), (10, 2, 0, 0), (11, 0, 1, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "t long, v0 int, v1 int, v2 int")


@pytest.mark.parametrize("k", [None, 3])
@pytest.mark.parametrize("steps", [1, 3, 1 << 14])
def test_running_counts_by_a_plain_loop(odd, k, steps):
    """rows are dealt by block and not pair by pair, whatever the values."""
    known = lambda x: x is not None and (k is None or 0 <= x < k)
    one, two, seen = Counter(), Counter(), Counter()
    for t, *x in ODD:
        for i, u in enumerate(x):
            if known(u):
                one[t, i, u, seen[i, u]] += 1
                seen[i, u] += 1
            for j in range(i + 1, 3):
                if known(u) and known(x[j]):
                    two[t, i, j, u, x[j], seen[i, j, u, x[j]]] += 1
                    seen[i, j, u, x[j]] += 1
    assert Counter(map(tuple, counts.running_counts_1var(odd, k, steps).collect())) == one
    assert Counter(map(tuple, counts.running_counts_2var(odd, k, steps).collect())) == two
    grid, at = Counter(), Counter()
    for t, *x in ODD:
        for i, u in enumerate(x):
            if u is not None and 0 <= u < 3:
                at[i, u] += 1
                grid.update((t, i, v, at[i, v]) for v in range(3))
    assert Counter(map(tuple, counts.count_grid(odd, 3, steps).collect())) == grid


def test_rows_and_not_pairs_are_exchanged(spark):
    """no exchange has a row for each pair of each step."""
    wide = planted(spark, DATA)
    for df in (counts.running_counts_2var(wide), counts.count_grid(wide, K), information.phi_trajectory(wide, K), weights.weights_trajectory(wide, N, K, 1000)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "SortMergeJoin [t" not in plan
        assert all("t#" not in line.split("hashpartitioning(")[1].split(")")[0] for line in plan.split("\n") if "hashpartitioning(" in line)


def test_blocks_change_no_path(spark):
    wide = planted(spark, DATA).where("t <= 200")
    for path in (lambda steps: information.phi_trajectory(wide, K, steps), lambda steps: weights.weights_trajectory(wide, N, K, 1000, steps=steps), lambda steps: weights.weights_and_next(wide, N, K, 1000, steps=steps)):
        one, many = (rows_of(queries.rounded(path(steps))) for steps in (1 << 14, 33))
        assert one == many and len(one) == 200 * 15


def test_next_weights_are_those_of_the_join(spark):
    """values one step ahead, over the edges of blocks and over gaps, without a join of all rows."""
    wide = planted(spark, DATA).where("t <= 60 and t not in (10, 29, 30, 31)")
    joined = weights.weights_lead(weights.weights_trajectory(wide, N, K, 1000))
    assert rows_of(queries.rounded(weights.weights_and_next(wide, N, K, 1000, steps=10))) == rows_of(queries.rounded(joined))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (joined, weights.weights_and_next(wide, N, K, 1000))]
    assert "BroadcastHashJoin" not in plans[0] and "Join" not in plans[1]


@pytest.mark.parametrize("k, retries", [(3, 1), (5, 1), (5, 4), (9, 3)])
def test_factors_are_those_of_the_columns(spark, k, retries):
    import numpy as np

    c = weights.constants(4, k, 100)
    rows = spark.range(1, 400).select(F.col("id").alias("t"), F.lit(1).alias("i"), F.lit(3).alias("j"), (F.col("id") % k).cast("int").alias("u"), (F.col("id") * 7 % 11 % k).cast("int").alias("v"))
    got = rows.withColumn("p", weights.observed_factor(4, k, c, 7, retries)).orderBy("t").toPandas()
    want = weights.factors(got["t"].to_numpy(), (1, 3), got["u"].to_numpy().astype(np.int64), got["v"].to_numpy().astype(np.int64), 4, k, c, 7, retries)
    assert want == pytest.approx(got["p"].to_numpy(), abs=1e-15)


def test_losses_by_a_plain_loop(odd):
    seen, total = defaultdict(int), defaultdict(float)
    want = {}
    for t, *x in ODD:
        for i in range(3):
            for j in range(i + 1, 3):
                u, v = x[i], x[j]
                phi = math.log(1e-300)
                if u is not None and v is not None and 0 <= u < 3 and 0 <= v < 3:
                    ci, cj = sum(seen[i, j, u, y] for y in range(3)), sum(seen[i, j, y, v] for y in range(3))
                    phi = math.log((ci + 0.5) / (t + 0.5) * (cj + 0.5) / (t + 0.5) / ((seen[i, j, u, v] + 0.5) / (t + 3.5)))
                    seen[i, j, u, v] += 1
                total[i, j] += phi
                want[t, i, j] = total[i, j]
    got = {(r["t"], r["i"], r["j"]): r["cum_phi"] for r in information.phi_trajectory(odd, 3, 2).collect()}
    assert got == pytest.approx(want, abs=1e-9)
