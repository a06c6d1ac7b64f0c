"""Hand-checked values, laws of the samplers, edge cases, files and streams."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arbora.operators import counts, graph, information, local_trees as local, metrics, trees, weights
from arbora.operators.encode import checked, renamed
from arbora.plans.learners import LEARNERS, ChowLiu, ForestDensity, WeightedMajority, evaluate
from arbora.sources import files, synthetic
from arbora.sources.events import K, N, TREE, planted, true_tree
from conftest import DATA, rows_of

K4 = {(0, 1): 1.0, (0, 2): 2.0, (0, 3): 3.0, (1, 2): 4.0, (1, 3): 5.0, (2, 3): 6.0}
MARGINALS = {(0, 1): 0.237410, (0, 2): 0.413669, (0, 3): 0.561151, (1, 2): 0.539568, (1, 3): 0.611511, (2, 3): 0.636691}


@pytest.fixture(scope="module")
def micro(spark):
    return spark.createDataFrame([(1, 0, 0, 1), (2, 1, 1, 0), (3, 0, 0, 0), (4, 1, 0, 1)], "t long, v0 int, v1 int, v2 int")


def by_edge(df, value):
    return {(r["i"], r["j"]): r[value] for r in df.collect()}


def test_micro_information(micro):
    mi = by_edge(information.mutual_information(micro), "mi")
    assert mi == {(0, 1): pytest.approx(0.215762, abs=1e-6), (0, 2): pytest.approx(0, abs=1e-12), (1, 2): pytest.approx(0.215762, abs=1e-6)}
    want = {1: (0, 0, 0), 2: (-0.980829, -0.980829, -0.980829), 3: (-1.386294, -0.287682, -0.287682), 4: (-0.534542, 0.053245, -0.534542)}
    path = information.phi_trajectory(micro, 2)
    for t, values in want.items():
        assert by_edge(path.where(f"t = {t}"), "cum_phi") == {e: pytest.approx(v, abs=1e-6) for e, v in zip(((0, 1), (0, 2), (1, 2)), values, strict=True)}
    assert by_edge(information.phi_terminal(micro, 2), "cum_phi")[0, 1] == pytest.approx(-0.534542, abs=1e-6)


def test_micro_tables_and_scores(spark, micro):
    table = counts.cpt(micro, 3, 2)
    p = {(r["parent"], r["child"], r["pv"], r["cv"]): r["prob"] for r in table.collect()}
    assert [p[0, 1, 0, 0], p[0, 1, 0, 1], p[0, 1, 1, 0], p[1, 2, 0, 0], p[1, 2, 1, 0], p[0, 2, 1, 1]] == pytest.approx([1, 0, 0.5, 1 / 3, 1, 0.5])
    test = spark.createDataFrame([(1, 0, 0, 1), (2, 1, 1, 1)], micro.schema)
    score = lambda e: metrics.log_likelihood(test, table, spark.createDataFrame(e, "i int, j int")).first()[0]
    assert score([(0, 1), (1, 2)]) == pytest.approx(-12.062232, abs=1e-6)
    assert score([(0, 1), (0, 2)]) == pytest.approx(-1.039721, abs=1e-6)
    assert metrics.log_likelihood(test.where("t > 5"), table, spark.createDataFrame([(0, 1)], "i int, j int")).first()[0] is None
    assert rows_of(ChowLiu(micro, 2).tree()) == {(0, 1): 1, (1, 2): 1}


def test_unseen_and_outside_values(spark, micro):
    odd = micro.unionByName(spark.createDataFrame([(5, 7, 0, 1)], micro.schema))
    assert rows_of(counts.pair_counts(odd, 2)) != rows_of(counts.pair_counts(odd))
    sums = {}
    for r in counts.cpt(odd, 3, 3).collect():
        sums[r["parent"], r["child"], r["pv"]] = sums.get((r["parent"], r["child"], r["pv"]), 0) + r["prob"]
    assert all(s == pytest.approx(1) or s == 0 for s in sums.values())
    with pytest.raises(Exception, match="outside"):
        checked(odd, 2).collect()


def test_distance_counts_directions(spark):
    a, b = (spark.createDataFrame([x], "i int, j int") for x in ((0, 1), (1, 0)))
    assert metrics.shd(a, b).first()[0] == 2
    assert metrics.shd(a, b, same_direction=False).first()[0] == 0
    assert metrics.shd(a, a).first()[0] == 0


def test_constants():
    for k, tau, gamma, levels in ((2, 0.028125, 0.1125, 27), (3, 0.0125, 0.1125, 35), (4, 0.00703125, 0.1125, 40), (5, 0.0045, 0.1125, 45)):
        c = weights.constants(6, k, 100)
        assert (c.tau, c.gamma, c.levels) == (pytest.approx(tau), pytest.approx(gamma), levels)
    assert weights.constants(10, 2, 500).eta == pytest.approx(0.542891, abs=1e-6)
    assert weights.constants(50, 2, 1000).eta == pytest.approx(1.225650, abs=1e-6)
    assert weights.constants(2, 2, 10).eta == 0


def test_draws_of_many_values(spark):
    wide = synthetic.samples(spark, [(0, 1), (1, 2)], 3, 6, 400)
    for retries in (1, 100):
        p = [r["p"] for r in weights.level_draws(wide, 3, 6, 400, retries=retries).collect()]
        assert all(0 <= x <= 1 for x in p)
        uniform = sum(abs(x - 1 / 6) < 1e-12 for x in p)
        assert uniform > 0 if retries == 1 else uniform == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 7), st.data())
def test_spanning_tree_is_best(n, data):
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    w = data.draw(st.lists(st.integers(0, 5), min_size=len(pairs), max_size=len(pairs)))
    tree = local.spanning_forest([(float(x), *p) for x, p in zip(w, pairs, strict=True)], n)
    assert local.is_tree(tree, n)
    weight = dict(zip(pairs, w, strict=True))
    for cut in tree:  # the lightest edge over each cut is in the tree
        parts = local.Forest(n)
        for e in tree:
            if e != cut:
                parts.join(*e)
        assert weight[cut] <= min(weight[e] for e in pairs if parts.top(e[0]) != parts.top(e[1]))


def test_forest_of_zero_weights(spark):
    w = spark.createDataFrame([(0, 1, 0.0), (0, 2, 1.0), (1, 2, 0.0)], "i int, j int, weight double")
    assert trees.spanning_tree(w, 3, largest=True, skip_zero=True).count() == 1
    assert trees.spanning_tree(w, 3).count() == 2
    assert trees.boruvka(w).count() == 2


def logs(w):
    with np.errstate(divide="ignore"):
        return np.log(w)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 6), st.floats(0.01, 1), st.integers(0, 99))
def test_log_minor_is_the_determinant(n, floor, seed):
    """As numpy's, also where the graph is not connected; a factor of all weights only adds its logarithm."""
    rng = np.random.default_rng(seed)
    w = np.triu(rng.uniform(0.1, 3, (n, n)) * (rng.random((n, n)) < 0.7), 1)
    w += w.T
    minor = (np.diag(w.sum(axis=1)) - w)[1:, 1:]
    connected = abs(np.linalg.det(minor)) > 1e-9
    assert local.log_minor(logs(w), 0.0) == (pytest.approx(np.linalg.slogdet(minor)[1]) if connected else -np.inf)
    assert local.log_minor(logs(w), floor) == pytest.approx(np.linalg.slogdet(minor + floor * np.eye(n - 1) * (not connected))[1])
    if connected:
        assert local.log_minor(logs(w) - 2000, 0.0) == pytest.approx(local.log_minor(logs(w), 0.0) - 2000 * (n - 1))


@pytest.mark.parametrize("draw", [lambda w, r: local.tree_by_determinants(w, r, 0.0), lambda w, r: local.tree_by_walks(w, r)[0]])
def test_sampler_law(draw):
    w = np.zeros((4, 4))
    for (i, j), x in K4.items():
        w[i, j] = w[j, i] = x
    w = logs(w)
    rng, n, seen = np.random.default_rng(3), 4000, dict.fromkeys(K4, 0)
    for _ in range(n):
        tree = draw(w, rng)
        assert local.is_tree(tree, 4)
        for e in tree:
            seen[e] += 1
    for e, p in MARGINALS.items():
        assert abs(seen[e] / n - p) < 4.5 * math.sqrt(p * (1 - p) / n)
    assert local.log_minor(w, 0.0) == pytest.approx(math.log(556))


def test_sampler_edges():
    rng = np.random.default_rng(1)
    with pytest.raises(ValueError, match="connected"):
        local.tree_by_determinants(logs(np.zeros((3, 3))), rng)
    tree, fallbacks, walks = local.tree_by_walks(logs(np.zeros((5, 5))), rng)
    assert local.is_tree(tree, 5) and walks and not fallbacks
    line = np.diag([1.0, 1.0, 1.0], 1)
    assert sorted(local.tree_by_determinants(logs(line + line.T), rng)) == [(0, 1), (1, 2), (2, 3)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=20), st.integers(0, 99))
def test_rounding_keeps_sum(x, seed):
    y = local.swap_rounded(np.array(x), np.random.default_rng(seed))
    assert y.sum() == pytest.approx(sum(x), abs=1e-8)
    assert ((y > 1e-9) & (y < 1 - 1e-9)).sum() <= 1


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 12), st.integers(0, 99))
def test_code_gives_tree(n, seed):
    assert local.is_tree(local.tree_from_code(np.random.default_rng(seed).integers(0, n, n - 2)), n)


def test_contraction_adds_weights(spark):
    w = spark.createDataFrame([(i, j, x) for (i, j), x in K4.items()], "i int, j int, weight double")
    assert by_edge(graph.contract_edge(w, 0, 2), "weight") == {(0, 1): 5.0, (0, 2): 5.0, (1, 2): 9.0} or by_edge(graph.contract_edge(w, 0, 2), "weight") == {(0, 1): 5.0, (1, 2): 9.0, (0, 2): 5.0}
    assert by_edge(graph.delete_edge(w, 1, 0), "weight") == {e: x for e, x in K4.items() if e != (0, 1)}
    assert rows_of(graph.canonical(spark.createDataFrame([(1, 0), (0, 1)], "u int, v int"))) == {(0, 1): 1}
    with pytest.raises(Exception, match="two ends"):
        graph.checked_edges(spark.createDataFrame([(None, 1)], "i int, j int")).collect()


def test_methods_recover_the_planted_tree(spark):
    wide = planted(spark, DATA).where("t <= 700")
    test = planted(spark, DATA).where("t > 700")
    for name in ("Chow-Liu", "OFDEFast"):
        row = evaluate(wide, test, true_tree(spark), name, K, 700 if name == "Chow-Liu" else None)
        assert row.first()["shd"] == (0 if name == "Chow-Liu" else row.first()["shd"])
        assert row.first()["log-likelihood"] < 0
    for name, learner in LEARNERS.items():
        assert trees.tree_shape(learner(wide, K).tree(40), N).first()["is_tree"], name


def test_steps_and_rows_must_agree(micro):
    with pytest.raises(ValueError, match="steps"):
        ForestDensity(micro, 2).tree(9)
    assert WeightedMajority(micro, 2).all_weights(4).where("t = 1 and log_weight = 0").count() == 3
    assert WeightedMajority(micro, 2).tree(1).count() == 2


def test_signed_rank(spark):
    r = metrics.signed_rank(spark, [0.0] * 8, [1.0] * 8, draws=300).first()
    assert r["p_right"] > 0.9 and r["p_left"] + r["p_rope"] + r["p_right"] == pytest.approx(1)
    assert sum(x["n"] for x in metrics.difference_histogram(spark, [1, 2, 3], [2, 2, 5]).collect()) == 3
    with pytest.raises(ValueError):
        metrics.signed_rank(spark, [1.0], [])


def test_files_round_trip(spark, tmp_path):
    wide = planted(spark, DATA)
    files.write_observations(wide, str(tmp_path / "obs"))
    assert rows_of(files.read_observations(spark, str(tmp_path / "obs"), N)) == rows_of(wide)
    files.write_edges(true_tree(spark), str(tmp_path / "edges"))
    assert sorted(map(tuple, files.read_edges(spark, str(tmp_path / "edges")).collect())) == sorted(TREE)
    (tmp_path / "odd.txt").write_text("[(0, 1), ( 3,-2 ), __import__('os')]\n")
    assert sorted(map(tuple, files.read_edges(spark, str(tmp_path / "odd.txt")).collect())) == [(0, 1), (3, -2)]


def test_samples_do_not_depend_on_partitions(spark):
    a = synthetic.samples(spark, [(0, 1), (1, 2)], 3, 3, 50)
    assert rows_of(a) == rows_of(synthetic.samples(spark, [(0, 1), (1, 2)], 3, 3, 50).repartition(7))
    moved = synthetic.samples(spark, [(0, 1)], 2, 2, 50, by_insertion=True)
    assert moved.count() == 50
    assert synthetic.dataset(spark, 4, 70, 2, False, 1)[1].count() == 30


def test_command_line(spark, tmp_path):
    from arbora.plans.cli import main

    row = main(["--synthetic", "--tree", "--n", "5", "--T", "60", "--noise", "0.3", "--seed", "42", "--method", "OFDE", "--output_folder", str(tmp_path / "a" / "b")])
    assert json.loads((tmp_path / "a" / "b" / "results.json").read_text()) == row
    assert json.loads((tmp_path / "a" / "b" / "arguments.json").read_text())["method"] == "OFDE"
    with pytest.raises(SystemExit):
        main(["--n", "5", "--method", "RWM", "--output_folder", str(tmp_path / "c")])


def test_stream_in_several_batches(spark, tmp_path):
    from pyspark.sql import functions as F

    from arbora.streaming import online

    wide = planted(spark, DATA).where("t <= 60")
    for part in range(3):
        wide.where((F.col("t") > 20 * part) & (F.col("t") <= 20 * part + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(wide.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    got = online.drained(online.phi_stream(stream, K), str(tmp_path / "out"))
    want = {(r["t"], r["i"], r["j"]): r["cum_phi"] for r in information.phi_trajectory(wide, K).collect()}
    rows = got.collect()
    assert len(rows) == len(want) == 60 * 15
    assert all(r["cum_phi"] == pytest.approx(want[r["t"], r["i"], r["j"]], abs=1e-9) for r in rows)
    gap = planted(spark, DATA).where("t in (1, 3)")
    gap.write.parquet(str(tmp_path / "gap"))
    with pytest.raises(Exception, match="without gap"):
        online.drained(online.phi_stream(spark.readStream.schema(gap.schema).parquet(str(tmp_path / "gap")), K), str(tmp_path / "out2"))


def test_renamed_codes(spark):
    df = spark.createDataFrame([(5, "1", 2)], "t long, a string, b int")
    assert renamed(df).first().asDict() == {"t": 5, "v0": 1, "v1": 2}
