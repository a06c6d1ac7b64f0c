"""Each query of the engine against its SQL, run by another engine over the same tables."""

import itertools
import math
from collections import defaultdict

import pytest

from arbora import queries
from conftest import DATA, rows_of

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, oracle, name):
    df = queries.queries()[name](spark, DATA)
    got = rows_of(df)
    if name in SQL:
        columns, want = oracle(SQL[name])
        assert sorted(df.columns) == columns
        assert got == want
    else:
        assert sum(got.values()) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert sorted(map(tuple, e.entry(spark).collect())) == [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5)]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_terminal_is_end_of_trajectory(spark):
    from pyspark.sql import functions as F

    from arbora.operators.information import phi_terminal, phi_trajectory
    from arbora.operators.weights import weights_terminal, weights_trajectory
    from arbora.sources.events import K, N, planted

    wide = planted(spark, DATA)
    last = {(r["i"], r["j"]): r["cum_phi"] for r in phi_trajectory(wide, K).where("t = 1000").collect()}
    for r in phi_terminal(wide, K).collect():
        assert r["cum_phi"] == pytest.approx(last[r["i"], r["j"]], abs=1e-8)
    for retries in (1, 3):
        last = {(r["i"], r["j"]): r["log_weight"] for r in weights_trajectory(wide, N, K, 1000, retries=retries).where("t = 999").collect()}
        for r in weights_terminal(wide.where(F.col("t") <= 999), N, K, 1000, retries=retries).collect():
            assert r["log_weight"] == pytest.approx(last[r["i"], r["j"]], rel=1e-9)


def test_terminal_weights_of_all_events(spark):
    from arbora.operators.weights import weights_trajectory
    from arbora.sources.events import K, N, events, planted

    d = DATA.replace("sf0.001", "sf0.01")
    n = events(spark, d).count()
    assert n > 1000
    last = {(r["i"], r["j"]): r["log_weight"] for r in weights_trajectory(planted(spark, d), N, K, n, queries.EPSILON, queries.SEED).where(f"t = {n}").collect()}
    got = {(r["i"], r["j"]): r["log_weight"] for r in queries.queries()["rwm_weights_terminal"](spark, d).collect()}
    assert got == pytest.approx(last, abs=1e-6) and len(set(got.values())) == N * (N - 1) // 2


def test_signed_rank_takes_the_default_draws(spark):
    from arbora.operators import metrics

    assert rows_of(queries.queries()["signed_rank"](spark, DATA)) == rows_of(metrics.signed_rank(spark, *queries.fold_lists(spark, DATA)))


@pytest.mark.parametrize("name", ["ofde_trajectory", "tree_trajectory", "stream_trees", "stream_walk_trees"])
def test_trajectories_of_all_events(spark, name):
    from arbora.operators.local_trees import is_tree

    steps = defaultdict(list)
    for r in queries.queries()[name](spark, DATA).collect():
        steps[r["t"]].append((r["i"], r["j"]))
    first = 2 if name == "stream_walk_trees" else 1
    assert sorted(steps) == list(range(first, first + 1000)) and all(is_tree(x, 6) for x in steps.values())


def spanning_trees(n):
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    from arbora.operators.local_trees import is_tree

    return [t for t in itertools.combinations(pairs, n - 1) if is_tree(list(t), n)]


def tree_by_enumeration(weight, n, draws, epsilon=0.1):
    """The determinant sampler stated over lists of trees: each determinant as the sum that it stands for.

    A singular graph has no tree, and its determinant that of the minor with epsilon on the diagonal.
    """
    names = {(a, b): (a, b) for a in range(n) for b in range(a + 1, n)}
    w = dict(weight)
    known = {m: spanning_trees(m) for m in range(2, n + 1)}

    def total(w, m):
        z = sum(math.prod(w[e] for e in t) for t in known[m])
        if z > 0 or not epsilon:
            return z
        minor = [[(sum(w[min(a, c), max(a, c)] for c in range(m) if c != a) + epsilon) if a == b else -w[min(a, b), max(a, b)] for b in range(1, m)] for a in range(1, m)]
        return determinant(minor)

    out, at, m = [], 1, n
    while m > 1:
        near = [b for b in range(1, m) if w[0, b]]
        if len(near) == 1:
            at = near[0]
        elif at >= m:
            at = 1
        if len(near) > 1:
            without = {**w, (0, at): w[0, at] * 0}
            if w[0, at] == 0 or draws.random() < total(without, m) / total(w, m):
                w, at = without, at + 1
                continue
        out.append(names[0, at])
        rest = [x for x in range(1, m) if x != at]
        new_w, new_names = {}, {}
        for a, x in enumerate(rest):
            for b, y in enumerate(rest):
                if a < b:
                    new_w[a + 1, b + 1], new_names[a + 1, b + 1] = w[x, y], names[x, y]
        for a, x in enumerate(rest):
            other = (min(at, x), max(at, x))
            own = draws.random() < w[0, x] / max(w[0, x] + w[other] + epsilon, type(w[0, x])(1e-320))
            new_w[0, a + 1], new_names[0, a + 1] = w[0, x] + w[other], names[0, x] if own else names[other]
        w, names, at, m = new_w, new_names, 1, m - 1
    return {(min(e), max(e)) for e in out}


def determinant(m):
    """By the first row's minors."""
    return m[0][0] if len(m) == 1 else sum((-1) ** k * x * determinant([r[:k] + r[k + 1 :] for r in m[1:]]) for k, x in enumerate(m[0]))


def test_determinant_trees_by_enumeration(spark):
    from arbora.functions.portable import Draws

    by = defaultdict(set)
    for r in queries.queries()["rwm_tree"](spark, DATA).collect():
        by[r["run"]].add((r["i"], r["j"]))
    weight = {(r["i"], r["j"]): r["weight"] for r in queries.edges(spark, DATA).collect()}
    assert len(by) == queries.RUNS
    for run, tree in by.items():
        assert tree == tree_by_enumeration(weight, 6, Draws(queries.SEED, run))


def walked_tree(weight, n, draws):
    """Loop-erased walks from vertex 0's tree, one step after another, in the arithmetic of the weights; uniform after 2 n n steps."""
    tree, inside = set(), {0}
    for start in range(n):
        v, exits, steps = start, {}, 0
        while v not in inside:
            near = [(u, weight[min(u, v), max(u, v)]) for u in range(n) if u != v]
            if steps >= 2 * n * n:
                near = [(u, type(near[0][1])(1)) for u, _ in near]
            left = type(near[0][1])(draws.random()) * sum(x for _, x in near)
            for u, x in near:
                left -= x
                if left < 0:
                    break
            exits[v] = v = u
            steps += 1
        v = start
        while v not in inside:
            inside.add(v)
            tree.add((min(v, exits[v]), max(v, exits[v])))
            v = exits[v]
    return tree


def test_weights_and_trees_of_millions_of_rows(spark):
    """Weights far below any double: finite logarithms, and the trees that 60 digits give."""
    from decimal import Decimal, localcontext

    from arbora.functions.portable import Draws
    from arbora.operators import trees
    from arbora.operators.weights import weights_terminal
    from arbora.sources.events import K, N, plant

    rows = 3_000_000
    w = weights_terminal(plant(spark.range(rows).withColumnRenamed("id", "event_id")), N, K, rows, queries.EPSILON, queries.SEED).cache()
    logs = {(r["i"], r["j"]): r["log_weight"] for r in w.collect()}
    assert len(set(logs.values())) == 15 and all(math.isfinite(x) for x in logs.values())
    assert sum(math.exp(x) == 0 for x in logs.values()) > 10  # as numbers most of them are gone
    runs = queries.runs(w, 20)
    drawn, walked = defaultdict(set), defaultdict(set)
    for r in trees.determinant_tree(runs, N, 5, 0.0, "run").collect():
        drawn[r["run"]].add((r["i"], r["j"]))
    for r in trees.walk_tree(runs, N, 5, run="run").collect():
        walked[r["run"]].add((r["i"], r["j"]))
    with localcontext() as c:
        c.prec = 60
        exact = {e: Decimal(x).exp() for e, x in logs.items()}
        for run in range(20):
            assert drawn[run] == tree_by_enumeration(exact, N, Draws(5, run), Decimal(0))
            assert walked[run] == walked_tree(exact, N, Draws(5, run))
    w.unpersist()


def test_rounding_steps_by_a_plain_loop(spark):
    """Each point from the one before, trades stated by where they end; blocks of steps change nothing."""
    from arbora.functions.portable import Draws
    from arbora.operators import trees
    from arbora.plans.learners import ForestDensity
    from arbora.sources.events import K, N, planted

    chosen = defaultdict(set)
    trajectory = ForestDensity(planted(spark, DATA), K, queries.SEED).trajectory(300)
    for r in trajectory.collect():
        chosen[r["t"]].add((r["i"], r["j"]))
    p, want = {e: 0.0 for e in queries.PAIRS}, {}
    for t in range(1, 301):
        alpha, draws = 1 / (4 * math.sqrt(2 * t)), Draws(queries.SEED, t)
        p = {e: alpha * x + (1 - alpha) * (e in chosen[t]) for e, x in p.items()}
        while len(open_ := [e for e in queries.PAIRS if 1e-10 < p[e] < 1 - 1e-10]) > 1:
            a = open_.pop(int(draws.random() * len(open_)))
            b = open_[int(draws.random() * len(open_))]
            s = p[a] + p[b]
            # the two places where one of them is settled, and the chance of the one in which a is higher
            high, low = min(1.0, s), max(0.0, s - 1)
            p[a] = high if draws.random() < (p[a] - low) / (high - low) else low
            p[b] = s - p[a]
        want.update({(t, *e): p[e] for e in queries.PAIRS})
    for block in (1 << 16, 70):
        got = {(r["t"], r["i"], r["j"]): r["x"] for r in trees.rounding_steps(trajectory, N, 300, queries.SEED, block).collect()}
        assert got == pytest.approx(want, abs=1e-9)


def test_blocks_of_time_change_nothing(spark):
    from pyspark.sql import functions as F

    from arbora.operators.encode import long_form
    from arbora.operators.running import prior_count, running_sums
    from arbora.sources.events import planted

    rows = long_form(planted(spark, DATA))
    assert rows_of(prior_count(rows, ["var", "val"], "n")) == rows_of(prior_count(rows, ["var", "val"], "n", block=64))
    one = running_sums(rows, ["var"], {"s": F.col("val").cast("long")})
    assert rows_of(one) == rows_of(running_sums(rows, ["var"], {"s": F.col("val").cast("long")}, block=100))
