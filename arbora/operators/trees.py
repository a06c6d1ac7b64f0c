"""Trees from edge relations: spanning forests and random trees, one group per run or step."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions.portable import Draws
from arbora.operators import local_trees as local
from arbora.operators.blocks import lists, pair_ends
from arbora.session import cut, shared_folder

#: Result rows that leave a Python worker together, and time steps whose trees are rounded in one task.
TOGETHER, STEPS = 1 << 14, 1 << 16
#: Steps that a block of rounding begins ahead: by then nothing is left of where it began.
LEAD = 1 << 9
#: Edges that come to a Python worker before it takes up their runs.
HELD = 1 << 17
#: Edges of one run: ends and weights, in order of the ends.
Edges = tuple[np.ndarray, np.ndarray, np.ndarray]
TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def by_run(w: DataFrame, run: str | None, work: Callable[[int, Edges], list[tuple]], schema: str, many: Callable[[np.ndarray, Edges], list[np.ndarray]] | None = None) -> DataFrame:
    """``work(run, edges)`` for each run of ``w`` (run, i, j, weight); all of it is run 0 without one.

    Runs are dealt and sorted, and streamed through Arrow: a task holds the edges of one run, some
    batches and their results, however many runs it gets. Where all runs of what it holds have the same edges,
    ``many(runs, edges)`` takes them at once, with a row of weights for each run, and gives columns.
    """
    rows = w.select((F.col(run) if run else F.lit(0)).cast("long").alias("run"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("weight").cast("double").alias("weight"))
    names, types = zip(*(x.split() for x in f"run long, {schema}".split(", ")), strict=True)
    out_schema = pa.schema([(n, TYPES[t]) for n, t in zip(names, types, strict=True)])

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), out_schema, strict=True)], schema=out_schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * 4

        def solve(key: int, edges: Edges) -> None:
            out.extend((key, *x) for x in work(key, edges))

        def solved() -> Iterator[pa.RecordBatch]:
            """What comes of all runs that are held but the last one, which may go on."""
            nonlocal held
            held = [np.concatenate(x) for x in zip(held, *waiting, strict=True)]
            waiting.clear()
            ends = [0, *(np.flatnonzero(np.diff(held[0])) + 1).tolist()]
            size = ends[1] if len(ends) > 1 else 0
            whole = [x[: ends[-1]] for x in held]
            if many and size and all(z - a == size for a, z in zip(ends, ends[1:], strict=False)):
                by = [x.reshape(-1, size) for x in whole]
                if (by[1] == by[1][0]).all() and (by[2] == by[2][0]).all():
                    for a in range(0, len(by[0]), step := max(1, TOGETHER // size)):
                        columns = many(by[0][a : a + step, 0], (by[1][0], by[2][0], by[3][a : a + step]))
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)
                    held = [x[ends[-1] :] for x in held]
                    return
            for a, z in zip(ends, ends[1:], strict=False):
                solve(int(held[0][a]), tuple(x[a:z] for x in held[1:]))
                if len(out) > TOGETHER:
                    yield packed(out)
                    out.clear()
            held = [x[ends[-1] :] for x in held]

        waiting: list[list[np.ndarray]] = []
        for b in batches:
            waiting.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            if sum(len(x[0]) for x in waiting) >= HELD:
                yield from solved()
        yield from solved()
        if len(held[0]):
            solve(int(held[0][0]), tuple(held[1:]))
        if out:
            yield packed(out)

    dealt = rows.repartition("run") if run else rows.repartition(1)  # what comes before keeps its tasks
    found = dealt.sortWithinPartitions("run", "i", "j").mapInArrow(apply, f"run long, {schema}")
    return found.withColumnRenamed("run", run) if run else found.drop("run")


def logs(w: DataFrame) -> DataFrame:
    """``w`` with logarithms as what by_run takes for weights: its log_weight, or else those of its weight.

    Weights that are not positive and finite are no edges.
    """
    if "log_weight" in w.columns:
        return w.withColumn("weight", F.col("log_weight"))
    x = F.col("weight").cast("double")
    return w.withColumn("weight", F.when((x > 0) & (x < float("inf")), F.ln(x)).otherwise(float("-inf")))


def _matrix(edges: Edges, n: int) -> np.ndarray:
    return local.matrix(*edges, n)


def spanning_tree(w: DataFrame, n: int, largest: bool = False, skip_zero: bool = False, run: str | None = None) -> DataFrame:
    """[run,] i, j: Kruskal's tree, a forest where edges are missing or zero ones are skipped."""

    def work(_: int, e: Edges) -> list[tuple]:
        return local.spanning_forest(zip(*(x.tolist() for x in (e[2], e[0], e[1])), strict=True), n, largest, skip_zero)

    return by_run(w, run, work, "i int, j int", lambda keys, e: forests(keys, e, n, largest, skip_zero))


def forests(keys: np.ndarray, e: Edges, n: int, largest: bool = False, skip_zero: bool = False) -> list[np.ndarray]:
    """run, i, j of the spanning forests of many runs, which have the edges ``e`` with a row of weights each."""
    row, edge = np.nonzero(local.spanning_forests(*e, n, largest, skip_zero))
    return [keys[row], e[0][edge], e[1][edge]]


def known_forests(keys: np.ndarray, w: np.ndarray, n: int) -> list[np.ndarray]:
    """``forests`` of many runs with a row of weights for all pairs each: not a number is no edge."""
    i, j = pair_ends(n)
    known = ~np.isnan(w)
    whole = known.all(axis=1)
    out = [forests(keys[whole], (i, j, w[whole]), n)]
    for row in np.flatnonzero(~whole).tolist():
        own = known[row]
        edges = local.spanning_forest(zip(*(x.tolist() for x in (w[row, own], i[own], j[own])), strict=True), n, False, False)
        out.append([np.full(len(edges), keys[row]), *np.array(edges, dtype=np.int64).reshape(-1, 2).T])
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def walks(keys: np.ndarray, e: Edges, n: int, seed: int, root: int = 0, most_steps: int | None = None) -> list[np.ndarray]:
    """run, i, j, fallbacks, walks of many runs, which have the edges ``e`` with a row of weights each: not a number is no edge."""
    w = np.full((len(keys), n, n), -np.inf)
    w[:, e[0], e[1]] = w[:, e[1], e[0]] = np.where(np.isnan(e[2]), -np.inf, e[2])
    at = np.arange(n)
    w[:, at, at] = -np.inf
    row, i, j, fallbacks, counted = local.trees_by_walks(w, keys, seed, root, most_steps)
    return [keys[row], i, j, fallbacks[row], counted[row]]


def determinant_tree(w: DataFrame, n: int, seed: int, epsilon: float = 0.1, run: str | None = None) -> DataFrame:
    """[run,] i, j: a random tree by determinants; seeded by run, so independent of partitions.

    ``w`` has [run,] i, j and log_weight, or weight. ``epsilon`` counts as the weights do (0 is the exact law).
    """

    def work(key: int, e: Edges) -> list[tuple]:
        return local.tree_by_determinants(_matrix(e, n), Draws(seed, key), epsilon)

    return by_run(logs(w), run, work, "i int, j int")


def walk_tree(w: DataFrame, n: int, seed: int, root: int = 0, most_steps: int | None = None, run: str | None = None) -> DataFrame:
    """[run,] i, j, fallbacks, walks: a random tree by loop-erased walks over log_weight, or weight."""

    def work(key: int, e: Edges) -> list[tuple]:
        tree, fallbacks, walks = local.tree_by_walks(_matrix(e, n), Draws(seed, key), root, most_steps)
        return [(i, j, fallbacks, walks) for i, j in tree]

    return by_run(logs(w), run, work, "i int, j int, fallbacks int, walks int", lambda keys, e: walks(keys, e, n, seed, root, most_steps))


def tree_log_partition(w: DataFrame, n: int, run: str | None = None, floor: float = 0.0) -> DataFrame:
    """[run,] log_z: ln of the sum over spanning trees of the products of their weights.

    Without any tree it is minus infinity, or that of the minor with ``floor`` added to its diagonal.
    """
    return by_run(logs(w), run, lambda _, e: [(local.log_minor(_matrix(e, n), floor),)], "log_z double")


def swap_rounding(p: DataFrame, seed: int, run: str | None = None) -> DataFrame:
    """[run,] i, j, x: the rounded vector."""

    def work(key: int, e: Edges) -> list[tuple]:
        return list(zip(e[0].tolist(), e[1].tolist(), local.swap_rounded(e[2], Draws(seed, key)).tolist(), strict=True))

    return by_run(p.withColumnRenamed("x", "weight"), run, work, "i int, j int, x double")


def rounding_steps(trees: DataFrame, n: int, steps: int, seed: int, block: int = STEPS, lead: int = LEAD) -> DataFrame:
    """t, i, j, x: the rounded point after each step, from ``trees`` (t, i, j).

    A point depends on the one before, less and less of which is left from step to step. ``block`` steps are the work
    of one task. It begins from 0, ``lead`` steps ahead of its block, and all blocks run at once. Where a block did not
    begin with the very point that the one before has ended with, it is run again from that point, so the result is that of one
    step after another. Trees are read once; n * (n - 1) / 2 numbers of each block pass through the driver.
    """
    spark = trees.sparkSession
    i, j = pair_ends(n)
    pair = np.full((n, n), -1)
    pair[i, j] = np.arange(len(i))
    lead = min(lead, block)
    number = F.floor((F.col("t") - 1) / block)
    own = trees.where(F.col("t").between(1, steps)).select(number.alias("block"), F.col("t").cast("long").alias("t"), "i", "j")
    ahead = own.where((F.col("t") - 1) % block >= block - lead).withColumn("block", F.col("block") + 1)
    spine = spark.range((steps + block - 1) // block).select(F.col("id").alias("block"), *(F.lit(None).cast(k).alias(x) for x, k in (("t", "long"), ("i", "int"), ("j", "int"))))
    rows = own.unionByName(ahead.where(F.col("block") * block < steps)).unionByName(spine)
    out = pa.schema([("block", pa.int64()), ("t", pa.int64()), ("x", pa.list_(pa.float64()))])

    def points(starts: dict[int, list[float]]) -> DataFrame:
        """block, t, x of the blocks of which ``starts`` has the first point, or of all: the point before a block, and its own."""

        def apply(table: pa.Table) -> pa.Table:
            number = table.column("block")[0].as_py()
            table = table.filter(table.column("t").is_valid())
            t, a, b = (table.column(x).to_numpy() for x in ("t", "i", "j"))
            first, last = number * block + 1, min((number + 1) * block, steps)
            at = first if number in starts else max(1, first - lead)
            chosen = np.zeros((last - at + 1, len(i)))
            kept = t >= at
            chosen[t[kept] - at, pair[a[kept], b[kept]]] = 1.0
            p = np.array(starts.get(number, [0.0] * len(i)))
            found = [p] if at == first else []
            for step, f in enumerate(chosen, at):
                alpha = 1 / (4 * np.sqrt(2 * step))
                p = local.swap_rounded(alpha * p + (1 - alpha) * f, Draws(seed, step))
                if step >= first - 1:
                    found.append(p)
            return pa.Table.from_arrays([pa.array(np.full(len(found), number)), pa.array(np.arange(first - 1, last + 1)), lists(np.stack(found))], schema=out)

        asked = rows.where(F.col("block").isin(list(starts))) if starts else rows
        folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        asked.groupBy("block").applyInArrow(apply, "block long, t long, x array<double>").write.parquet(folder)
        return spark.read.schema("block long, t long, x array<double>").parquet(folder)

    done = points({})
    while True:
        seen = {(r["block"], r["t"]): r["x"] for r in done.where((F.col("t") % block == 0) & (F.col("t") > 0)).collect()}
        again = {b: seen[b - 1, b * block] for b, t in seen if t == b * block and seen[b, t] != seen[b - 1, t]}
        if not again:
            break
        done = done.where(~F.col("block").isin(list(again))).unionByName(points(again))
    at = lambda ends: F.get(F.array(*(F.lit(int(x)) for x in ends)), F.col("pos"))
    return done.where(F.col("t") > F.col("block") * block).select("t", F.posexplode("x").alias("pos", "x")).select("t", at(i).alias("i"), at(j).alias("j"), "x")


def tree_shape(trees: DataFrame, n: int, run: str | None = None) -> DataFrame:
    """[run,] n_edges, n_vertices, is_tree: what every spanning tree of n vertices agrees on."""
    return by_run(trees.withColumn("weight", F.lit(1.0)), run, lambda _, e: [(len(e[0]), len({*e[0].tolist(), *e[1].tolist()}), local.is_tree(list(zip(e[0].tolist(), e[1].tolist(), strict=True)), n))], "n_edges long, n_vertices long, is_tree boolean")


def boruvka(w: DataFrame, largest: bool = False) -> DataFrame:
    """i, j: the spanning forest of a relation too large for one task, in log2(n) rounds of joins.

    Each round every component takes its best edge to another one, ties by (i, j); components
    that are linked become one. Rounds are cut from their lineage by checkpoint().
    """
    from arbora.operators.components import connected

    sign = -1 if largest else 1
    edges = w.select("i", "j", (F.col("weight") * sign).alias("cost"), (F.col("i") * sign).alias("ti"), (F.col("j") * sign).alias("tj"))
    chosen = None
    while True:
        if chosen is None:
            open_ = edges.withColumn("a", F.col("i").cast("long")).withColumn("b", F.col("j").cast("long"))
        else:
            labels = connected(chosen.select(F.col("i").cast("long").alias("a"), F.col("j").cast("long").alias("b")))
            a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ij")
            open_ = edges.join(a, "i", "left").join(b, "j", "left").withColumn("a", F.coalesce("li", "i")).withColumn("b", F.coalesce("lj", "j")).where("a <> b")
        both = open_.select(F.col("a").alias("part"), "cost", "ti", "tj", "i", "j").unionByName(open_.select(F.col("b").alias("part"), "cost", "ti", "tj", "i", "j"))
        best = cut(both.groupBy("part").agg(F.min(F.struct("cost", "ti", "tj", "i", "j")).alias("e")).select("e.i", "e.j").distinct())
        if best.isEmpty():
            return chosen if chosen is not None else best
        chosen = best if chosen is None else cut(chosen.unionByName(best).distinct())
