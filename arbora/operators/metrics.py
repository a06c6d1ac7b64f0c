"""Scores of a tree: held-out log-likelihood, distance to a true tree, comparison of two methods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.functions.portable import uniform
from arbora.functions.special import PROB_FLOOR, floored_ln
from arbora.operators.components import connected
from arbora.operators.counts import cpt, marginal_counts, pair_counts
from arbora.operators.encode import pair_form
from arbora.operators.graph import canonical, symmetrize
from arbora.session import cut


def log_likelihood(test: DataFrame, table: DataFrame, tree: DataFrame, canonical_edges: bool = True) -> DataFrame:
    """log_likelihood: mean over test rows of the sum over edges of ln P(child | parent).

    Test rows are counted by edge and cell first, so at most k * k rows an edge meet the table
    (``cpt``). Tree edges (i, j) read as parent, child; probabilities are at least 1e-10, also
    where a value is unknown to the table. An empty test set has no score: null.
    """
    rows = test.agg(F.count("*").alias("rows"))
    forward = pair_counts(test)
    both = forward.select(F.col("i").alias("parent"), F.col("j").alias("child"), F.col("u").alias("pv"), F.col("v").alias("cv"), "c").unionByName(
        forward.select(F.col("j").alias("parent"), F.col("i").alias("child"), F.col("v").alias("pv"), F.col("u").alias("cv"), "c")
    )
    edges = tree.select(F.col("i").alias("parent"), F.col("j").alias("child"))
    scored = both.join(edges, ["parent", "child"]).join(table, ["parent", "child", "pv", "cv"], "left")
    total = scored.agg(F.sum(F.col("c") * floored_ln(F.coalesce("prob", F.lit(0.0)), PROB_FLOOR)).alias("total"))
    one = rows.withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one")
    return one.select(F.when(F.col("rows") > 0, F.coalesce("total", F.lit(0.0)) / F.col("rows")).alias("log_likelihood"))


def fold_scores(wide: DataFrame, table: DataFrame, tree: DataFrame, folds: int) -> DataFrame:
    """fold, score: log_likelihood of each of ``folds`` parts of the rows, dealt in turn by t, all in one pass.

    Tree edges (i, j) with i < j read as parent, child, as in log_likelihood.
    """
    cells = pair_form(wide).groupBy(((F.col("t") - 1) % folds).cast("int").alias("fold"), "i", "j", "u", "v").agg(F.count("*").alias("c"))
    rows = wide.groupBy(((F.col("t") - 1) % folds).cast("int").alias("fold")).agg(F.count("*").alias("rows"))
    known = table.select(F.col("parent").alias("i"), F.col("child").alias("j"), F.col("pv").alias("u"), F.col("cv").alias("v"), "prob")
    scored = cells.join(F.broadcast(tree.select("i", "j")), ["i", "j"]).join(known, ["i", "j", "u", "v"], "left")
    total = scored.groupBy("fold").agg(F.sum(F.col("c") * floored_ln(F.coalesce("prob", F.lit(0.0)), PROB_FLOOR)).alias("total"))
    return total.join(rows, "fold").select("fold", (F.col("total") / F.col("rows")).alias("score"))


def oriented(tree: DataFrame, root: int) -> DataFrame:
    """parent, child of a forest's edges (i, j), away from ``root``; other components go away from their smallest vertex.

    A level of the tree is one join of its vertices with the edges, so a tree of any size may be a relation.
    Edges that close a cycle are an error.
    """
    edges = cut(tree.select("i", "j").withColumn("weight", F.lit(1.0)))
    both = symmetrize(edges).select(F.col("u").cast("int").alias("parent"), F.col("v").cast("int").alias("child"))
    labels = connected(edges.select(F.col("i").cast("long").alias("a"), F.col("j").cast("long").alias("b")))
    own = labels.where(F.col("node") == root).select("label")
    level = labels.join(own, "label", "left_anti").where("node = label").select(F.col("node").cast("int").alias("child"))
    level = cut(level.unionByName(own.select(F.lit(root).alias("child"))).withColumn("parent", F.lit(None).cast("int")))
    out = level.where("parent is not null")
    while not level.isEmpty():
        at = level.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
        level = cut(both.join(at, "parent").where("above is null or child <> above").select("parent", "child"))
        out = cut(out.unionByName(level))
        if out.groupBy("child").count().where("count > 1").limit(1).count():
            raise ValueError("the edges close a cycle: there is no direction away from the root")
    return out.select("parent", "child")


def rooted_log_likelihood(test: DataFrame, train: DataFrame, tree: DataFrame, n: int, k: int, root: int = 0) -> DataFrame:
    """log_likelihood: the mean over test rows of ln P(row) under the forest as a directed model of ``train``.

    Each child has one parent, the one towards the root; a vertex without parent (the root, and one of each
    other component) has its own distribution. Probabilities are at least 1e-10; without test rows null.
    """
    edges = oriented(tree, root)
    inner = log_likelihood(test, cpt(train, n, k), edges.select(F.col("parent").alias("i"), F.col("child").alias("j")))
    tops = test.sparkSession.range(n).select(F.col("id").cast("int").alias("var")).join(edges.select(F.col("child").alias("var")), "var", "left_anti")
    known = marginal_counts(train, k).select("var", "val", (F.col("c") / F.sum("c").over(Window.partitionBy("var"))).alias("prob"))
    seen = marginal_counts(test).join(tops, "var").join(known, ["var", "val"], "left")
    own = seen.agg(F.sum(F.col("c") * floored_ln(F.coalesce("prob", F.lit(0.0)), PROB_FLOOR)).alias("own")).withColumn("one", F.lit(1))
    rows = test.agg(F.count("*").alias("rows")).withColumn("one", F.lit(1))
    return inner.withColumn("one", F.lit(1)).join(own, "one").join(rows, "one").select((F.col("log_likelihood") + F.col("own") / F.col("rows")).alias("log_likelihood"))


def missing_edges(true: DataFrame, found: DataFrame, same_direction: bool = True) -> DataFrame:
    """i, j of true edges that were not found. Unless told otherwise (1, 0) differs from (0, 1)."""
    a, b = (x.select("i", "j") if same_direction else canonical(x, "i", "j") for x in (true, found))
    return a.subtract(b)


def extra_edges(true: DataFrame, found: DataFrame, same_direction: bool = True) -> DataFrame:
    return missing_edges(found, true, same_direction)


def shd(true: DataFrame, found: DataFrame, same_direction: bool = True) -> DataFrame:
    """shd: edges in one of the two sets only."""
    both = missing_edges(true, found, same_direction).unionByName(extra_edges(true, found, same_direction))
    return both.agg(F.count("*").alias("shd"))


def signed_rank(spark: SparkSession, first: list[float], second: list[float], rope: float = 0.0, draws: int = 50_000, prior: int = 1, seed: int = 1) -> DataFrame:
    """p_left, p_rope, p_right of a Bayesian signed-rank test over paired scores.

    Each draw weighs the differences (and a prior difference of 0, ``prior`` times) by a Dirichlet
    variate, that is by exponential ones up to their sum, and adds the weights of pairs whose mean
    difference lies below, within or above the rope; the result is how often each is the largest.
    """
    if len(first) != len(second) or not first:
        raise ValueError("two score lists of the same length are needed")
    z = np.concatenate([np.zeros(prior), np.array(second, dtype=float) - np.array(first, dtype=float)])
    means = (z[:, None] + z[None, :]) / 2
    masks = [(means < -rope).astype(float), ((means >= -rope) & (means <= rope)).astype(float), (means > rope).astype(float)]
    keys = F.array(*(-F.ln(1 - uniform(F.col("id") * len(z) + k, seed)) for k in range(len(z))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column(0).flatten().to_numpy().reshape(-1, len(z))
            yield pa.RecordBatch.from_arrays([pa.array(np.argmax([((w @ m) * w).sum(axis=1) for m in masks], axis=0).astype(np.int32))], ["most"])

    share = lambda k: F.avg((F.col("most") == k).cast("double"))
    return spark.range(draws).select(keys.alias("w")).mapInArrow(run, "most int").agg(share(0).alias("p_left"), share(1).alias("p_rope"), share(2).alias("p_right"))


def difference_histogram(spark: SparkSession, first: list[float], second: list[float], bins: int = 10) -> DataFrame:
    """low, high, n: the histogram of paired differences, as a table instead of a picture."""
    z = np.array(second, dtype=float) - np.array(first, dtype=float)
    counts, edges = np.histogram(z, bins=bins)
    return spark.createDataFrame([(float(a), float(b), int(n)) for a, b, n in zip(edges, edges[1:], counts, strict=False)], "low double, high double, n long")
