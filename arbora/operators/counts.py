"""Contingency counts and conditional probability tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.functions.special import ratio
from arbora.operators import blocks
from arbora.operators.encode import long_form, pair_form, size


def marginal_counts(wide: DataFrame, k: int | None = None) -> DataFrame:
    """var, val, c."""
    return long_form(wide, k).groupBy("var", "val").agg(F.count("*").alias("c"))


def pair_counts(wide: DataFrame, k: int | None = None) -> DataFrame:
    """i, j, u, v, c for i < j: partial sums per task, then at most n * (n - 1) / 2 * k * k rows each."""
    return pair_form(wide, k).groupBy("i", "j", "u", "v").agg(F.count("*").alias("c"))


def contingency_pivot(wide: DataFrame, parent: int, child: int, k: int) -> DataFrame:
    """cv, p0..p{k-1}: counts of the child's values by the parent's."""
    out = wide.groupBy(F.col(f"v{child}").alias("cv")).pivot(f"v{parent}", list(range(k))).count().na.fill(0)
    return out.select("cv", *(F.col(str(x)).alias(f"p{x}") for x in range(k)))


def cells(spark: SparkSession, n: int, k: int) -> DataFrame:
    """parent, child, pv, cv: every cell of every ordered pair, n * (n - 1) * k * k rows."""
    seq = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    out = spark.range(n).select(F.col("id").cast("int").alias("parent")).withColumn("child", seq(n)).where("parent <> child")
    return out.withColumn("pv", seq(k)).withColumn("cv", seq(k))


def cpt(wide: DataFrame, n: int, k: int) -> DataFrame:
    """parent, child, pv, cv, prob for all ordered pairs, from one pass of pair counts.

    Values outside 0..k-1 are dropped before normalising; a parent value that never occurs has
    probabilities 0.
    """
    c = pair_counts(wide, k)
    both = c.select(F.col("i").alias("parent"), F.col("j").alias("child"), F.col("u").alias("pv"), F.col("v").alias("cv"), "c").unionByName(
        c.select(F.col("j").alias("parent"), F.col("i").alias("child"), F.col("v").alias("pv"), F.col("u").alias("cv"), "c")
    )
    key = ["parent", "child", "pv", "cv"]
    full = cells(wide.sparkSession, n, k).join(both, key, "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return full.select(*key, ratio(F.col("c").cast("double"), F.sum("c").over(Window.partitionBy("parent", "child", "pv"))).alias("prob"))


def _running(wide: DataFrame, k: int | None, keys: list[str], counted: DataFrame, groups: list[tuple[int, ...]], steps: int) -> DataFrame:
    """t, keys, prior: for each group of variables, earlier rows with the same values; keys are the variables, then their values."""
    kind = dict(wide.dtypes)["v0"]
    sums = counted.groupBy(blocks.block_of(F.col("t"), steps).alias("block"), *keys).agg(F.count("*").alias("c"))
    half = len(keys) // 2

    def work(b: blocks.Block) -> list[np.ndarray]:
        inside, out = b.known if k is None else b.inside(k), []
        for group in groups:
            at = np.flatnonzero(np.logical_and.reduce([inside[x] for x in group]))
            own = [b.values[x][at] for x in group]
            codes = np.zeros(len(at), dtype=np.int64)
            for x in own:
                names, code = np.unique(x, return_inverse=True)
                codes = codes * max(len(names), 1) + code
            _, first, codes = np.unique(codes, return_index=True, return_inverse=True)
            before = np.array([b.earlier[*group, *(int(x[f]) for x in own)][0] for f in first], dtype=np.int64)
            out.append([b.t[at], *(np.full(len(at), x) for x in group), *own, blocks.prior(codes) + before[codes]])
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    schema = ", ".join(["t long", *(f"{x} int" for x in keys[:half]), *(f"{x} {kind}" for x in keys[half:]), "prior long"])
    return blocks.by_block(blocks.dealt(wide, steps), blocks.earlier_sums(sums, keys, ["c"]), len(keys), work, schema)


def running_counts_1var(wide: DataFrame, k: int | None = None, steps: int = blocks.STEPS) -> DataFrame:
    """t, var, val, prior: earlier rows with the same value of the variable. Nulls are left out."""
    counted = long_form(wide, k).where("val is not null")
    return _running(wide, k, ["var", "val"], counted, [(i,) for i in range(size(wide))], steps)


def running_counts_2var(wide: DataFrame, k: int | None = None, steps: int = blocks.STEPS) -> DataFrame:
    """t, i, j, u, v, prior. Pairs with a null are left out."""
    counted = pair_form(wide, k).where("u is not null and v is not null")
    return _running(wide, k, ["i", "j", "u", "v"], counted, blocks.pairs_of(size(wide)), steps)


def count_grid(wide: DataFrame, k: int, steps: int = blocks.STEPS) -> DataFrame:
    """t, var, val, c: counts after each step for every value, observed at it or not."""
    earlier = blocks.sums_by_cell(long_form(wide, k), ["var"], F.col("val"), k, F.lit(1), steps)

    def work(b: blocks.Block) -> list[np.ndarray]:
        out = []
        for var, (values, inside) in enumerate(zip(b.values, b.inside(k), strict=True)):
            at = np.flatnonzero(inside)
            if len(at):
                c = b.earlier[var,] + np.cumsum(blocks.hits(values[at], np.ones(len(at), dtype=bool), k), axis=0).astype(np.int64)
                out.append([np.repeat(b.t[at], k), np.full(len(at) * k, var), np.tile(np.arange(k), len(at)), c.ravel()])
        return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 4

    return blocks.by_block(blocks.dealt(wide, steps), earlier, 1, work, "t long, var int, val int, c long")
