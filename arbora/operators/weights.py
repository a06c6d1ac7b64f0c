"""Edge weights of the randomised weighted majority learner, as logarithms.

A weight is a sum of products of one probability for each row, so it shrinks without bound as rows
come in: at millions of rows no double holds it. Only logarithms leave this module.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.functions.portable import mixed, mixed_numbers
from arbora.functions.special import RATIO_FLOOR, floored_ln
from arbora.operators import blocks
from arbora.operators.encode import cell, pair_form


#: Values of a variable up to which a row's levels are written out.
PLAIN = 8


class Constants(NamedTuple):
    eta: float
    tau: float
    gamma: float
    levels: int


def constants(n: int, k: int, rows: int, epsilon: float = 0.9) -> Constants:
    """Learning rate and discretisation. ``rows`` is the length of the data, not the step limit."""
    eps = epsilon / 2
    tau, gamma = eps / (4 * k * k), eps / 4
    top = math.floor(math.log(1 / (2 * tau)) / math.log(1 + gamma)) if tau <= 0.5 else 0
    return Constants(math.sqrt(8 * (n - 2) * math.log(n) / rows) if rows else 0.0, tau, gamma, top + 1)


def level_table(spark: SparkSession, k: int, epsilon: float = 0.9) -> DataFrame:
    """k, ell, value: the probabilities that an entry may be drawn as."""
    c = constants(3, k, 1, epsilon)
    return spark.range(c.levels).select(F.lit(k).alias("k"), F.col("id").cast("int").alias("ell"), (F.lit(c.tau) * F.pow(F.lit(1 + c.gamma), F.col("id"))).alias("value"))


def observed_factor(n: int, k: int, c: Constants, seed: int, retries: int = 1) -> Column:
    """P(parent value | row of the child value) of a random distribution drawn per step and edge.

    Entries other than the row's own are levels; its own is what remains. A row whose remainder is
    negative is drawn again, up to ``retries`` times, and is uniform after that: 1 is the law of
    the vectorised learner, 100 that of the plain one. Up to k = 3 no row can be negative.
    Only the entry that is observed, and for the remainder its row, is computed.
    """
    t, i, j, u, v = (F.col(x).cast("long") for x in ("t", "i", "j", "u", "v"))
    base = (((t * n + i) * n + j) * k + v) * k
    draw = lambda entry, attempt: F.lit(c.tau) * F.pow(F.lit(1 + c.gamma), mixed(base + entry, F.lit(seed) + attempt) % c.levels)

    def attempt(a: Column) -> Column:
        # the row's k - 1 levels, in order of the entries other than v
        row = F.transform(F.sequence(F.lit(0), F.lit(k - 2)), lambda x: draw(F.when(x < v, x).otherwise(x + 1).cast("long"), a))
        rest = F.lit(1.0) - F.aggregate(row, F.lit(0.0), lambda s, x: s + x)
        return F.struct(rest.alias("rest"), F.when(u == v, rest).otherwise(draw(u, a)).alias("p"))

    def attempts(first: int) -> Column:
        if first == retries:
            return F.lit(1.0 / k)
        tries = F.transform(F.sequence(F.lit(first), F.lit(retries - 1)), lambda a: attempt(a.cast("long")))
        return F.coalesce(F.get(F.filter(tries, lambda x: x["rest"] >= 0), F.lit(0))["p"], F.lit(1.0 / k))

    if k > PLAIN:
        return attempts(0)
    # the first attempt without arrays, within generated code; few rows need another one
    levels = [draw(F.when(v > x, F.lit(x)).otherwise(F.lit(x + 1)).cast("long"), F.lit(0)) for x in range(k - 1)]
    rest = F.lit(1.0) - sum(levels, F.lit(0.0))
    return F.when(rest < 0, attempts(1)).when(u == v, rest).otherwise(draw(u, F.lit(0)))


def level_draws(wide: DataFrame, n: int, k: int, rows: int, epsilon: float = 0.9, seed: int = 7, retries: int = 1) -> DataFrame:
    """t, i, j, u, v, p: the factor that the observed cell of each edge is multiplied by."""
    c = constants(n, k, rows, epsilon)
    return pair_form(wide, k).withColumn("p", observed_factor(n, k, c, seed, retries))


def factors(t: np.ndarray, pair: tuple[int, int], u: np.ndarray, v: np.ndarray, n: int, k: int, c: Constants, seed: int, retries: int = 1) -> np.ndarray:
    """``observed_factor`` of a pair's values at the steps ``t``."""
    levels = np.array([c.tau * math.pow(1 + c.gamma, ell) for ell in range(c.levels)])
    base = (((t * n + pair[0]) * n + pair[1]) * k + v) * k

    def attempt(at: np.ndarray, a: int) -> tuple[np.ndarray, np.ndarray]:
        draw = lambda entry: levels[mixed_numbers(base[at] + entry, seed + a) % c.levels]
        rest = 1.0 - sum((draw(np.where(v[at] > x, x, x + 1)) for x in range(k - 1)), np.zeros(len(at)))
        return rest, np.where(u[at] == v[at], rest, draw(u[at]))

    out, at = np.full(len(t), 1.0 / k), np.arange(len(t))
    for a in range(retries):
        if not len(at):
            break
        rest, p = attempt(at, a)
        out[at[rest >= 0]] = p[rest >= 0]
        at = at[rest < 0]
    return out


def weight_paths(wide: DataFrame, n: int, k: int, rows: int, columns: Callable[[blocks.Block, np.ndarray], list[np.ndarray]], schema: str, epsilon: float = 0.9, seed: int = 7, retries: int = 1, steps: int = blocks.STEPS, ahead: bool = False) -> DataFrame:
    """``columns(block, log_weight)`` of each block of steps: log_weight has a row for each step and a column for each pair.

    A weight is not a number where a value lies outside of 0..k-1. ``ahead`` gives a block the next one's first step too.
    """
    c = constants(n, k, rows, epsilon)
    x = level_draws(wide, n, k, rows, epsilon, seed, retries).withColumn("log", floored_ln(F.col("p"), RATIO_FLOOR) * c.eta)
    earlier = blocks.sums_by_cell(x, ["i", "j"], cell(F.col("v"), F.col("u"), k), k * k, F.col("log"), steps)

    def paths(b: blocks.Block) -> list[np.ndarray]:
        inside, out = b.inside(k), np.full((len(b.t), n * (n - 1) // 2), np.nan)
        for column, (i, j) in enumerate(blocks.pairs_of(n)):
            at = np.flatnonzero(inside[i] & inside[j])
            u, v = b.values[i][at], b.values[j][at]
            logs = c.eta * np.log(np.maximum(factors(b.t[at], (i, j), u, v, n, k, c, seed, retries), RATIO_FLOOR))
            path = b.earlier.get((i, j), np.zeros(k * k)) + np.cumsum(blocks.hits(v * k + u, np.ones(len(at), dtype=bool), k * k, logs), axis=0)
            top = path.max(axis=1, initial=-np.inf)
            out[at, column] = top + np.log(np.exp(path - top[:, None]).sum(axis=1))
        return columns(b, out)

    return blocks.by_block(blocks.dealt(wide, steps, ahead), earlier, 2, paths, schema)


def weights_trajectory(wide: DataFrame, n: int, k: int, rows: int, epsilon: float = 0.9, seed: int = 7, retries: int = 1, steps: int = blocks.STEPS) -> DataFrame:
    """t, i, j, log_weight after each step: ln of the sum over cells of the products of their factors."""
    columns = lambda b, w: blocks.long_columns(b.t, n, w, keep=~np.isnan(w))
    return weight_paths(wide, n, k, rows, columns, "t long, i int, j int, log_weight double", epsilon, seed, retries, steps)


def weight_grids(wide: DataFrame, n: int, k: int, rows: int, epsilon: float = 0.9, seed: int = 7, retries: int = 1, steps: int = blocks.STEPS, grid: int = blocks.GRID) -> DataFrame:
    """The trajectory in rows of many steps: grid, i, j and a list of log_weight. ``steps`` is a multiple of ``grid``."""
    columns = lambda b, w: blocks.grids(b.t, n, w, grid=grid)
    return weight_paths(wide, n, k, rows, columns, "grid long, i int, j int, log_weight array<double>", epsilon, seed, retries, steps)


def weights_terminal(wide: DataFrame, n: int, k: int, rows: int, epsilon: float = 0.9, seed: int = 7, retries: int = 1) -> DataFrame:
    """i, j, log_weight after the rows given, by a plain GROUP BY; a cell never seen counts 1.

    The largest of an edge's k * k logarithms is taken out before they are raised and summed.
    """
    eta = constants(n, k, rows, epsilon).eta
    x = level_draws(wide, n, k, rows, epsilon, seed, retries)
    by = x.groupBy("i", "j", "u", "v").agg(F.sum(floored_ln(F.col("p"), RATIO_FLOOR) * eta).alias("log"))
    edge = Window.partitionBy("i", "j")
    unseen = F.lit(k * k) - F.count("*").over(edge)
    by = by.withColumn("unseen", unseen).withColumn("top", F.greatest(F.max("log").over(edge), F.when(F.col("unseen") > 0, 0.0)))
    sums = by.groupBy("i", "j", "unseen", "top").agg(F.sum(F.exp(F.col("log") - F.col("top"))).alias("sum"))
    return sums.select("i", "j", (F.col("top") + F.ln(F.col("sum") + F.when(F.col("unseen") > 0, F.col("unseen") * F.exp(-F.col("top"))).otherwise(0.0))).alias("log_weight"))


def weights_lead(trajectory: DataFrame) -> DataFrame:
    """t, i, j, log_weight, next_log_weight: an equality join on the step after, null at the last.

    Rows are merged: no estimate of their size is good enough to broadcast one side.
    """
    after = trajectory.select((F.col("t") - 1).alias("t"), "i", "j", F.col("log_weight").alias("next_log_weight"))
    return trajectory.join(after.hint("merge"), ["t", "i", "j"], "left").select("t", "i", "j", "log_weight", "next_log_weight")


def weights_and_next(wide: DataFrame, n: int, k: int, rows: int, epsilon: float = 0.9, seed: int = 7, retries: int = 1, steps: int = blocks.STEPS) -> DataFrame:
    """``weights_lead`` of the trajectory without a join: a block of steps has the first one of the next block too."""

    def columns(b: blocks.Block, w: np.ndarray) -> list[np.ndarray]:
        own = b.t // steps == b.number
        after = np.full_like(w, np.nan)
        after[:-1] = np.where((np.diff(b.t) == 1)[:, None], w[1:], np.nan)
        return blocks.long_columns(b.t[own], n, w[own], after[own], keep=~np.isnan(w[own]))

    return weight_paths(wide, n, k, rows, columns, "t long, i int, j int, log_weight double, next_log_weight double", epsilon, seed, retries, steps, ahead=True)


def initial_weights(spark: SparkSession, n: int) -> DataFrame:
    """i, j, weight 1 for i < j: what the first step's structure is drawn from."""
    pairs = spark.range(n).select(F.col("id").cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return pairs.where("i < j").withColumn("weight", F.lit(1.0))
