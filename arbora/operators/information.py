"""Edge weights from counts: mutual information, and the prequential loss of the online learner."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.portable import numbers, uniform
from arbora.functions.special import RATIO_FLOOR, floored_ln, lgamma
from arbora.operators import blocks
from arbora.operators.counts import marginal_counts, pair_counts
from arbora.operators.encode import cell, in_domain, pair_form, size
from arbora.session import cut

#: Mutual information below this is that of an independent pair.
MI_ZERO = 1e-12


def mutual_information(wide: DataFrame) -> DataFrame:
    """i, j, mi in nats, not below 0. Windows see pair counts only, k * k rows for each pair."""
    c = pair_counts(wide)
    w = lambda *by: F.sum("c").over(Window.partitionBy("i", "j", *by)).cast("double")
    x = c.select("i", "j", F.col("c").cast("double").alias("c"), w("u").alias("ci"), w("v").alias("cj"), w().alias("n"))
    term = F.col("c") / F.col("n") * (F.ln("c") + F.ln("n") - F.ln("ci") - F.ln("cj"))
    return x.groupBy("i", "j").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi"))


def pair_scores(wide: DataFrame, k: int) -> DataFrame:
    """i, j, mi, cum_phi: mutual information and final loss of each pair, from one pass over the rows.

    GROUPING SETS count cells of pairs and values of their first and second variables at once. A variable is
    first in as many pairs as there are variables behind it, and second in as many as before it.
    """
    n = len(wide.columns) - 1
    cells = pair_form(wide).groupingSets([["i", "u"], ["j", "v"], ["i", "j", "u", "v"]], "i", "j", "u", "v")
    c = cut(cells.agg(F.grouping_id().alias("set"), F.count("*").cast("double").alias("c")))
    first = c.where("set = 5").select("i", "u", (F.col("c") / (F.lit(n - 1) - F.col("i"))).alias("ci"))
    second = c.where("set = 10").select("j", "v", (F.col("c") / F.col("j")).alias("cj"))
    joint = c.where("set = 0").select("i", "j", "u", "v", "c").join(F.broadcast(first), ["i", "u"]).join(F.broadcast(second), ["j", "v"])
    x = joint.withColumn("n", F.sum("c").over(Window.partitionBy("i", "j")))
    term = F.col("c") / F.col("n") * (F.ln("c") + F.ln("n") - F.ln("ci") - F.ln("cj"))
    both = x.groupBy("i", "j").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi"), _code("c", k * k).alias("s"))
    one = lambda d, var, count, name: d.groupBy(var).agg(_code(count, k).alias(name))
    out = both.join(one(first, "i", "ci", "si"), "i").join(one(second, "j", "cj", "sj"), "j")
    return out.select("i", "j", "mi", (F.col("si") + F.col("sj") - F.col("s")).alias("cum_phi"))


def _code(count: str, cells: float) -> Column:
    """The sum of ln theta over all rows, telescoped to sums of ln Gamma over the final counts of a code's values."""
    half, n = math.lgamma(0.5), F.sum(count)
    return F.sum(lgamma(F.col(count) + 0.5) - half) - (lgamma(n + cells / 2) - math.lgamma(cells / 2))


def _losses(b: blocks.Block, n: int, k: int) -> np.ndarray:
    """ln(theta_i * theta_j / theta_ij), a row for each step of the block and a column for each pair."""
    inside, at, out = b.inside(k), np.arange(len(b.t)), []
    one, two = b.t - 1 + k / 2, b.t - 1 + k * k / 2
    for i, j in blocks.pairs_of(n):
        both = inside[i] & inside[j]
        u, v = np.where(both, b.values[i], 0), np.where(both, b.values[j], 0)
        hit = blocks.hits(u * k + v, both, k * k)
        before = (b.earlier[i, j][: k * k] + np.cumsum(hit, axis=0) - hit).reshape(-1, k, k)
        ci, cj, cij = before[at, u].sum(axis=1), before[at, :, v].sum(axis=1), before[at, u, v]
        ratio = (ci + 0.5) / one * ((cj + 0.5) / one) / ((cij + 0.5) / two)
        out.append(np.log(np.maximum(np.where(both, ratio, 0.0), RATIO_FLOOR)))
    return np.stack(out, axis=1) if out else np.zeros((len(b.t), 0))


def phi_paths(wide: DataFrame, k: int, columns: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], schema: str, steps: int = blocks.STEPS) -> DataFrame:
    """``columns(t, phi, cum_phi)`` of each block of steps: phi and cum_phi have a row for each step and a column for each pair.

    Counts before a block come from one grouping, sums of phi before it from a first pass over the blocks.
    """
    n = size(wide)
    rows, pair = blocks.dealt(wide, steps), pair_form(wide)
    inside = F.when(in_domain(k, "u", "v"), cell(F.col("u"), F.col("v"), k))
    counts = blocks.sums_by_cell(pair, ["i", "j"], inside, k * k, F.lit(1), steps)

    def totals(b: blocks.Block) -> list[np.ndarray]:
        i, j = blocks.pair_ends(n)
        return [np.full(len(i), b.number), i, j, _losses(b, n, k).sum(axis=0)]

    def paths(b: blocks.Block) -> list[np.ndarray]:
        phi = _losses(b, n, k)
        return columns(b.t, phi, np.array([b.earlier[p][-1] for p in blocks.pairs_of(n)]) + np.cumsum(phi, axis=0))

    sums = blocks.by_block(rows, counts, 2, totals, "block long, i int, j int, phi double")
    return blocks.by_block(rows, counts.join(blocks.earlier_sums(sums, ["i", "j"], ["phi"]), ["block", "i", "j"]), 2, paths, schema)


def phi_trajectory(wide: DataFrame, k: int, steps: int = blocks.STEPS) -> DataFrame:
    """t, i, j, phi, cum_phi: ln(theta_i * theta_j / theta_ij) at each step, and its running sum."""
    n = size(wide)
    return phi_paths(wide, k, lambda t, phi, total: blocks.long_columns(t, n, phi, total), "t long, i int, j int, phi double, cum_phi double", steps)


def phi_grids(wide: DataFrame, k: int, steps: int = blocks.STEPS, grid: int = blocks.GRID) -> DataFrame:
    """The trajectory in rows of many steps: grid, i, j and lists of phi and cum_phi. ``steps`` is a multiple of ``grid``."""
    n = size(wide)
    return phi_paths(wide, k, lambda t, phi, total: blocks.grids(t, n, phi, total, grid=grid), "grid long, i int, j int, phi array<double>, cum_phi array<double>", steps)


def phi_terminal(wide: DataFrame, k: int) -> DataFrame:
    """i, j, cum_phi after all rows, in closed form from the final counts: no window over time.

    The sum of ln theta over a variable's rows telescopes to sums of ln Gamma(count + 1/2) and
    of ln Gamma(rows + cells / 2).
    """
    half = math.lgamma(0.5)

    def score(cells: float) -> Column:
        n = F.sum("c").cast("double")
        return F.sum(lgamma(F.col("c") + 0.5) - half) - (lgamma(n + cells / 2) - math.lgamma(cells / 2))

    one = marginal_counts(wide).groupBy("var").agg(score(k).alias("s"))
    two = pair_counts(wide).groupBy("i", "j").agg(score(k * k).alias("s"))
    a, b = (one.select(F.col("var").alias(x), F.col("s").alias(f"s{x}")) for x in "ij")
    return two.join(a, "i").join(b, "j").select("i", "j", (F.col("si") + F.col("sj") - F.col("s")).alias("cum_phi"))


def perturbed(phi: DataFrame, n: int, t: Column, seed: int) -> DataFrame:
    """t, i, j, weight: cum_phi plus a uniform draw from [0, n * sqrt(t / 2)), by edge and step."""
    key = (t * n + F.col("i")) * n + F.col("j")
    return phi.select(t.cast("long").alias("t"), "i", "j", (F.col("cum_phi") + uniform(key, seed) * n * F.sqrt(t / 2)).alias("weight"))


def perturbed_paths(t: np.ndarray, cum_phi: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``perturbed`` of all pairs of the steps ``t``, a row for each step."""
    i, j = blocks.pair_ends(n)
    key = (t[:, None] * n + i) * n + j
    return cum_phi + numbers(key, seed) * n * np.sqrt(t / 2)[:, None]
