"""Mixing sources to target weights, in DataFrame functions only.

Words are summed per source, each source gets a target, and the ratio of target to size is the
source's repetition rate. A document is emitted floor(rate) times, plus one copy drawn by a
hash-seeded Bernoulli trial whose probability is the rate's fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import cut, small_enough, word_count

#: Weights by the rank of the source in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes.
SHARE = 1.5
#: Most often that a source is repeated.
MOST = 2.0
#: Trials that are tried per source; the one that comes nearest to the target is used.
SEEDS = 32
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 100_000
#: Modulus of the portable hash.
PRIME = 2147483647


def trial(id_col: Column, seed: Column) -> Column:
    """A number in [0, 1) from an integer id and a seed, the same in any SQL engine."""
    a = (F.pmod(F.coalesce(id_col, F.lit(0)).cast("long"), F.lit(PRIME)) * 48271 + seed * 69621 + 12345) % PRIME
    b = (a * a) % PRIME
    c = (b * 16807 + seed * 7919 + 1) % PRIME
    return ((c * c) % PRIME) / F.lit(float(PRIME))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: the words to take from each source.

    ``sizes`` has source and size. Sources are ranked by code point, null last. They share
    ``share`` of all words by weight; a target stops at ``most`` times the source's size and the
    excess is shared again by weight, until none is above. That fixed point is the level L at
    which the sum of least(most * size, L * weight) is the total: with sources in order of
    most * size / weight, L is the largest of (total - the caps before) / (the weights from here
    on). The two windows see one row per source, after the sums. A source without words has
    target 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "*",
        (F.lit(float(share)) * F.sum("source_size").over(everything)).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("caps"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("rest"),
    )
    level = F.max((F.col("total") - F.col("caps")) / F.col("rest")).over(everything)
    return per.select("source", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def rates(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seeds: int = SEEDS) -> DataFrame:
    """source, source_size, target, rate, seed: one row per source, cut from its lineage.

    ``sizes`` has doc_id, source and size. One Bernoulli draw over few long documents may end
    far from the target, so ``seeds`` draws are summed per source (partial sums before the
    shuffle) and the one nearest to the target is kept; ties take the smaller seed.
    """
    plan = cut(targets(sizes, weights, share, most).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))))
    tried = (
        joined(sizes.where("size > 0"), plan)
        .withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
        .groupBy("source", "seed")
        .agg(F.sum(copies(F.col("rate"), F.col("seed")) * F.col("size")).alias("taken"), F.max("target").alias("target"))
    )
    best = tried.groupBy("source").agg(F.min(F.struct(F.abs(F.col("taken") - F.col("target")), "seed")).getField("seed").alias("seed"))
    best = best.withColumnRenamed("source", "__source")
    out = plan.join(best, plan["source"].eqNullSafe(best["__source"]), "left").drop("__source")
    return cut(out.withColumn("seed", F.coalesce("seed", F.lit(0))))


def copies(rate: Column, seed: Column, id_col: str = "doc_id") -> Column:
    """floor(rate), and one more if the document's trial is below the fraction."""
    whole = F.floor(rate)
    return whole.cast("long") + F.when(trial(F.col(id_col), seed.cast("long")) < rate - whole, 1).otherwise(0).cast("long")


def joined(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Rows with their source's columns; the sources are broadcast while there are few."""
    right = per_source.withColumnRenamed("source", "__source")
    return rows.join(small_enough(right, BROADCAST_SOURCES), rows["source"].eqNullSafe(F.col("__source"))).drop("__source")


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per document.

    A null text has size 0; very long texts are counted whole. Rows that repeat an id share its
    trial. Null ids count as id 0. Other columns are ignored. An empty table gives an empty result. Reruns agree: the trial depends on id and seed only.
    """
    sizes = cut(docs.select("doc_id", "source", word_count().alias("size")))
    n = copies(F.col("rate"), F.col("seed"))
    out = joined(sizes, rates(sizes, **options)).withColumn("copies", n)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs`` and no others.

    Nulls, sizes and repeated ids count as in mix_counts, so a text without words is taken as often as its
    source's rate says. Very long texts are counted and kept whole. An empty table gives none.
    """
    sizes = cut(docs.select("doc_id", "source", word_count().alias("size")))
    plan = rates(sizes, **options).select("source", F.col("rate").alias("__rate"), F.col("seed").alias("__seed"))
    n = copies(F.col("__rate"), F.col("__seed"))
    out = joined(docs, plan).withColumn("__copy", F.explode(F.array_repeat(F.lit(0), n.cast("int"))))
    return out.select(*docs.columns)
