"""Edge relations (i < j, weight): algebra of weighted graphs as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.portable import uniform


def canonical(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """i, j with i < j, each edge once."""
    return edges.select(F.least(a, b).alias("i"), F.greatest(a, b).alias("j")).distinct()


def checked_edges(edges: DataFrame) -> DataFrame:
    """The same rows; a null end is an error."""
    bad = F.col("i").isNull() | F.col("j").isNull()
    return edges.withColumn("i", F.when(bad, F.raise_error(F.lit("an edge needs two ends")).cast("int")).otherwise(F.col("i")))


def symmetrize(w: DataFrame) -> DataFrame:
    """u, v, weight: each edge in both directions."""
    return w.select(F.col("i").alias("u"), F.col("j").alias("v"), "weight").unionByName(w.select(F.col("j").alias("u"), F.col("i").alias("v"), "weight"))


def neighbours(edges: DataFrame) -> DataFrame:
    """u, near: each vertex with the sorted array of its neighbours."""
    return symmetrize(edges.withColumn("weight", F.lit(1.0))).groupBy("u").agg(F.sort_array(F.collect_set("v")).alias("near"))


def weighted_degree(w: DataFrame) -> DataFrame:
    """u, degree."""
    return symmetrize(w).groupBy("u").agg(F.sum("weight").alias("degree"))


def laplacian(w: DataFrame) -> DataFrame:
    """u, v, value: degrees on the diagonal, negative weights beside it; zeros are absent."""
    return weighted_degree(w).select("u", F.col("u").alias("v"), F.col("degree").alias("value")).unionByName(symmetrize(w).where("weight <> 0").select("u", "v", (-F.col("weight")).alias("value")))


def laplacian_minor(w: DataFrame, root: int = 0) -> DataFrame:
    """The Laplacian without the root's row and column."""
    return laplacian(w).where((F.col("u") != root) & (F.col("v") != root))


def delete_edge(w: DataFrame, i: int, j: int) -> DataFrame:
    a, b = min(i, j), max(i, j)
    return w.where(~((F.col("i") == a) & (F.col("j") == b)))


def moved(c: str, i: int, j: int):
    """A vertex after i < j became one at place j - 1 and those above i moved down by one."""
    x = F.col(c)
    return F.when(x.isin(i, j), j - 1).when(x > i, x - 1).otherwise(x)


def contract_edge(w: DataFrame, i: int, j: int) -> DataFrame:
    """Vertices i < j become one at place j - 1; those above i move down by one; weights add up."""
    a, b = min(i, j), max(i, j)
    x = w.select(moved("i", a, b).alias("a"), moved("j", a, b).alias("b"), "weight").where("a <> b")
    return x.groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.sum("weight").alias("weight"))


def contraction_map(w: DataFrame) -> DataFrame:
    """i, j, weight, from_i, from_j: before any contraction each edge stands for itself."""
    return w.select("i", "j", "weight", F.col("i").alias("from_i"), F.col("j").alias("from_j"))


def contract_mapped(m: DataFrame, i: int, j: int, seed: int, epsilon: float = 0.1) -> DataFrame:
    """A contraction map after vertices i < j became one, as contract_edge has it.

    Of two edges that meet by this one is drawn to stand for both, by weight, the first by its
    ends with ``epsilon`` added to the draw's total; their weights add up. The draw depends on
    the seed and the edge's new ends.
    """
    a, b = min(i, j), max(i, j)
    x = m.withColumn("a", moved("i", a, b)).withColumn("b", moved("j", a, b)).where("a <> b")
    own = F.struct("i", "j", "weight", "from_i", "from_j")
    both = x.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min(own).alias("one"), F.max(own).alias("two"), F.sum("weight").alias("weight"), F.count("*").alias("n"))
    first = (F.col("n") == 1) | (uniform(F.col("x") * (1 << 15) + F.col("y"), seed) < F.col("one.weight") / (F.col("weight") + epsilon))
    kept = lambda c: F.when(first, F.col(f"one.{c}")).otherwise(F.col(f"two.{c}")).alias(c)
    return both.select(F.col("x").alias("i"), F.col("y").alias("j"), "weight", kept("from_i"), kept("from_j"))


def walk_transition_probs(w: DataFrame) -> DataFrame:
    """u, v, prob of the next step of a random walk; uniform from a vertex without weight."""
    by = Window.partitionBy("u")
    total = F.sum("weight").over(by)
    return symmetrize(w).select("u", "v", F.when(total > 0, F.col("weight") / total).otherwise(F.lit(1.0) / F.count("*").over(by)).alias("prob"))


def walk_cdf(w: DataFrame) -> DataFrame:
    """u, v, cdf: running transition probabilities, for drawing by inversion."""
    by = Window.partitionBy("u").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return walk_transition_probs(w).select("u", "v", F.sum("prob").over(by).alias("cdf"))


def mix_vector(p: DataFrame, tree: DataFrame, alpha: float) -> DataFrame:
    """i, j, x: alpha * p + (1 - alpha) * (1 for edges of the tree, else 0). ``p`` has i, j, x."""
    f = tree.select("i", "j", F.lit(1.0).alias("f"))
    return p.join(f, ["i", "j"], "left").select("i", "j", (F.lit(alpha) * F.col("x") + F.lit(1 - alpha) * F.coalesce("f", F.lit(0.0))).alias("x"))


def fractional(p: DataFrame) -> DataFrame:
    return p.where((F.col("x") > 1e-10) & (F.col("x") < 1 - 1e-10))
