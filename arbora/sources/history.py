"""Histories of edges: a value for each step in a table that is bucketed by stretches of an edge's steps.

A stretch is STEPS steps of one edge. All its rows lie in one bucket, sorted by step, so that an edge's value at
a step is looked up in one bucket, and two histories with as many buckets are joined where they lie. An edge
with more steps than a task should see is spread over as many stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators.blocks import GRID

#: Steps of a stretch, and buckets of a table unless told otherwise.
STEPS, BUCKETS = 1 << 16, 64
#: Bits of a stretch's number that hold the steps, and those of a vertex.
STEP_BITS, VERTEX_BITS = 22, 20


def stretch(i: Column, j: Column, t: Column) -> Column:
    """Number of the stretch: vertices below 2 ** VERTEX_BITS, steps below STEPS * 2 ** STEP_BITS."""
    edge = F.shiftleft(i.cast("long"), VERTEX_BITS) + j.cast("long")
    return F.shiftleft(edge, STEP_BITS) + F.floor(t / STEPS).cast("long")


def stretch_of(i: int, j: int, t: int) -> int:
    return (((i << VERTEX_BITS) + j) << STEP_BITS) + t // STEPS


def write_history(trajectory: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> None:
    """``trajectory`` (t, i, j and values) as the table ``name``, its files in the shared folder ``path``.

    Rows are dealt as the buckets are, so each bucket is one file. Repeated rows stay; a null step or vertex has
    no stretch, and no lookup finds its row. An empty trajectory gives an empty table.
    """
    rows = trajectory.withColumn("stretch", stretch(F.col("i"), F.col("j"), F.col("t"))).repartition(buckets, "stretch")
    rows.write.bucketBy(buckets, "stretch").sortBy("stretch", "t").option("path", path).saveAsTable(name)


def write_grids(paths: DataFrame, name: str, path: str, buckets: int = BUCKETS, grid: int = GRID) -> None:
    """``paths`` (grid, i, j and lists of the values at the steps of a grid) as the table ``name``, dealt by stretch as in write_history.

    A row holds ``grid`` steps of an edge, so rows are dealt and sorted that many steps at a time. STEPS is a multiple of ``grid``.
    """
    rows = paths.withColumn("stretch", stretch(F.col("i"), F.col("j"), F.col("grid") * grid)).repartition(buckets, "stretch")
    rows.write.bucketBy(buckets, "stretch").sortBy("stretch", "grid").option("path", path).saveAsTable(name)


def edge_history(spark: SparkSession, name: str, i: int, j: int, first: int, last: int) -> DataFrame:
    """The rows of one edge from step ``first`` to ``last``; reads the buckets of their stretches only."""
    numbers = [stretch_of(i, j, t) for t in range(first // STEPS * STEPS, last + 1, STEPS)]
    same = F.col("stretch").isin(numbers) & (F.col("i") == i) & (F.col("j") == j)
    return spark.table(name).where(same & F.col("t").between(first, last)).drop("stretch")


def side_by_side(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Both histories' values at each (edge, step) that both have, joined bucket by bucket without an exchange.

    Spark takes rows dealt by stretch as good for a join on stretch and step only under a setting, which is
    made in a session of its own: the caller's keeps its settings.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return own.table(left).hint("merge").join(own.table(right), ["stretch", "t", "i", "j"]).drop("stretch")


def grids_side_by_side(spark: SparkSession, left: str, right: str, grid: int = GRID) -> DataFrame:
    """side_by_side of tables of grids: grids are joined, and their steps come apart after the join.

    A step is in the result where the first values of both histories aren't null.
    """
    keys = ["stretch", "grid", "i", "j"]
    one, two = ([c for c in spark.table(x).columns if c not in keys] for x in (left, right))
    own = spark.newSession()
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    both = own.table(left).hint("merge").join(own.table(right), keys)
    steps = both.select("grid", "i", "j", *one[1:], *two, F.posexplode(one[0]).alias("step", one[0]))
    values = (F.col(c) if c == one[0] else F.get(c, F.col("step")).alias(c) for c in (*one, *two))
    at = steps.select((F.col("grid") * grid + F.col("step")).alias("t"), "i", "j", *values)
    return at.where(F.col(one[0]).isNotNull() & F.col(two[0]).isNotNull())


def looked_up(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (t, i, j and others) with the values that the history has there; rows without any are left out.

    Only ``rows`` are dealt anew, by stretch; the history stays where it lies.
    """
    spark = rows.sparkSession
    return rows.withColumn("stretch", stretch(F.col("i"), F.col("j"), F.col("t"))).join(spark.table(name), ["stretch", "t", "i", "j"]).drop("stretch")
