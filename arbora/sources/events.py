"""Categorical observations from the events table: a planted tree, and natural columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.portable import mixed

#: Variables and values of the planted data, and its true tree as (parent, child).
N, K = 6, 3
TREE = ((0, 1), (0, 2), (1, 3), (1, 4), (2, 5))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def plant(rows: DataFrame) -> DataFrame:
    """The wide form of rows with event_id: a child copies its parent 7 times in 10."""
    h = lambda salt: mixed(F.col("event_id"), salt)
    values = {0: (h(1) % K)}
    for parent, child in TREE:
        values[child] = F.when(h(10 + child) % 10 < 7, values[parent]).otherwise(h(100 + child) % K)
    return rows.select((F.col("event_id") + 1).alias("t"), *(values[i].cast("int").alias(f"v{i}") for i in range(N)))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plant(events(spark, sf_dir).select("event_id"))


def true_tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TREE), "i int, j int")


def natural_columns(rows: DataFrame) -> DataFrame:
    """Five variables of up to four values of rows of events: type, user, event, quarter of the day, size."""
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "error", 2).otherwise(3)
    size = F.when(F.col("value") < 2, 0).when(F.col("value") < 6, 1).when(F.col("value") < 12, 2).otherwise(3)
    cols = (kind, F.pmod("user_id", F.lit(4)), F.pmod("event_id", F.lit(4)), F.floor(F.hour("ts") / 6), size)
    return rows.select((F.col("event_id") + 1).alias("t"), *(c.cast("int").alias(f"v{i}") for i, c in enumerate(cols)))


def natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return natural_columns(events(spark, sf_dir))
