"""Running sums and counts over time that no single task has to see whole.

A key such as (variable, value) may hold a large share of all time steps. Time is therefore cut to
blocks: a window runs within (key, block), and the sums of the blocks before are added by a join
on the same columns, which the rows are already dealt by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Time steps of a block.
BLOCK = 1 << 16


def running_sums(df: DataFrame, keys: Sequence[str], sums: dict[str, Column], order: str = "t", exclusive: bool = False, block: int = BLOCK) -> DataFrame:
    """``df`` with each of ``sums`` summed over the key's rows up to this one (before it, if exclusive).

    ``order`` must be unique within a key. Nulls count as 0.
    """
    zeroed = {name: F.coalesce(c, F.lit(0).cast("long")) for name, c in sums.items()}
    rows = df.withColumn("__block", F.floor(F.col(order) / block)).select("*", *(c.alias(f"__{n}") for n, c in zeroed.items()))
    by = [*keys, "__block"]
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*by).agg(*(F.sum(f"__{n}").alias(f"__sum_{n}") for n in sums))
    offsets = offsets.select(*by, *(F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in sums))
    own = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    out = rows.join(offsets, by).select(*df.columns, *(F.coalesce(F.sum(f"__{n}").over(own), F.lit(0)).alias(f"__own_{n}") for n in sums), *(f"__before_{n}" for n in sums))
    return out.select(*df.columns, *((F.col(f"__own_{n}") + F.col(f"__before_{n}")).alias(n) for n in sums))


def prior_count(df: DataFrame, keys: Sequence[str], name: str, order: str = "t", block: int = BLOCK) -> DataFrame:
    """``df`` with the number of the key's earlier rows."""
    return running_sums(df, keys, {name: F.lit(1).cast("long")}, order, exclusive=True, block=block)
