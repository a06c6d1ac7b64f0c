"""A lookup join that no frequent key brings to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with over one in so many of all rows is frequent; there are fewer such keys than that.
FREQUENT = 1000


def looked_up(rows: DataFrame, key: str, table: DataFrame, on: str) -> DataFrame:
    """Inner join of ``rows`` with the one row of ``table`` whose ``on`` is their ``key``.

    The table's rows of frequent keys, fewer than FREQUENT of them, are broadcast; the others meet in a shuffle.
    Both sides are read more than once.
    """
    total = rows.count()
    often = rows.groupBy(key).count().where(F.col("count") * FREQUENT > total).select(F.col(key).alias("__often"))
    same = F.col(key) == F.col("__often")
    few = F.broadcast(table.join(F.broadcast(often), F.col(on) == F.col("__often")).drop("__often"))
    near = rows.join(few, F.col(key) == F.col(on))
    rest = rows.join(F.broadcast(often), same, "left_anti").join(table, F.col(key) == F.col(on))
    return near.unionByName(rest)
