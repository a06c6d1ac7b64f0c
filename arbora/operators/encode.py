"""Observation tables: one row per time step (wide), one per variable (long), one per pair.

A wide table has t (BIGINT, from 1, unique) and v0..v{n-1} (INT in 0..k-1).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns(n: int) -> list[str]:
    return [f"v{i}" for i in range(n)]


def renamed(df: DataFrame, t: str = "t") -> DataFrame:
    """The wide form of any table: ``t`` first, the other columns in order become v0.. as INT."""
    own = [c for c in df.columns if c != t]
    return df.select(F.col(t).cast("long").alias("t"), *(F.col(f"`{c}`").cast("int").alias(f"v{i}") for i, c in enumerate(own)))


def size(wide: DataFrame) -> int:
    return len(wide.columns) - 1


def in_domain(k: int, *cols: str) -> Column:
    """All of the columns hold codes 0..k-1."""
    held = F.lit(True)
    for c in cols:
        held &= F.col(c).between(0, k - 1)
    return held


def checked(wide: DataFrame, k: int) -> DataFrame:
    """The same rows; reading one with a code outside 0..k-1, or a null, is an error."""
    bad = ~in_domain(k, *columns(size(wide)))
    out = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit(f"a value lies outside 0..{k - 1} at t = "), F.col("t").cast("string"))).cast("long")).otherwise(F.col("t"))
    return wide.select(out.alias("t"), *columns(size(wide)))


def values(wide: DataFrame) -> Column:
    return F.array(*columns(size(wide)))


def long_form(wide: DataFrame, k: int | None = None) -> DataFrame:
    """t, var, val. With ``k``, values outside the domain are left out."""
    out = wide.select("t", F.posexplode(values(wide)).alias("var", "val"))
    return out if k is None else out.where(in_domain(k, "val"))


def pair_form(wide: DataFrame, k: int | None = None) -> DataFrame:
    """t, i, j, u, v for all i < j: the pairs of a row come from the row itself, without a join."""
    first = wide.select("t", values(wide).alias("x"), F.posexplode(values(wide)).alias("i", "u"))
    out = first.select("t", "i", "u", F.posexplode(F.slice("x", F.col("i") + 2, F.size("x"))).alias("d", "v"))
    out = out.select("t", "i", (F.col("i") + 1 + F.col("d")).alias("j"), "u", "v")
    return out if k is None else out.where(in_domain(k, "u", "v"))


def cell(u: Column, v: Column, k: int) -> Column:
    """A pair of codes as one."""
    return u * k + v


def codebook(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """var, raw, code: each column's different values, numbered in order from 0."""
    from pyspark.sql import Window

    raw = df.select(F.posexplode(F.array(*(F.col(c).cast("string") for c in names))).alias("var", "raw")).where("raw is not null").distinct()
    return raw.select("var", "raw", (F.row_number().over(Window.partitionBy("var").orderBy("raw")) - 1).alias("code"))


def upto(wide: DataFrame, steps: int | None) -> DataFrame:
    """The first ``steps`` time steps; applied here, as no optimiser moves it below a window."""
    return wide if steps is None else wide.where(F.col("t") <= steps)


def split(wide: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    return wide.where(~test), wide.where(test)
