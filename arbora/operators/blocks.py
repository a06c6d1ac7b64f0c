"""Running statistics over time for all variables and pairs, a block of steps at a time.

Rows are dealt by block as they are, a row for each step, and not pair by pair: what is shuffled are the
observations and, for each block, the sums over the blocks before it. A task holds one block at a time, takes all pairs
from its rows and hands on what follows from a step (its losses, weights or tree) without another exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Time steps of a block.
STEPS = 1 << 14
#: Time steps of a grid, a part of a block's path that is one row.
GRID = 1 << 10
TYPES = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}


class Block(NamedTuple):
    """A block's number, its steps in order, their values (a row for each variable), where these aren't null, and sums of earlier blocks by key."""

    number: int
    t: np.ndarray
    values: np.ndarray
    known: np.ndarray
    earlier: dict[tuple[int, ...], np.ndarray]

    def inside(self, k: int) -> np.ndarray:
        return self.known & (self.values >= 0) & (self.values < k)


def block_of(t: Column, steps: int) -> Column:
    return F.floor(t / steps)


def dealt(wide: DataFrame, steps: int, ahead: bool = False) -> DataFrame:
    """``wide`` with the block of each step; ``ahead`` gives a block the first step of the next one too."""
    rows = wide.withColumn("block", block_of(F.col("t"), steps))
    return rows.unionByName(rows.where(F.col("t") % steps == 0).withColumn("block", F.col("block") - 1)) if ahead else rows


def earlier_sums(sums: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """block, keys and names: each of ``names`` summed over the key's earlier blocks. ``sums`` has a row for each block and key."""
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("block", *keys, *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(x) for x in names))


def sums_by_cell(rows: DataFrame, keys: Sequence[str], cell: Column, cells: int, value: Column, steps: int) -> DataFrame:
    """block, keys, c0, c1...: the sum of ``value`` for each cell over the key's earlier blocks. A null cell counts nowhere."""
    by = rows.groupBy(block_of(F.col("t"), steps).alias("block"), *keys, cell.alias("cell")).agg(F.sum(value).alias("s"))
    names = [f"c{m}" for m in range(cells)]
    wide = by.groupBy("block", *keys).agg(*(F.coalesce(F.sum(F.when(F.col("cell") == m, F.col("s"))), F.lit(0)).alias(x) for m, x in enumerate(names)))
    return earlier_sums(wide, keys, names)


def by_block(rows: DataFrame, earlier: DataFrame, keys: int, work: Callable[[Block], Sequence[np.ndarray]], schema: str) -> DataFrame:
    """``work(block)`` for each block of ``rows`` (as dealt() gives them): columns of ``schema``, nulls where a double is not a number.

    ``earlier`` has block, so many keys, and the numbers that belong to them.
    """
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    out = pa.schema([(n, TYPES[t]) for n, t in zip(names, types, strict=True)])

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out.empty_table()
        t = left.column("t").to_numpy()
        order = np.argsort(t, kind="stable")
        own = [left.column(c).combine_chunks() for c in left.column_names if c not in ("t", "block")]
        values = np.stack([c.fill_null(0).to_numpy(zero_copy_only=False)[order] for c in own]).astype(np.int64)
        known = np.stack([c.is_valid().to_numpy(zero_copy_only=False)[order] for c in own])
        numbers = [right.column(c).to_numpy() for c in right.column_names if c != "block"]
        sums = np.stack(numbers[keys:], axis=1) if right.num_rows else np.zeros((0, len(numbers) - keys))
        ends = zip(*(x.tolist() for x in numbers[:keys]), strict=True)
        columns = work(Block(int(left.column("block")[0].as_py()), t[order], values, known, dict(zip(ends, sums, strict=True))))
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type, from_pandas=pa.types.is_floating(f.type)) for c, f in zip(columns, out, strict=True)], schema=out)

    return rows.groupBy("block").cogroup(earlier.groupBy("block")).applyInArrow(apply, schema)


def pairs_of(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i + 1, n)]


def pair_ends(n: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.array(pairs_of(n), dtype=np.int64).reshape(-1, 2).T
    return i, j


def long_columns(t: np.ndarray, n: int, *paths: np.ndarray, keep: np.ndarray | None = None) -> list[np.ndarray]:
    """t, i, j and ``paths`` (a row for each step, a column for each pair) as columns with a row for each step and pair, or for those to keep."""
    i, j = pair_ends(n)
    columns = [np.repeat(t, len(i)), np.tile(i, len(t)), np.tile(j, len(t)), *(p.ravel() for p in paths)]
    return columns if keep is None else [c[keep.ravel()] for c in columns]


def grids(t: np.ndarray, n: int, *paths: np.ndarray, grid: int = GRID) -> list[np.ndarray | pa.Array]:
    """grid, i, j and ``paths`` (a row for each step, a column for each pair) as lists of the values at a grid's steps, nulls where there is none.

    Steps are unique; a block holds whole grids.
    """
    i, j = pair_ends(n)
    numbers = np.unique(t // grid)
    at = np.searchsorted(numbers, t // grid) * grid + t % grid

    def laid(path: np.ndarray) -> pa.Array:
        out = np.full((len(i), len(numbers) * grid), np.nan)
        out[:, at] = path.T
        ends = pa.array(np.arange(len(i) * len(numbers) + 1) * grid, pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(out.ravel(), from_pandas=True))

    return [np.tile(numbers, len(i)), np.repeat(i, len(numbers)), np.repeat(j, len(numbers)), *(laid(p) for p in paths)]


def lists(path: np.ndarray) -> pa.Array:
    """The rows of ``path`` as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(path) + 1) * path.shape[1], pa.int32()), pa.array(path.ravel()))


def hits(cells: np.ndarray, inside: np.ndarray, size: int, value: np.ndarray | float = 1.0) -> np.ndarray:
    """A row for each step that holds ``value`` at the step's cell, and zeros."""
    out = np.zeros((len(cells), size))
    at = np.flatnonzero(inside)
    out[at, cells[at]] = value[at] if isinstance(value, np.ndarray) else value
    return out


def prior(codes: np.ndarray) -> np.ndarray:
    """The number of earlier entries with the same code; codes are 0, 1 ..."""
    order = np.argsort(codes, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(codes))])
    out = np.empty(len(codes), dtype=np.int64)
    out[order] = np.arange(len(codes)) - first[codes[order]]
    return out
