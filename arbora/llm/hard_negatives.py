"""Hard negatives: for an anchor and a positive, near rows of another label that score just below the positive.

Every row is scored against every anchor, cell by cell: a block of anchors meets a block of rows in one
task. Within a cell each anchor's scores are sorted as a whole; a cell gives the first few of an anchor
(its positives) or of an anchor and positive (its negatives), and the first of all cells are the first
of all rows. A cell has a bounded size, however many rows there are or share a label.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import written

#: Anchors of a block and rows of a block, about, and anchors whose scores are held at once.
ANCHORS, ROWS, TOGETHER = 16384, 8192, 64
#: Scores are cut to this size, so that a hundred times a score is a long.
MOST = 1 << 56
#: Doubles below this are exact whole numbers.
EXACT = 1 << 53


def taking_part(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, x: rows with a label and finite components, these as floor(scale * component), each id once."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    finite = F.forall("embedding", lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), x.alias("x")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*")


def dense(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """The vectors as a matrix of whole numbers with ``size`` columns; shorter ones end in zeros."""
    lists = column.combine_chunks()
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    ends = ends - ends[0]
    if len(flat) == size * len(lists):
        return flat.reshape(len(lists), size)
    out = np.zeros((len(lists), size), dtype=np.int64)
    for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        out[k, : b - a] = flat[a:b]
    return out


def longest(column: pa.ChunkedArray) -> int:
    return int(np.diff(column.combine_chunks().offsets.to_numpy()).max(initial=0))


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products, cut to MOST: as doubles where no sum can be too large for them."""
    high = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    if high(anchors) * high(rows) * anchors.shape[1] < EXACT:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    exact = anchors.astype(object) @ rows.astype(object).T if anchors.shape[1] else np.zeros((len(anchors), len(rows)), dtype=object)
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def by_cells(rows: DataFrame, anchors: DataFrame, blocks: int, groups: int, pick, schema: str) -> DataFrame:  # noqa: ANN001
    """The rows that ``pick`` gives for each anchor of each cell.

    It gets the cell's anchors and the number of the one that is looked at, whether each row has that
    anchor's label, and the rows' scores and ids.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64()] * len(names)
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        if len(left) and len(right):
            right = right.sort_by("vec_id")
            size = max(longest(left["x"]), longest(right["x"]))
            a, r = dense(left["x"], size), dense(right["x"], size)
            ids, labels, own = (c.to_numpy() for c in (right["vec_id"], right["label"], left["label"]))
            for start in range(0, len(a), TOGETHER):
                for k, row in enumerate(scores(a[start : start + TOGETHER], r), start):
                    for values in pick(left, k, labels == own[k], row, ids):
                        for held, v in zip(out, values, strict=True):
                            held.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    left = anchors.withColumn("__g", deal(groups)).withColumn("__b", every(blocks)).groupBy("__g", "__b")
    right = rows.withColumn("__b", deal(blocks)).withColumn("__g", every(groups)).groupBy("__g", "__b")
    return left.cogroup(right).applyInArrow(cell, schema)


def sorted_rows(use: np.ndarray, row: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the rows in use: highest score first, then smallest id."""
    s, d = row[use], ids[use]
    order = np.lexsort((d, -s))
    return s[order], d[order]


def first(df: DataFrame, by: list[str], score: str, then: str, n: int) -> DataFrame:
    """The ``n`` rows with the highest score of each group and their rank from 1; tasks keep no more before they shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), then))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and embedding; ``anchor`` tells from vec_id which rows are anchors. A score
    is the inner product of components as floor(scale * x); ties go by smaller id. An anchor's positives
    are the first other rows of its label, and a positive's negatives the first rows of another label
    whose score lies between ``low`` and ``high`` percent of the positive's, both included: none where that is negative.

    Rows with a null id, a null label, or a null or not finite component take no part; of rows that repeat an id
    that with the smallest label, then vector, does. Shorter vectors go on with zeros, empty ones score 0.
    Scaled components are cut to the range of a long and scores to 2**56 either way; both are exact within.
    Anchors without positives, and positives without negatives, give no rows; an empty table gives none.
    Other columns are ignored, whatever they are named.
    """
    rows = written(taking_part(vectors, scale))
    held = rows.where(anchor)
    n, m = rows.count(), held.count()
    blocks, groups = max(1, math.ceil(n / ROWS)), max(1, math.ceil(m / ANCHORS))

    def same_label(left: pa.Table, k: int, same: np.ndarray, row: np.ndarray, ids: np.ndarray) -> list[tuple]:
        own = left["vec_id"][k].as_py()
        s, d = sorted_rows(np.flatnonzero(same & (ids != own)), row, ids)
        return [(own, y, x) for x, y in zip(s[:positives].tolist(), d[:positives].tolist(), strict=True)]

    found = by_cells(rows, held, blocks, groups, same_label, "anchor_id long, positive_id long, score long")
    best = first(found, ["anchor_id"], "score", "positive_id", positives)
    known = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("positive_id", "score"))).alias("positives"))
    known = written(held.join(known, "vec_id"))

    def below(left: pa.Table, k: int, same: np.ndarray, row: np.ndarray, ids: np.ndarray) -> list[tuple]:
        own, out = left["vec_id"][k].as_py(), []
        s, d = sorted_rows(np.flatnonzero(~same), row, ids)
        for p in left["positives"][k].as_py():
            least, most = -(-low * p["score"] // 100), high * p["score"] // 100
            at = int(np.searchsorted(-s, -most))
            out += [(own, p["positive_id"], y, p["score"], x) for x, y in zip(s[at : at + negatives].tolist(), d[at : at + negatives].tolist(), strict=True) if x >= least]
        return out

    out = by_cells(rows, known, blocks, groups, below, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    ranked = first(out, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
