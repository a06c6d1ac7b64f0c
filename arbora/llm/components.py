"""Connected components of an edge table, by alternating star contraction in DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import cut

#: Links up to which one task joins them: 16 bytes each.
LOCAL = 1 << 16


def joined_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, label of all links (a, b), a > b, of the batches: at most LOCAL."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    labels = [top(x) for x in up]
    yield pa.RecordBatch.from_arrays([pa.array(np.array(list(up), dtype=np.int64)), pa.array(np.array(labels, dtype=np.int64))], ["node", "label"])


def components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """node, label: for each node of ``edges`` (a, b) the smallest node it is linked to.

    Each round points the larger neighbours of a node at its smallest neighbour, then the
    smaller ones likewise; every component becomes a star around its smallest node in about
    log(n) rounds. Smallest neighbours are taken by an aggregate with partial sums, so a hub
    costs one row per task, and no component is ever gathered in one place. Self-links and
    repeated links change nothing; nulls are no nodes; no edges give no rows. Up to ``local`` links
    are joined by one task instead, with the same result.
    """
    larger = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links, state = cut(larger.distinct()), None
    if links.count() <= local:
        return links.coalesce(1).mapInArrow(joined_links, "node long, label long")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        links = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = links.groupBy("a").agg(F.min("b").alias("low"))
        small = links.join(low, "a")
        links = cut(small.select("a", F.col("low").alias("b")).unionByName(small.where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))).distinct())
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
