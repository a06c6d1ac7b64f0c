"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame functions only.

Texts count as equal when they are identical after deleting every ASCII white-space
character. Of equal texts the row with the most code points stays, then the smallest
``doc_id`` (null ids last), then one row of those that still tie.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import SPACE, cut, join_by_size, text_of

#: Runs that one merge of a round takes.
FAN_IN = 8


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: id, digest of the normalised text, a check and its length, code points."""
    normal = F.regexp_replace(text_of(text_col), SPACE, "")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(normal, 256)).alias("digest"),
        F.xxhash64(normal).alias("check"),
        F.length(normal).alias("points"),
        F.length(text_of(text_col)).cast("long").alias("n_points"),
    )


def merged(runs: DataFrame) -> DataFrame:
    """Rows of one digest in one node made one: the smallest ``best`` and the sum of ``size``.

    The struct of ``best`` makes this a sort aggregate: each task sorts what it holds by digest
    and merges that run before anything is exchanged, and merges the runs it gets afterwards.
    """
    return runs.groupBy("digest", "check", "points", "node").agg(F.min("best").alias("best"), F.sum("size").alias("size"))


def tree_merge(rows: DataFrame, partitions: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merge partitions' sorted runs of digests in binomial rounds until one run is left.

    ``rows`` has digest, check, points, node (the partition that holds the row) and best, a struct
    whose smallest value wins. Round r merges, ``fan_in`` at a time, the runs of nodes that agree
    but in their r-th digit to that base, so that after the last round all are node 0: as many rounds
    as ``partitions`` has digits. One row per (digest, node) remains, with the smallest ``best`` and
    the number of rows it stands for, so a digest that a third of all rows share comes to the last
    round as at most ``fan_in`` rows. Copies are verified at every level: rows merge only if their
    SHA-256, a second 64-bit hash and the length of the text without white space agree.
    """
    runs = merged(rows.withColumn("size", F.lit(1).cast("long")))
    while partitions > 1:
        runs = merged(runs.withColumn("node", F.floor(F.col("node") / fan_in).cast("long")))
        partitions = -(-partitions // fan_in)
    return runs.drop("node")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_points.

    Null texts are empty texts, and all empty or blank texts are one group. Very long texts are
    read whole. Rows that repeat entirely, id included, are told apart by a row number, so exactly
    one row of a group has ``kept``. An empty table gives an empty result. Extra columns are ignored.
    """
    rows = cut(digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).withColumn("node", F.spark_partition_id().cast("long")))
    best = F.struct((-F.col("n_points")).alias("least"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    partitions = (rows.agg(F.max("node")).first()[0] or 0) + 1
    groups = tree_merge(rows.select("digest", "check", "points", "node", best.alias("best")), partitions)
    groups = cut(groups.select("digest", "check", "points", "size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")))
    return join_by_size(rows, groups, ["digest", "check", "points"], "size").select(
        "doc_id",
        "keep_id",
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_points",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns of ``docs`` and no others.

    One row of each group stays: that with the longest text, then the smallest id; a null id comes last. Null
    texts equal empty ones and those of white space only. Very long texts are compared whole; an empty table
    gives none. The texts move once, to the group's winner; a winner that
    several entirely repeated rows match is settled in a second, small pass over those alone.
    """
    kept = cut(mark_copies(docs, id_col, text_col).groupBy("text_sha256", "n_points", "doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("ties")).where("kept").drop("kept"))
    kept = kept.select(*(F.col(c).alias(f"__keep_{c}") for c in kept.columns))
    normal = F.regexp_replace(text_of(text_col), SPACE, "")
    wide = docs.withColumn("__digest", F.sha2(normal, 256))
    won = (F.col("__digest") == F.col("__keep_text_sha256")) & F.col(id_col).eqNullSafe(F.col("__keep_doc_id")) & (F.length(text_of(text_col)) == F.col("__keep_n_points"))
    out = wide.join(kept, won)
    if kept.where("__keep_ties > 1").isEmpty():
        return out.select(*docs.columns)
    w = Window.partitionBy("__digest", id_col).orderBy("__keep_ties")
    many = out.where("__keep_ties > 1").withColumn("__copy", F.row_number().over(w)).where("__copy = 1")
    return out.where("__keep_ties = 1").select(*docs.columns).unionByName(many.select(*docs.columns))
