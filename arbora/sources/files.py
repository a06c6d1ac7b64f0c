"""Files that the learners read and write: observation CSVs, edge lists, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_observations(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The wide form of a CSV with a header, a row index from 0 and ``n`` columns of codes.

    The schema is given, so nothing is inferred; time is the index plus one.
    """
    schema = T.StructType([T.StructField("at", T.LongType()), *(T.StructField(f"v{i}", T.IntegerType()) for i in range(n))])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    return rows.select((F.col("at") + 1).alias("t"), *(f"v{i}" for i in range(n)))


def quarantined_observations(spark: SparkSession, path: str, n: int, k: int, quarantine: str, header: bool = True) -> DataFrame:
    """The wide form of the good rows of a CSV; the others are written as a table to the folder ``quarantine``.

    That table has file, line and reason: malformed (another number of fields, or one that is no number), missing (a
    field is empty) or outside (a value is not in 0..k-1). One bad line fails no job and loses no other line.
    """
    names = [f"v{i}" for i in range(n)]
    schema = T.StructType([T.StructField("at", T.LongType()), *(T.StructField(v, T.IntegerType()) for v in names), T.StructField("malformed", T.StringType())])
    rows = spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed").csv(path)
    missing, inside = F.lit(False), F.lit(True)
    for c in ("at", *names):
        missing |= F.col(c).isNull()
    for c in names:
        inside &= F.col(c).between(0, k - 1)
    reason = F.when(F.col("malformed").isNotNull(), "malformed").when(missing, "missing").when(~inside, "outside")
    line = F.coalesce("malformed", F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("at", *names))))
    judged = rows.select("at", *names, F.col("_metadata.file_path").alias("file"), line.alias("line"), reason.alias("reason"))
    judged.where("reason is not null").select("file", "line", "reason").write.mode("overwrite").parquet(quarantine)
    return judged.where("reason is null").select((F.col("at") + 1).alias("t"), *names)


def quarantined_edges(spark: SparkSession, path: str, quarantine: str) -> DataFrame:
    """i, j of the good pairs of a text as read_edges takes it; what else stands in brackets goes to the folder ``quarantine``.

    That table has file, item (the number of the pair in its file, from 0) and text.
    """
    items = F.posexplode(F.regexp_extract_all("value", F.lit(r"\(([^()]*)\)"), F.lit(1))).alias("item", "text")
    found = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file")).select("file", items)
    good = F.col("text").rlike(r"^\s*-?\d{1,9}\s*,\s*-?\d{1,9}\s*$")
    found.where(~good).write.mode("overwrite").parquet(quarantine)
    ends = F.split("text", ",")
    return found.where(good).select(F.trim(ends[0]).cast("int").alias("i"), F.trim(ends[1]).cast("int").alias("j"))


def read_observations_parquet(spark: SparkSession, path: str, columns: list[str], t: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(F.col(t).cast("long").alias("t"), *(F.col(c).cast("int").alias(f"v{i}") for i, c in enumerate(columns)))


def write_observations(wide: DataFrame, path: str) -> None:
    """A folder of CSV parts, each with the header; the index is t - 1."""
    names = [c for c in wide.columns if c != "t"]
    wide.select((F.col("t") - 1).alias(""), *(F.col(c).alias(c[1:]) for c in names)).write.mode("overwrite").option("header", True).csv(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """i, j from a text such as ``[(0, 1), (0, 2)]``; the text is matched, never evaluated."""
    pair = r"\(\s*(-?\d+)\s*,\s*(-?\d+)\s*\)"
    text = spark.read.text(path, wholetext=True)
    found = text.select(F.explode(F.arrays_zip(F.regexp_extract_all("value", F.lit(pair), F.lit(1)).alias("a"), F.regexp_extract_all("value", F.lit(pair), F.lit(2)).alias("b"))).alias("e"))
    return found.select(F.col("e.a").cast("int").alias("i"), F.col("e.b").cast("int").alias("j"))


def write_edges(edges: DataFrame, path: str) -> None:
    """One line with all edges in order: a tree has n - 1 of them."""
    line = F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "j"))), lambda e: F.format_string("(%d, %d)", e["i"], e["j"])), ", "), F.lit("]"))
    edges.agg(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_results(results: DataFrame, path: str) -> None:
    """One JSON line."""
    results.coalesce(1).write.mode("overwrite").json(path)
