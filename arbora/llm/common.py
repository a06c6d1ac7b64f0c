"""What the text operators share: word pattern, checkpoints, row-size checks."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of texts in an Arrow batch.
BATCH = 4 << 20
#: Groups of a larger share of all rows than one in so many are joined apart from the others.
HOT = 1000
#: Parts that the rows of such a group are dealt to where they are to be read once only.
PARTS = 64
#: A run of those characters.
SPACE = r"[\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Number of words of the whole text (null: 0), as long."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where neither the session nor its context has any, a local master gets a temporary one, as in
    tests; on any other it is an error, as executors can't see a folder of the driver's machine.
    """
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", "") and not context.getCheckpointDir():
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="arbora-checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder, by checkpoint(), and cut the lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same as a compressed table in the shared folder: for what checkpoint() would bloat."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def for_python(df: DataFrame) -> DataFrame:
    """The same rows; from now on the session's Arrow batches end at BATCH bytes as well as at their rows.

    Batches of long texts would else fill the memory beside the heap, by task. A lower limit that
    the session already has stays.
    """
    conf = df.sparkSession.conf
    now = re.match(r"(\d+)b?$", str(conf.get("spark.sql.execution.arrow.maxBytesPerBatch")))
    if not now or int(now[1]) > BATCH:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH}b")
    return df


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else unchanged.

    The count reads at most ``rows + 1`` rows, so the check itself stays bounded; beyond the
    bound the caller's join is planned (and re-planned at run time) as a shuffled join.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_by_size(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` joined with their group; ``size`` is the number of rows that each group has.

    Groups of over 1/HOT of all rows, of which there are fewer than HOT, are broadcast, and their
    rows stay where they are; the others meet in a shuffle, in which no key has more than that
    share. Null keys are keys, and a row without a group stays, with nulls. ``groups`` has one row for
    each key and is read several times.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot, names = F.col(size) * HOT > total, [f"__{k}" for k in keys]
    groups = groups.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)))
    large = F.broadcast(groups.where(hot))
    near = rows.join(large, same)
    rest = rows.join(large.select(*names), same, "left_anti").join(groups.where(~hot), same, "left")
    return near.unionByName(rest).drop(*names)


def join_spread(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: list[str]) -> DataFrame:
    """``rows`` joined with their group, those without one left out, in one pass over the rows.

    As in join_by_size ``size`` is the number of rows of each group. Rows of groups of over 1/HOT of all rows are
    dealt by their ``spread`` columns to PARTS parts, each of which gets a copy of the group's row. Null keys have no group.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * HOT > total
    often = groups.where(hot).select(*keys, F.lit(True).alias("__often"))
    part = F.when(F.col("__often"), F.pmod(F.xxhash64(*spread), F.lit(PARTS)).cast("int")).otherwise(0)
    parts = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))))
    dealt = rows.join(F.broadcast(often), keys, "left").withColumn("__part", part).drop("__often")
    return dealt.join(groups.withColumn("__part", parts), [*keys, "__part"]).drop("__part")
