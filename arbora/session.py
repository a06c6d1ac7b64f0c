"""Session settings for local runs, and the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or on a local master without one a temporary folder, else an error."""
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", "") and not context.getCheckpointDir():
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="arbora-checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Computed once into the shared folder, by checkpoint(), and cut from its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def local_session(cores: int = 8, partitions: int | None = None) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
