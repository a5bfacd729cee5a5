"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only on a local master that has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="touchline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written as Parquet and read again, so that what is read twice is computed once and lost executors don't matter."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


PART = 1 << 20
"""Rows of a part on average, at most."""


def in_parts(rows: DataFrame, name: str, per: int = PART) -> DataFrame:
    """``rows`` stored and dealt to partitions of at most ``per`` rows on average, so that what a task caches of them doesn't grow with the table.

    A model that reads its rows again and again keeps them in memory at several times the size that they have on disk, by which Spark cuts files.
    """
    kept = stored(rows, name)
    n = kept.count()
    return kept.repartition(max(math.ceil(n / per), min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / 4096)), 1))
