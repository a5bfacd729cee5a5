"""Snapshots: a versioned folder of tables, readable only once every table and the manifest are written."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


MANIFEST = "published long, version string, name string, rows long"


def fingerprint(rows: DataFrame, key: str) -> DataFrame:
    """Row count and SHA-256 of the sorted distinct keys; as few rows as matches come together."""
    keys = F.array_join(F.array_sort(F.collect_set(F.col(key).cast("string"))), ",")
    return rows.agg(F.count("*").alias("rows"), F.sha2(keys.cast("binary"), 256).alias("keys_sha256"))


def write_snapshot(tables: dict[str, DataFrame], path: str) -> str:
    """Write all tables to a version of their own, then publish it in the manifest; returns the version. A version that isn't published is never read."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/{version}/{name}")
    counts = [(time.time_ns(), version, name, spark.read.parquet(f"{path}/{version}/{name}").count()) for name in tables]
    spark.createDataFrame(counts, MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return version


def read_snapshot(spark: SparkSession, path: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of the latest published version, or of a given one; raises if a table's count differs from the manifest."""
    rows = spark.read.schema(MANIFEST).json(f"{path}/manifest").collect()  # a row per table and version
    if version is None:
        version = max(rows, key=lambda r: (r.published, r.version)).version
    found = {}
    for row in rows:
        if row.version == version:
            table = spark.read.parquet(f"{path}/{version}/{row.name}")
            if table.count() != row.rows:
                raise ValueError(f"{row.name} doesn't match its manifest")
            found[row.name] = table
    return found
