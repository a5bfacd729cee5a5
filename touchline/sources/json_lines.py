"""JSON lines and sidecars: strict reading with line numbers, appending, labelled examples, metadata beside a table, fitted pipelines."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON-lines file or folder; blank lines are skipped, and a line that isn't an object of the schema raises with its file and number."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("i", "line")).where(F.trim("line") != "")
    parsed = files.withColumn("r", F.from_json("line", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    bad = F.col("r").isNull() | F.col("r._broken").isNotNull() | ~F.startswith(F.ltrim("line"), F.lit("{"))
    stop = F.raise_error(F.concat(F.col("file"), F.lit(" line "), (F.col("i") + 1).cast("string"), F.lit(" isn't a valid record")))
    checked = F.when(~bad, F.struct(*[F.col(f"r.{n}").alias(n) for n in names])).otherwise(stop.cast(spark.createDataFrame([], schema).schema))
    return parsed.select(checked.alias("r")).select("r.*")


def append_lines(rows: DataFrame, path: str) -> None:
    """Rows are added as JSON lines; null fields are left out."""
    rows.write.mode("append").json(path)


def labelled_examples(spark: SparkSession, path: str, schema: str, key: str, label: str, domain: list[str]) -> DataFrame:
    """JSON-lines examples with unique keys and labels of the domain; raises otherwise."""
    rows = read_lines(spark, path, schema)
    one = rows.agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys"), F.count(F.when(~F.coalesce(F.col(label).isin(domain), F.lit(False)), 1)).alias("outside")).first()
    if one.keys != one.n or one.outside:
        raise ValueError(f"{one.n} examples with {one.keys} distinct {key}, {one.outside} labels outside of {', '.join(domain)}")
    return rows


def write_with_sidecar(rows: DataFrame, path: str, facts: dict) -> dict:
    """The table, then its metadata (given facts, columns, count) as one JSON line beside it; a table without metadata wasn't finished."""
    rows.write.parquet(f"{path}/table")
    spark = rows.sparkSession
    meta = {**facts, "columns": rows.columns, "rows": spark.read.parquet(f"{path}/table").count()}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return meta


def read_with_sidecar(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The table and its metadata; raises if columns or count aren't those of the metadata."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first().value)
    rows = spark.read.parquet(f"{path}/table")
    if rows.columns != meta["columns"] or rows.count() != meta["rows"]:
        raise ValueError(f"{path} doesn't match its metadata")
    return rows, meta


def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def paired(**sources: object | None) -> bool:
    """Whether all of some sources are given; raises if only a part of them is."""
    given = sorted(k for k, v in sources.items() if v is not None)
    if given and len(given) < len(sources):
        raise ValueError(f"{', '.join(given)} need {', '.join(sorted(set(sources) - set(given)))} beside them")
    return bool(given)
