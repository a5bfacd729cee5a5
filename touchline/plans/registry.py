"""All registered queries over the given tables and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.plans import aligned, answers, audits, choices, cluster_reports, clusters, evidence, models, pages, profiles, raw, roles, sequences, serving, stability, state_values, teams, vectors  # noqa: F401  (they register their queries)
from touchline.plans.base import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["passing_profile"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
