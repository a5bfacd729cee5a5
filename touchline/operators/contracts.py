"""Data-quality contracts: each raises on a violation and returns its input otherwise. One aggregate per check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks its contract."""


def require_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    if missing := sorted(set(names) - set(rows.columns)):
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return rows


def forbid_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    if leaked := sorted(set(names) & set(rows.columns)):
        raise ContractError(f"forbidden columns: {', '.join(leaked)}")
    return rows


def require_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    null = F.sum(F.when(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) > 0, 1).otherwise(0))
    if rows.agg(null.alias("n")).first()["n"]:
        raise ContractError(f"null in {keys}")
    if rows.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ContractError(f"repeated {keys}")
    return rows


def require_range(rows: DataFrame, column: str, low: float, high: float) -> DataFrame:
    if rows.where(~F.coalesce(F.col(column).between(low, high), F.lit(False))).limit(1).count():
        raise ContractError(f"{column} outside {low} to {high}")
    return rows


def require_domain(rows: DataFrame, column: str, values: list) -> DataFrame:
    if rows.where(~F.coalesce(F.col(column).isin(values), F.lit(False))).limit(1).count():
        raise ContractError(f"{column} holds other values than {values}")
    return rows


def require_parents(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    orphans = rows.where(F.col(key).isNotNull()).join(parents, F.col(key) == F.col(parent_key), "left_anti")
    if orphans.limit(1).count():
        raise ContractError(f"{key} without a row in its parent table")
    return rows


def require_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    if a.select(key).join(b.select(key), key, "left_semi").limit(1).count():
        raise ContractError(f"{key} occurs on both sides")


def require_order(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """``index`` is unique within the keys."""
    return require_unique(rows, [*keys, index])


def require_ranks(rows: DataFrame, key: str, other: str, rank: str, distance: str) -> DataFrame:
    """No row ranks itself; ranks are consecutive from 1; distances don't fall with the rank."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(rank)
    bad = rows.withColumns({"_n": F.row_number().over(w), "_d": F.lag(distance).over(w)}).where((F.col(key) == F.col(other)) | (F.col("_n") != F.col(rank)) | (F.col("_d") > F.col(distance)))
    if bad.limit(1).count():
        raise ContractError("ranks are not consecutive, monotone and free of self-matches")
    return rows


def require_close(a: DataFrame, b: DataFrame, key: str, columns: list[str], rtol: float = 1e-7, atol: float = 2e-7) -> None:
    """Both tables have the same keys, and values are equal within the tolerance; null is equal to null alone."""
    x, y = (t.select(F.col(key).alias("_key"), F.lit(True).alias("_there"), *columns).alias(n) for t, n in ((a, "a"), (b, "b")))
    joined = x.join(y, F.col("a._key").eqNullSafe(F.col("b._key")), "full")
    bad = F.col("a._there").isNull() | F.col("b._there").isNull()
    for c in columns:
        left, right = F.col(f"a.{c}"), F.col(f"b.{c}")
        bad = bad | (left.isNull() != right.isNull()) | F.coalesce(F.abs(left - right) > atol + rtol * F.abs(right), F.lit(False))
    if joined.where(bad).limit(1).count():
        raise ContractError("recomputed values differ")
