"""Rows of two sources matched by position, with proof that the positions mean the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.ordering import ordinals

RELATIVE, ABSOLUTE = 1e-5, 1e-8


def close(a: Column, b: Column) -> Column:
    """Equal up to 1e-8 and 1e-5 of the second; missing equals missing only."""
    a, b = (F.when(~F.isnan(x.cast("double")), x.cast("double")) for x in (a, b))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((a == b) | (F.abs(a - b) <= ABSOLUTE + RELATIVE * F.abs(b)))


def same(a: Column, b: Column) -> Column:
    return a.cast("string").eqNullSafe(b.cast("string"))


def with_group_ordinal(rows: DataFrame, group: str, order: list[str], name: str = "ordinal") -> DataFrame:
    """The position of each row in its group, from 0."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("long"))


def with_global_ordinal(rows: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    return ordinals(rows, order, name)


def matched(left: DataFrame, right: DataFrame, on: list[str], exact: list[str], near: list[str]) -> DataFrame:
    """Full outer join on the position: columns of both sides as ``left_*`` and ``right_*``, ``present`` (both, left, right), and ``differs``: the names of columns that don't agree."""
    a = left.select(*[F.col(c).alias(c if c in on else f"left_{c}") for c in left.columns], F.lit(True).alias("_l"))
    b = right.select(*[F.col(c).alias(c if c in on else f"right_{c}") for c in right.columns], F.lit(True).alias("_r"))
    joined = a.join(b, on, "full")
    present = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left").otherwise("right")
    wrong = [F.when(~same(F.col(f"left_{c}"), F.col(f"right_{c}")), c) for c in exact] + [F.when(~close(F.col(f"left_{c}"), F.col(f"right_{c}")), c) for c in near]
    differs = F.when(present == "both", F.array_compact(F.array(*wrong))).otherwise(F.array().cast("array<string>"))
    return joined.select(*[c for c in joined.columns if c not in ("_l", "_r")], present.alias("present"), differs.alias("differs"))


def alignment_report(pairs: DataFrame) -> DataFrame:
    """(problem, rows): positions on one side only, and disagreements by column."""
    problem = F.when(F.col("present") == "both", F.col("differs")).otherwise(F.array(F.concat(F.lit("only on the "), "present")))
    return pairs.select(F.explode(problem).alias("problem")).groupBy("problem").agg(F.count("*").alias("rows"))


def aligned(left: DataFrame, right: DataFrame, on: list[str], exact: list[str] = (), near: list[str] = ()) -> DataFrame:
    """The matched rows; raises with the counts unless every position is on both sides, once, and all columns agree."""
    for name, side in (("left", left), ("right", right)):
        if side.groupBy(*on).count().where("count > 1").limit(1).count():
            raise ValueError(f"positions of the {name} side repeat")
    pairs = matched(left, right, list(on), list(exact), list(near))
    if problems := {r.problem: r.rows for r in alignment_report(pairs).collect()}:  # a row per column
        raise ValueError(f"sources are not aligned: {dict(sorted(problems.items()))}")
    return pairs.drop("present", "differs")
