"""Serving queries, joins, sets and splits: pages, leaderboards, comparisons, folds, resamples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.text import name_key

MOST_ROWS = 100


def page(rows: DataFrame, sort: str, tie: str, limit: int, offset: int = 0, descending: bool = True, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """One page by an allow-listed column, nulls last in either direction, ties by id."""
    if allowed is not None and sort not in allowed:
        raise ValueError(f"cannot sort by {sort}")
    if not 0 < limit <= MOST_ROWS or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset not negative")
    column = F.col(sort)
    return rows.orderBy(column.desc_nulls_last() if descending else column.asc_nulls_last(), tie).offset(offset).limit(limit)


def leaderboard(profiles: DataFrame, metric: str, tie: str = "player_id", gate: Column | None = None, limit: int = 25) -> DataFrame:
    """The top rows by a metric among those that pass the gate, with their rank (over the limited rows only)."""
    rows = profiles if gate is None else profiles.where(gate)
    top = rows.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), tie).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(metric), tie)))


def in_order(rows: DataFrame, key: str, ids: list[int]) -> DataFrame:
    """Rows of two or more distinct ids, in the order asked for."""
    if len(ids) != len(set(ids)) or len(ids) < 2 or min(ids) < 0:
        raise ValueError("give at least two distinct ids")
    places = rows.sparkSession.createDataFrame([(i, n) for n, i in enumerate(ids)], f"{key} long, place int")
    return rows.join(F.broadcast(places), key).orderBy("place")  # as many rows as ids asked for


def name_matches(rows: DataFrame, name: str, wanted: str) -> DataFrame:
    """Rows of the best class of match: 1 exact, 2 contained, 3 all words contained."""
    key, want = name_key(F.col(name)), name_key(F.lit(wanted))
    words = F.split(key, " ")
    kind = F.when(key == want, 1).when(F.contains(key, want), 2).when(F.size(F.array_except(F.split(want, " "), words)) == 0, 3)
    found = rows.withColumn("match_class", kind).where("match_class is not null")
    best = found.agg(F.min("match_class").alias("_best"))
    return found.join(F.broadcast(best), F.col("match_class") == F.col("_best")).drop("_best")  # one row


def named_like(rows: DataFrame, name: str, typed: str) -> DataFrame:
    """Rows whose name contains ``typed`` in any case; ``%`` and ``_`` are plain characters."""
    return rows.where(F.contains(F.lower(name), F.lit(typed.lower())))


def subset(rows: DataFrame, teams: list[int] | None = None, matches: list[int] | None = None, group: str | None = None, without_player: int | None = None) -> DataFrame:
    """Rows of some teams, matches and a position group, without one player; a None doesn't filter, and rows without a player aren't that player's."""
    for column, wanted in (("team_id", teams), ("match_id", matches)):
        if wanted is not None:
            rows = rows.where(F.col(column).isin(wanted))
    if group is not None:
        rows = rows.where(F.col("position_group") == group)
    return rows if without_player is None else rows.where(~F.col("player_id").eqNullSafe(without_player))


def resolved(rows: DataFrame, key: str, name: str, wanted: list[str]) -> DataFrame:
    """(query, status, candidates, key) for each wanted name: whether it stands for one row, for several of its best class of match, or for none; the key only in the first case.

    The rows are read once and meet the names in a broadcast table of as many rows as names.
    """
    asked = rows.sparkSession.createDataFrame([(w,) for w in dict.fromkeys(wanted)], "query string").withColumn("_want", name_key(F.col("query")))
    keyed = rows.select(key, name_key(F.col(name)).alias("_key"))
    both = keyed.crossJoin(F.broadcast(asked))  # the names asked for
    part = F.size(F.array_except(F.split("_want", " "), F.split("_key", " "))) == 0
    kind = F.when(F.col("_key") == F.col("_want"), 1).when(F.contains("_key", "_want"), 2).when(part, 3)
    counted = both.withColumn("kind", kind).where("kind is not null").groupBy("query", "kind").agg(F.count("*").alias("candidates"), F.min(key).alias("least"))
    best = counted.groupBy("query").agg(F.min(F.struct("kind", "candidates", "least")).alias("m"))
    found = asked.join(best, "query", "left").select("query", F.coalesce("m.candidates", F.lit(0)).alias("candidates"), F.col("m.least").alias("least"))
    status = F.when(F.col("candidates") == 1, "RESOLVED").when(F.col("candidates") > 1, "AMBIGUOUS").otherwise("NOT_FOUND")
    return found.select("query", status.alias("status"), "candidates", F.when(F.col("candidates") == 1, F.col("least")).alias(key))


def contaminated(rows: DataFrame, inner: str, outer: str, unit: str, k: int) -> DataFrame:
    """For each of ``k`` outer folds: rows outside of it, and those of them whose label comes from a model that saw a unit of that fold.

    A row's label comes from all units outside its own inner fold. Counted on cells of two folds, not on rows.
    """
    cells = rows.groupBy(inner, outer).agg(F.countDistinct(unit).alias("units"), F.count("*").alias("n"))
    each = cells.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    own = F.col(outer) == F.col("fold")
    per = each.groupBy("fold", inner).agg(F.sum(F.when(~own, F.col("n")).otherwise(0)).alias("train"), F.sum(F.when(own, F.col("units")).otherwise(0)).alias("held"))
    seen = per.withColumn("seen", F.sum("held").over(Window.partitionBy("fold")) > F.col("held"))
    return seen.groupBy("fold").agg(F.sum("train").alias("training"), F.sum(F.when(F.col("seen"), F.col("train")).otherwise(0)).alias("contaminated"))


def autocomplete(rows: DataFrame, name: str, key: str, typed: str, limit: int = 10) -> DataFrame:
    """Prefix before word prefix before contained, then by name and id."""
    text, t = F.lower(F.col(name)), typed.lower()
    relevance = F.when(F.startswith(text, F.lit(t)), 0).when(F.contains(text, F.lit(" " + t)), 1).when(F.contains(text, F.lit(t)), 2)
    return rows.withColumn("relevance", relevance).where("relevance is not null").orderBy("relevance", name, key).limit(limit)


def folds(rows: DataFrame, group: str, k: int = 5) -> DataFrame:
    """A fold for each group, by the rank of its md5: deterministic and independent of row order. Ranks run over the distinct groups."""
    groups = rows.select(group).where(F.col(group).isNotNull()).distinct()
    rank = F.row_number().over(Window.orderBy(F.md5(F.col(group).cast("string").cast("binary")), group))
    return groups.withColumn("fold", ((rank - 1) % k + 1).cast("int"))


def resamples(rows: DataFrame, group: str, n: int, share: float = 0.8, round_up: bool = False) -> DataFrame:
    """``n`` deterministic subsamples without replacement of the distinct groups."""
    groups = rows.select(group).distinct().withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    w = Window.partitionBy("resample")
    order = F.md5(F.concat_ws(":", F.col("resample").cast("string"), F.col(group).cast("string")).cast("binary"))
    size = F.count("*").over(w) * share
    keep = F.row_number().over(w.orderBy(order, group)) <= (F.ceil(size) if round_up else F.round(size))
    return groups.withColumn("_k", keep).where("_k").drop("_k")


def leave_one_out(rows: DataFrame, keys: list[str], unit: str, sums: list[str]) -> DataFrame:
    """Totals of each group without each of its units: the whole less the unit's part."""
    per = rows.groupBy(*keys, unit).agg(F.count("*").alias("n"), *[F.sum(s).alias(s) for s in sums])
    w = Window.partitionBy(*keys)
    return per.select(*keys, F.col(unit).alias(f"without_{unit}"), (F.sum("n").over(w) - F.col("n")).alias("n"), *[F.round(F.sum(s).over(w) - F.col(s), 6).alias(s) for s in sums])


def one_per_url_and_host(rows: DataFrame, url: str, key: str, quality: Column) -> DataFrame:
    """Best row of each url without a trailing slash, then of each host."""
    plain = F.regexp_replace(F.col(url), "/+$", "")
    host = F.lower(F.regexp_extract(F.col(url), r"^[a-z]+://([^/?#]+)", 1))
    rows = rows.withColumns({"plain_url": plain, "host": host, "quality": quality})
    first = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("quality"), "plain_url", key))
    rows = rows.withColumn("_r", first("plain_url")).where("_r = 1")
    return rows.withColumn("_r", first("host")).where("_r = 1").drop("_r")


def filtered(rows: DataFrame, key: str, value, equal: dict | None = None, between: dict | None = None) -> DataFrame:
    """Rows of one key under optional filters; a None doesn't filter. Bounds that exclude each other raise."""
    found = rows.where(F.col(key) == value)
    for column, wanted in (equal or {}).items():
        if wanted is not None:
            found = found.where(F.col(column) == wanted)
    for column, (least, most) in (between or {}).items():
        if least is not None and most is not None and least > most:
            raise ValueError(f"{column}: {least} is more than {most}")
        if least is not None:
            found = found.where(F.col(column) >= least)
        if most is not None:
            found = found.where(F.col(column) <= most)
    return found


def three_way_split(rows: DataFrame, group: str, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """(group, part): whole groups dealt by a hash to train, validation and test."""
    groups = rows.select(group).distinct()  # a row per match
    place = F.row_number().over(Window.orderBy(F.md5(F.col(group).cast("string").cast("binary")), group))
    dealt = groups.select(group, place.alias("r"), F.count("*").over(Window.partitionBy()).alias("n"))
    part = F.when(F.col("r") <= F.floor(F.lit(train) * F.col("n")), "train").when(F.col("r") <= F.floor(F.lit(train + validation) * F.col("n")), "validation").otherwise("test")
    return dealt.select(group, part.alias("part"))
