"""Raw match files: the catalogue of competitions, which matches are available, payloads of either shape, checked corpora, chronology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.operators.ordering import ordinals
from touchline.sources.event_json import SCHEMA, completed, shot_facts, xy

# Catalogue ---------------------------------------------------------------------------------------------------------------

CATALOGUE = ["competition_id", "season_id", "country_name", "competition_name", "season_name"]


def season(name: Column) -> Column:
    """``2023/2024`` for ``2023/24``, ``2023-24`` and itself; anything else trimmed."""
    plain = F.replace(F.trim(name), F.lit("-"), F.lit("/"))
    first, last = F.regexp_extract(plain, "^([0-9]+)/([0-9]+)$", 1), F.regexp_extract(plain, "^([0-9]+)/([0-9]+)$", 2)
    start, end = first.try_cast("int"), last.try_cast("int")
    whole = F.when(end < 100, F.floor(start / 100) * 100 + end).otherwise(end)
    return F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lpad(start.cast("string"), 4, "0"), F.lit("/"), F.lpad(whole.cast("string"), 4, "0"))).otherwise(plain)


def season_start(name: Column) -> Column:
    return F.coalesce(F.split(season(name), "/")[0].try_cast("int"), F.lit(-1))


def _men(catalogue: DataFrame) -> DataFrame:
    if missing := [c for c in CATALOGUE if c not in catalogue.columns]:
        raise ValueError(f"the catalogue lacks {', '.join(sorted(missing))}")
    return catalogue.where(F.lower("competition_gender") == "male") if "competition_gender" in catalogue.columns else catalogue


def newest_or_preferred(catalogue: DataFrame, preferred: str) -> DataFrame:
    """For each men's competition the preferred season, else the one that starts last; ties go to the smaller season id."""
    rows = _men(catalogue)
    w = Window.partitionBy(F.lower("country_name"), F.lower("competition_name"))
    order = [F.when(season(F.col("season_name")) == preferred, 0).otherwise(1), season_start(F.col("season_name")).desc(), F.col("season_id")]
    return rows.withColumn("_r", F.row_number().over(w.orderBy(*order))).where("_r = 1").select(*CATALOGUE)


def chosen_competition(catalogue: DataFrame, country: str, competition: str, preferred: str) -> dict:
    """One competition's choice as a dict; raises if there is none."""
    if not catalogue.limit(1).count():
        raise ValueError("the catalogue is empty")
    mine = _men(catalogue).where((F.lower("country_name") == country.lower()) & (F.lower("competition_name") == competition.lower()))
    found = newest_or_preferred(mine, preferred).limit(1).collect()
    if not found:
        raise ValueError(f"no season of {competition} ({country})")
    return found[0].asDict()


def exact_corpus(catalogue: DataFrame, targets: DataFrame) -> DataFrame:
    """The catalogue row of each target (country_name, competition_name, season_name); raises unless each has exactly one."""
    key = ["country_name", "competition_name", "season_name"]
    found = targets.select(*key).join(_men(catalogue).select(*CATALOGUE), key, "left")
    wrong = found.groupBy(*key).agg(F.count("season_id").alias("n")).where("n <> 1").collect()  # targets, which are few
    if wrong:
        raise ValueError("targets without exactly one season: " + ", ".join(sorted(f"{r.competition_name} {r.season_name}: {r.n}" for r in wrong)))
    return found.select(*CATALOGUE)


def available_matches(matches: DataFrame) -> DataFrame:
    """Distinct ids of the matches whose status, if there is one, is ``available``."""
    if "match_id" not in matches.columns:
        raise ValueError("the matches lack match_id")
    rows = matches.where(F.lower("match_status") == "available") if "match_status" in matches.columns else matches
    return rows.where(F.col("match_id").isNotNull()).select(F.col("match_id").cast("long").alias("match_id")).distinct()


def chronology(matches: DataFrame, wanted: DataFrame, columns: list[str] = ()) -> DataFrame:
    """(match_id, match_date, kick_off, columns, ordinal) of the wanted matches, in order of date, kick-off and id; raises if one is missing, repeated or without a date."""
    dated = matches.join(wanted.select("match_id").distinct(), "match_id", "left_semi").select("match_id", F.to_date(F.col("match_date").cast("string").try_cast("timestamp")).alias("match_date"), F.col("kick_off").cast("string").alias("kick_off"), *columns)
    each = wanted.select("match_id").distinct().join(dated.groupBy("match_id").agg(F.count("*").alias("n"), F.count("match_date").alias("dates")), "match_id", "left")
    bad = each.agg(F.count(F.when(F.col("n").isNull(), 1)).alias("missing"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated"), F.count(F.when(F.col("n") > F.col("dates"), 1)).alias("undated")).first()
    if any(bad):
        raise ValueError(f"chronology: {bad.missing} matches missing, {bad.repeated} repeated, {bad.undated} without a date")
    return ordinals(dated, ["match_date", "kick_off", "match_id"])


# Payloads ----------------------------------------------------------------------------------------------------------------


def match_files(spark: SparkSession, path: str) -> DataFrame:
    """(match_id, payload): a row per file, named by its match."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.regexp_extract(F.col("_metadata.file_path"), r"([0-9]+)\.json$", 1).try_cast("long").alias("match_id"), F.col("value").alias("payload"))


def payload_events(files: DataFrame) -> DataFrame:
    """The events of payloads that are a list of events or a map of them by id; the file's match id fills in a missing one.

    Members that aren't objects are left out; a payload that is neither shape, or isn't JSON, raises with its match.
    """
    start = F.substring(F.ltrim("payload"), 1, 1)
    listed, mapped = F.from_json("payload", "array<string>"), F.map_values(F.from_json("payload", "map<string,string>"))
    members = F.when(start == "[", listed).when(start == "{", mapped)
    broken = F.raise_error(F.concat(F.lit("payload of match "), F.coalesce(F.col("match_id").cast("string"), F.lit("?")), F.lit(" is neither a list nor a map of events"))).cast("array<string>")
    # a text that only begins like JSON gives null or a null member
    sound = F.from_json("payload", "_c string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})["_corrupt"].isNull()
    each = files.select("match_id", F.explode(F.when(members.isNotNull() & (sound | (start == "[")), members).otherwise(broken)).alias("member"))
    parsed = each.where(F.startswith(F.ltrim("member"), F.lit("{"))).select(F.col("match_id").alias("file_match"), F.from_json("member", SCHEMA).alias("e"))
    return parsed.select("file_match", "e.*").withColumn("match_id", F.coalesce("match_id", "file_match")).drop("file_match")


def pass_table(events: DataFrame) -> DataFrame:
    """All twenty columns of a pass."""
    p = events.where(F.col("type.name") == "Pass")
    (sx, sy), (ex, ey) = xy(F.col("location")), xy(F.col("pass.end_location"))
    named = lambda c, part: F.col(f"{c}.{part}")
    return p.select(
        "match_id", named("player", "id").alias("player_id"), named("player", "name").alias("player_name"), named("team", "id").alias("team_id"), named("team", "name").alias("team_name"), named("position", "name").alias("position"), "minute", "second",
        sx.alias("start_x"), sy.alias("start_y"), ex.alias("end_x"), ey.alias("end_y"), F.col("pass.length").alias("pass_length"), F.col("pass.angle").alias("pass_angle"), F.col("pass.height.name").alias("pass_height"), F.col("pass.body_part.name").alias("body_part"),
        F.col("pass.type.name").alias("pass_type"), F.coalesce("under_pressure", F.lit(False)).alias("under_pressure"), F.col("pass.outcome.name").alias("pass_outcome"), completed(F.col("pass.outcome")).alias("completed"),
    )


def competition_passes(files: DataFrame, matches: DataFrame) -> tuple[DataFrame, int]:
    """The passes of the available matches and how many matches there are; raises if none is available or a file is missing."""
    wanted = available_matches(matches)
    n = wanted.count()
    if not n:
        raise ValueError("no match is available")
    if missing := wanted.join(files.select("match_id").distinct(), "match_id", "left_anti").count():
        raise ValueError(f"{missing} available matches have no file")
    return pass_table(payload_events(files.join(wanted, "match_id", "left_semi"))), n


def counted_events(files: DataFrame, expected_matches: int) -> DataFrame:
    """The events of exactly so many matches."""
    if (n := files.select("match_id").distinct().count()) != expected_matches:
        raise ValueError(f"expected {expected_matches} matches, found {n}")
    return payload_events(files)


def shot_corpus(files: DataFrame, matches: DataFrame, expected: dict[int, int]) -> DataFrame:
    """The shots of several competitions with ``competition_id``; raises unless each has its number of available matches, shot ids are unique, and every shot has an outcome.

    ``matches``: (competition_id, match_id, match_status).
    """
    keyed = matches.where(F.lower("match_status") == "available").select("competition_id", "match_id").distinct()
    found = {r.competition_id: r.n for r in keyed.groupBy("competition_id").agg(F.count("*").alias("n")).collect()}  # a row per competition
    if found != expected:
        raise ValueError(f"expected matches {expected}, found {found}")
    events = payload_events(files.join(keyed, "match_id", "left_semi"))
    shots = shot_facts(events).join(events.where(F.col("type.name") == "Shot").select(F.col("id").alias("shot_id"), F.col("shot.outcome.name").alias("outcome")).distinct(), "shot_id", "left")
    n = events.where(F.col("type.name") == "Shot").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count("shot.outcome.name").alias("outcomes")).first()
    if n.ids != n.n or n.outcomes != n.n:
        raise ValueError(f"{n.n} shots with {n.ids} distinct ids and {n.outcomes} outcomes")
    return shots.join(keyed, "match_id")


# Positions ---------------------------------------------------------------------------------------------------------------

# The broad group of each position.
GROUPS = {
    "GK": ["Goalkeeper"],
    "DEF": ["Center Back", "Left Back", "Left Center Back", "Left Wing Back", "Right Back", "Right Center Back", "Right Wing Back"],
    "MID": ["Center Attacking Midfield", "Center Defensive Midfield", "Left Attacking Midfield", "Left Center Midfield", "Left Defensive Midfield", "Left Midfield", "Right Attacking Midfield", "Right Center Midfield", "Right Defensive Midfield", "Right Midfield"],
    "FWD": ["Center Forward", "Left Center Forward", "Left Wing", "Right Center Forward", "Right Wing"],
}


def position_group(position: Column, groups: dict[str, list[str]] = GROUPS) -> Column:
    """The broad group of a position; one that no group has raises."""
    known = F.create_map(*[F.lit(x) for g, names in groups.items() for n in names for x in (n, g)])
    return F.coalesce(F.try_element_at(known, F.trim(position)), F.raise_error(F.concat(F.lit("no group for position "), F.coalesce(position, F.lit("null")))).cast("string"))
