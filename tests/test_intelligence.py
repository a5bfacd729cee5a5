import json

import pytest
from pyspark.sql import functions as F

from touchline.operators import intelligence as I
from touchline.operators import selection as X

REGISTRY = [I.Metric("a", "style", "n", 10, "rate", radar=True), I.Metric("b", "style", "n", 1, "rate", radar=True), I.Metric("c", "performance", "m", 1, "goals", radar=True), I.Metric("d", "performance", "m", 5, "goals")]
SCHEMA = "player_id long, grp string, a double, b double, c double, d double, n int, m int"


@pytest.fixture(scope="module")
def profiles(spark):
    rows = [(i, "DEF", float(i // 2), float(-i), float(i), 1.0, 9 + i, 9) for i in range(12)]
    rows += [(100 + i, "FWD", 1.0, 2.0, 3.0, 4.0, 50, None if i == 0 else 50) for i in range(9)] + [(200, "GK", 1.0, None, float("nan"), 1.0, 50, 50)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_registries_are_checked():
    assert I.checked(REGISTRY) == REGISTRY
    for bad, message in (([*REGISTRY, REGISTRY[0]], "unique"), (REGISTRY[:2], "both occur"), ([*REGISTRY, I.Metric("e", "style", "n", 0, "rate")], "at least 1"), ([*REGISTRY, I.Metric("e", "other", "n", 1, "rate")], "style or performance")):
        with pytest.raises(ValueError, match=message):
            I.checked(bad)


def test_metrics_give_the_first_reason_and_tied_percentiles(spark, profiles):
    got = {(r.player_id, r.metric): r for r in I.metric_rows(profiles, "player_id", "grp", REGISTRY).collect()}
    assert len(got) == 22 * 4
    first = got[0, "a"]
    assert (first.reason, first.percentile, first.eligible, first.peer_count) == ("requires_10_n", None, False, 11)
    # eleven eligible values 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5: average ranks among them
    assert [round(got[i, "a"].percentile, 6) for i in (1, 2, 3, 11)] == [0.0, 15.0, 15.0, 95.0]
    assert [got[i, "b"].percentile for i in (0, 11)] == [100.0, 0.0]
    assert {got[100 + i, "b"].reason for i in range(9)} == {"requires_10_eligible_position_peers"} and got[103, "b"].peer_count == 9 and got[103, "b"].percentile is None
    assert (got[100, "d"].reason, got[100, "d"].sample_count) == ("requires_5_m", 0)
    assert got[200, "b"].reason == got[200, "c"].reason == "metric_unavailable"


def test_radar_rule(spark, profiles):
    got = {r.player_id: r for r in I.radars(I.metric_rows(profiles, "player_id", "grp", REGISTRY), "player_id", "grp").collect()}
    assert (got[1].radar, got[1].status, got[1].style_metrics, got[1].performance_metrics) == (["a", "b", "c"], "peer_percentiles", 2, 2)
    assert (got[0].radar, got[0].status) == ([], "insufficient_eligible_metrics") and (got[105].radar, got[105].status) == ([], "insufficient_eligible_metrics")
    assert (got[200].radar, got[200].status) == ([], "limited_goalkeeper_profile")


def test_support_messages(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,), (3,)], "m int")
    (level, text), (own, line) = I.pair_support(F.col("m")), I.player_support(F.col("m"))
    got = [tuple(r) for r in rows.select(level, own, line).collect()]
    assert got == [("limited", "limited", "Limited sample: observed across 0 matches."), ("limited", "limited", "Limited sample: observed across 1 match."), ("limited", "limited", "Limited sample: observed across 2 matches."), ("higher", "higher", "Higher sample support: observed across 3 matches.")]
    assert "fewer than 3" in rows.limit(1).select(text).first()[0]
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([(-1,)], "m int").select(level).collect()


def test_contributors_and_role_support(spark):
    rows = spark.createDataFrame([("DEF", 1, "x")] * 3 + [("DEF", 2, "y")] * 5 + [("DEF", 3, "z")] * 3 + [("MID", i, "m") for i in range(4)], "g string, player_id long, name string")
    got = {r.g: r for r in I.contributors(rows, ["g"], "player_id", "name").collect()}
    assert [c["player_id"] for c in json.loads(got["DEF"].contributors)] == [2, 1, 3] and json.loads(got["DEF"].contributors)[0] == {"player_id": 2, "player_name": "y", "actions": 5, "action_share": 0.454545}
    level, message = I.role_support(F.col("g"), F.lit(33), F.col("contributor_count"))
    said = {r.g: (r.level, r.message) for r in I.contributors(rows, ["g"], "player_id", "name").select("g", level.alias("level"), message.alias("message")).collect()}
    assert said["DEF"] == ("limited_contributor_diversity", "Limited contributor diversity: Observed across 33 matches and 3 contributing DEF players.") and said["MID"] == ("established", "Observed across 33 matches and 4 contributing MID players.")
    assert I.outfield_role("FWD") == "FWD"
    with pytest.raises(LookupError):
        I.outfield_role("GK")


def test_stored_statistics(spark):
    stats = spark.createDataFrame([("DEF", "a", 2.0, 0.5), ("DEF", "b", 1.0, 2.0), ("MID", "a", 0.0, 0.0), ("MID", "b", 0.0, 1.0)], "grp string, feature string, mean double, std double")
    rows = lambda g: spark.createDataFrame([(g, 3.0, 0.0)], "grp string, a double, b double")
    assert tuple(I.onto_statistics(rows("DEF"), stats, "grp", ["a", "b"]).first()) == ("DEF", 3.0, 0.0, 2.0, -0.5)
    for g in ("MID", "FWD"):
        with pytest.raises(Exception, match=f"no usable statistics of a for {g}"):
            I.onto_statistics(rows(g), stats, "grp", ["a", "b"]).collect()


def test_clustering_matrix(spark):
    good = spark.createDataFrame([("x", -1.0), ("x", 1.0), ("y", 0.0)], "g string, z double")
    assert I.standardised(good, "g", ["z"]).count() == 3
    for bad, message in (([("x", -1.0), ("x", 1.1)], "isn't standardised"), ([("x", -2.0), ("x", 2.0)], "isn't standardised"), ([("x", None), ("x", 0.0)], "1 values missing")):
        with pytest.raises(ValueError, match=message):
            I.standardised(spark.createDataFrame(bad, "g string, z double"), "g", ["z"])


def test_names_with_wildcards(spark):
    rows = spark.createDataFrame([("Borussia 100%",), ("BORUSSIA",), ("other",), (None,)], "name string")
    assert [X.named_like(rows, "name", t).count() for t in ("russ", "100%", "%", "_", "")] == [2, 1, 1, 0, 3]


def test_concentration(spark):
    rows = [("a", i) for i in range(10)] + [("b", 1)] * 2 + [("b", i) for i in range(2, 5)] + [("c", i) for i in (1, 1, 2, 2, 3)] + [("d", i) for i in (1, 1, 1, 2, 2, 2, 3, 3, 4)]
    got = {r.g: (r.players, round(r.top_share, 4), round(r.top_two_share, 4), r.note) for r in I.concentration(spark.createDataFrame(rows, "g string, p int"), ["g"], "p").collect()}
    assert got == {"a": (10, 0.1, 0.2, "distributed"), "b": (4, 0.4, 0.6, "concentrated"), "c": (3, 0.4, 0.8, "concentrated"), "d": (4, 0.3333, 0.6667, "concentrated")}


def test_sources_beside_one_another(spark):
    from touchline.operators import profiles as P

    base = spark.createDataFrame([("x", 1, 5), ("x", None, 6), ("y", 2, 7)], "g string, m int, passes int")
    shots = spark.createDataFrame([("x", None, 3, 0.5), ("z", 1, 1, 0.1)], "g string, m int, shots int, xg double")
    got = {(r.g, r.m): (r.passes, r.shots, r.xg) for r in P.beside(base, ["g", "m"], [shots], ["shots"]).collect()}
    assert got == {("x", 1): (5, 0, None), ("x", None): (6, 3, 0.5), ("y", 2): (7, 0, None)}


def test_chart_kinds(spark):
    from touchline.functions import charts as K

    rows = spark.createDataFrame([("Corner", "High Pass", "Head", True, "Free Kick", "From Corner", 5), (None, "Low Pass", "Left Foot", False, "Free Kick", "Regular Play", 9), ("Recovery", None, None, False, "Open Play", "From Kick Off", 2), ("x", "x", "x", None, None, "From Counter", None), ("Throw-in", None, "Right Foot", False, "Open Play", "Other", 1)], "t string, h string, b string, p boolean, s string, y string, n int")
    got = [tuple(r) for r in rows.select(K.pass_kind(F.col("t"), F.col("h")), K.body_part(F.col("b")), K.shot_context(F.col("p"), F.col("s"), F.col("y")), K.period(F.col("n"))).collect()]
    assert got == [("corner", "head", "penalty", 5), ("low", "left-foot", "direct-free-kick", 1), ("other", "other", "set-piece", 2), ("other", "other", "fast-break", 1), ("throw-in", "right-foot", "other", 1)]
