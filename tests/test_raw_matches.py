import json

import pytest
from pyspark.sql import functions as F

from touchline.sources import raw_matches as R


def event(i, kind="Pass", **more):
    return {"id": i, "type": {"id": 1, "name": kind}, "team": {"id": 1, "name": "X"}, "player": {"id": 2, "name": "P"}, "location": [1.0, 2.0], **more}


def files(spark, *rows):
    return spark.createDataFrame([(m, p if isinstance(p, str) else json.dumps(p)) for m, p in rows], "match_id long, payload string")


def test_both_shapes_of_a_payload(spark, tmp_path):
    (tmp_path / "11.json").write_text(json.dumps([event("a"), 5, None, "text", event("b", match_id=99)]))
    (tmp_path / "12.json").write_text(json.dumps({"c": event("c"), "note": "text", "none": None}, indent=2))
    found = R.payload_events(R.match_files(spark, str(tmp_path))).select("id", "match_id", "team.name").collect()
    assert sorted(map(tuple, found)) == [("a", 11, "X"), ("b", 99, "X"), ("c", 12, "X")]
    assert R.payload_events(files(spark, (1, []), (2, {}))).count() == 0


@pytest.mark.parametrize("payload", ['"a text"', "17", "", "not json", '{"a": ', "[1, {", None])
def test_other_payloads_raise(spark, payload):
    bad = spark.createDataFrame([(8, payload)], "match_id long, payload string")
    with pytest.raises(Exception, match="payload of match 8"):
        R.payload_events(bad).collect()


def test_all_columns_of_a_pass(spark):
    whole = event("a", minute=3, second=4, position={"id": 1, "name": "Left Wing"}, under_pressure=True, **{"pass": {"end_location": [5.0, 6.0], "length": 7.5, "angle": 0.5, "height": {"id": 1, "name": "Low"}, "body_part": {"id": 1, "name": "Head"}, "type": {"id": 1, "name": "Corner"}, "outcome": {"id": 9, "name": "Out"}}})
    rows = R.pass_table(R.payload_events(files(spark, (4, [whole, event("b"), event("c", "Shot"), event("d", location=[1.0])]))))
    assert len(rows.columns) == 20
    got = [tuple(r) for r in rows.collect()]
    assert got[0] == (4, 2, "P", 1, "X", "Left Wing", 3, 4, 1.0, 2.0, 5.0, 6.0, 7.5, 0.5, "Low", "Head", "Corner", True, "Out", 0)
    assert got[1][8:12] == (1.0, 2.0, None, None) and got[1][-3:] == (False, None, 1) and got[2][8:10] == (None, None) and len(got) == 3


CATALOGUE = "competition_id int, season_id int, country_name string, competition_name string, season_name string, competition_gender string"
ROWS = [(9, 1, "Germany", "1. Liga", "2015/16", "male"), (9, 2, "Germany", "1. Liga", "2023/2024", "Male"), (9, 3, "Germany", "1. Liga", "2024-25", "male"), (9, 4, "Germany", "1. Liga", "2030/31", "female"), (2, 5, "England", "League", "2003/04", "male"), (2, 6, "England", "League", "odd", "male")]


def test_choice_of_a_season(spark):
    c = spark.createDataFrame(ROWS, CATALOGUE)
    assert R.chosen_competition(c, "GERMANY", "1. liga", "2023/2024")["season_id"] == 2
    assert R.chosen_competition(c, "germany", "1. Liga", "1999/2000")["season_id"] == 3
    assert {r.competition_id: r.season_id for r in R.newest_or_preferred(c, "2015/2016").collect()} == {9: 1, 2: 5}
    assert R.chosen_competition(c.drop("competition_gender"), "Germany", "1. Liga", "x")["season_id"] == 4
    for bad, message in ((c.drop("season_name"), "lacks season_name"), (c.limit(0), "empty"), (c.where("competition_id = 2"), "no season")):
        with pytest.raises(ValueError, match=message):
            R.chosen_competition(bad, "Germany", "1. Liga", "2023/2024")


def test_seasons(spark):
    names = ["2023/24", " 2023-24 ", "2023/2024", "1999/00", "2024", "a/b", "99/05"]
    got = [tuple(r) for r in spark.createDataFrame([(n,) for n in names], "n string").select(R.season(F.col("n")), R.season_start(F.col("n"))).collect()]
    assert got == [("2023/2024", 2023)] * 3 + [("1999/1900", 1999), ("2024", 2024), ("a/b", -1), ("0099/0005", 99)]


def test_exact_corpus(spark):
    c = spark.createDataFrame([*ROWS, (2, 7, "England", "League", "2003/04", "female")], CATALOGUE)
    target = lambda *t: spark.createDataFrame(list(t), "country_name string, competition_name string, season_name string")
    assert {r.season_id for r in R.exact_corpus(c, target(("Germany", "1. Liga", "2015/16"), ("England", "League", "2003/04"))).collect()} == {1, 5}
    with pytest.raises(ValueError, match="League 1999/00: 0"):
        R.exact_corpus(c, target(("England", "League", "1999/00")))
    with pytest.raises(ValueError, match="League 2003/04: 2"):
        R.exact_corpus(c.drop("competition_gender"), target(("England", "League", "2003/04")))


def test_available_matches_and_passes(spark):
    m = spark.createDataFrame([(1, "Available"), (1, "available"), (2, "deleted"), (None, "available"), (3, None)], "match_id long, match_status string")
    assert [r.match_id for r in R.available_matches(m).collect()] == [1]
    assert sorted(r.match_id for r in R.available_matches(m.drop("match_status")).collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="lack match_id"):
        R.available_matches(m.drop("match_id"))
    f = files(spark, (1, [event("a"), event("b")]), (2, [event("c")]))
    passes, n = R.competition_passes(f, m)
    assert passes.count() == 2 and n == 1
    with pytest.raises(ValueError, match="no match"):
        R.competition_passes(f, m.where("match_id = 2"))
    with pytest.raises(ValueError, match="1 available matches have no file"):
        R.competition_passes(f.where("match_id = 2"), m)
    assert R.counted_events(f, 2).count() == 3
    with pytest.raises(ValueError, match="expected 233 matches, found 2"):
        R.counted_events(f, 233)


def test_shot_corpus(spark):
    shot = lambda i, o={"id": 1, "name": "Goal"}: event(i, "Shot", shot={"outcome": o})  # noqa: E731, B006
    m = spark.createDataFrame([(9, 1, "available"), (9, 2, "available"), (2, 3, "available"), (2, 4, "deleted")], "competition_id int, match_id long, match_status string")
    f = files(spark, (1, [shot("a"), event("p")]), (2, {"b": shot("b")}), (3, [shot("c", {"id": 2, "name": "Saved"})]), (4, [shot("x")]))
    got = R.shot_corpus(f, m, {9: 2, 2: 1})
    assert {(r.shot_id, r.competition_id, r.goal) for r in got.collect()} == {("a", 9, True), ("b", 9, True), ("c", 2, False)}
    with pytest.raises(ValueError, match="expected matches"):
        R.shot_corpus(f, m, {9: 2, 2: 2})
    with pytest.raises(ValueError, match="2 distinct ids"):
        R.shot_corpus(files(spark, (1, [shot("a")]), (2, [shot("a")]), (3, [shot("c")])), m, {9: 2, 2: 1})
    with pytest.raises(ValueError, match="2 outcomes"):
        R.shot_corpus(files(spark, (1, [shot("a")]), (2, [shot("b", None)]), (3, [shot("c")])), m, {9: 2, 2: 1})


def test_chronology(spark):
    m = spark.createDataFrame([(3, "2023-08-19", "15:30"), (1, "2023-08-19", "15:30"), (2, "2023-08-18", "20:30"), (4, "2023-08-19", "13:00"), (5, "2024-01-01", "15:30")], "match_id long, match_date string, kick_off string")
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "match_id long")
    assert [r.match_id for r in R.chronology(m, ids(1, 2, 3, 4)).orderBy("ordinal").collect()] == [2, 4, 1, 3]
    for rows, wanted, message in ((m, ids(1, 8), "1 matches missing"), (m.union(m.limit(1)), ids(3), "1 repeated"), (m.withColumn("match_date", F.lit("bad")), ids(3), "1 without a date")):
        with pytest.raises(ValueError, match=message):
            R.chronology(rows, wanted)


def test_position_groups(spark):
    of = lambda p: spark.createDataFrame([(p,)], "p string").select(R.position_group(F.col("p")).alias("g")).first().g
    assert [of(p) for p in ("Goalkeeper", "Left Wing Back", " Right Midfield ", "Left Wing")] == ["GK", "DEF", "MID", "FWD"]
    for bad in ("Sweeper", None):
        with pytest.raises(Exception, match="no group"):
            of(bad)
