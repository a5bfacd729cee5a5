import json

import pytest

from touchline.sources import event_json as J
from touchline.sources import snapshots

EVENTS = [
    {"id": "a", "index": 1, "match_id": 7, "period": 1, "timestamp": "00:00:01.500", "type": {"id": 30, "name": "Pass"}, "possession": 1, "possession_team": {"id": 1, "name": "X"}, "team": {"id": 1, "name": "X"}, "player": {"id": 9, "name": "P"}, "location": [10.0, 20.0], "pass": {"end_location": [50.0, 30.0]}},
    {"id": "b", "index": 2, "match_id": 7, "period": 1, "timestamp": "bad", "type": {"id": 30, "name": "Pass"}, "possession": 1, "possession_team": {"id": 1, "name": "X"}, "team": {"id": 2, "name": "Y"}, "location": [1.0], "pass": {"outcome": {"id": 9, "name": "Incomplete"}}, "under_pressure": True},
    {"id": "c", "index": 3, "match_id": 7, "period": 5, "timestamp": "00:10:00.000", "type": {"id": 16, "name": "Shot"}, "possession": 2, "possession_team": {"id": 1, "name": "X"}, "team": {"id": 1, "name": "X"}, "location": [110.0, 40.0], "shot": {"outcome": {"id": 97, "name": "Goal"}, "type": {"id": 88, "name": "Penalty"}}},
]


@pytest.fixture
def raw(spark, tmp_path):
    (tmp_path / "7.json").write_text(json.dumps(EVENTS))
    return J.read_events(spark, str(tmp_path))


def test_flat_facts(raw):
    facts = {r.event_id: r for r in J.event_facts(raw).collect()}
    assert (facts["a"].start_x, facts["a"].end_y, facts["a"].seconds, facts["a"].success, facts["a"].under_pressure) == (10.0, 30.0, 1.5, True, False)
    assert (facts["b"].start_x, facts["b"].seconds, facts["b"].success) == (None, None, False)
    assert {r.event_id: r.completed for r in J.pass_facts(raw).collect()} == {"a": 1, "b": 0}
    shot = J.shot_facts(raw).first()
    assert (shot.goal, shot.penalty, shot.shootout, shot.eligible) == (True, True, True, False)
    assert [r.event_id for r in J.on_ball(J.event_facts(raw), ["Pass"]).collect()] == ["a"]


def test_snapshot_round_trip(spark, tmp_path):
    path = str(tmp_path / "v1")
    first = snapshots.write_snapshot({"t": spark.range(5)}, path)
    spark.range(9).write.parquet(f"{path}/unpublished/t")
    assert snapshots.read_snapshot(spark, path)["t"].count() == 5
    version = snapshots.write_snapshot({"t": spark.range(6)}, path)
    assert snapshots.read_snapshot(spark, path)["t"].count() == 6 and snapshots.read_snapshot(spark, path, first)["t"].count() == 5
    spark.range(1).write.mode("append").parquet(f"{path}/{version}/t")
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, path)
    assert snapshots.fingerprint(spark.range(3), "id").first().rows == 3
