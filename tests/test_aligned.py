import math

import pytest
from pyspark.sql import functions as F

from touchline.operators import alignment as A
from touchline.operators import padding as D

SCHEMA = "match_id long, possession_id long, place int, id long, x double, flag boolean, kind string, y double"


def state(m, p, place, i, x=1.0, flag=True, kind="a", y=0.0):
    return (m, p, place, i, x, flag, kind, y)


@pytest.fixture(scope="module")
def encoder(spark):
    train = [state(1, 1, 1, 1, 1.0, True, "b"), state(1, 1, 2, 2, None, True, "a"), state(1, 2, 1, 3, 3.0, False, None), state(1, 2, 2, 4, 8.0, None, "Unknown"), state(1, 2, 3, 5, math.nan, None, "b")]
    return D.Encoder(["x"], ["flag"], ["kind"]).fit(spark.createDataFrame(train, SCHEMA))


def test_statistics_come_from_training_rows(spark, encoder):
    assert encoder.medians == {"x": 3.0} and encoder.modes == {"flag": 1.0} and encoder.vocabularies == {"kind": {"Unknown": 0, "a": 1, "b": 2}}
    filled = [1.0, 3.0, 3.0, 8.0, 3.0]
    mean = sum(filled) / 5
    assert encoder.means["x"] == pytest.approx(mean) and encoder.scales["x"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in filled) / 5))
    row = encoder.encode(spark.createDataFrame([state(9, 9, 1, 1, math.inf, None, "never seen")], SCHEMA)).first()
    assert row.continuous == [pytest.approx((3.0 - mean) / encoder.scales["x"])] and row.binary == [1.0] and row.categorical == [0]


def test_medians(spark):
    rows = spark.createDataFrame([(float(v), None if v % 2 else float(-v)) for v in range(10)], "a double, b double")
    assert D.exact_medians(rows, ["a", "b"]) == {"a": 4.5, "b": -4.0}
    with pytest.raises(ValueError, match="no value of x"):
        D.Encoder(["x"], [], []).fit(spark.createDataFrame([(None,)], "x double"))
    assert D.Encoder(["x"], [], []).fit(spark.createDataFrame([(2.0,), (2.0,)], "x double")).scales == {"x": 1.0}


def test_sequences_are_padded_to_their_batch(spark, encoder):
    rows = [state(m, p, place, 100 * m + 10 * p + place, float(place), y=0.5) for m, p, n in ((1, 1, 3), (1, 2, 1), (2, 1, 2)) for place in range(n, 0, -1)]
    found = D.padded(D.sequences(encoder.encode(spark.createDataFrame(rows, SCHEMA).repartition(4)), ["match_id", "possession_id"], "place", "id", "y"), ["match_id", "possession_id"], 2)
    got = {(r.match_id, r.possession_id): r for r in found.collect()}
    assert [(got[k].batch, got[k].length, got[k].width, got[k].mask) for k in ((1, 1), (1, 2), (2, 1))] == [(0, 3, 3, [True] * 3), (0, 1, 3, [True, False, False]), (1, 2, 2, [True, True])]
    assert [s.id for s in got[1, 1].steps] == [111, 112, 113] and [(s.id, s.continuous, s.categorical, s.target) for s in got[1, 2].steps[1:]] == [(None, [0.0], [0], 0.0)] * 2
    assert sum(r.length for r in got.values()) == len(rows)


@pytest.mark.parametrize(
    ("rows", "fault"),
    [([state(1, 1, 1, 1), state(1, 1, 1, 2)], "share a place"), ([state(1, 1, 1, 1), state(1, 1, 2, 1)], "unique"), ([state(1, 1, 1, None)], "unique"), ([state(1, 1, 1, 1, y=-0.1)], "negative"), ([state(1, 1, 1, 1, y=None)], "finite"), ([state(1, 1, 1, 1, y=math.nan)], "finite")],
)
def test_faulty_states_raise(spark, encoder, rows, fault):
    with pytest.raises(Exception, match=fault):
        D.sequences(encoder.encode(spark.createDataFrame(rows, SCHEMA)), ["match_id", "possession_id"], "place", "id", "y").collect()


# Matching by position ----------------------------------------------------------------------------------------------------

PASSES = [(1, 0, 7, 10.0), (1, 1, 7, 20.0), (1, 2, 8, None), (2, 0, 7, 5.0)]
COLUMNS = "match_id long, ordinal long, player_id long, x double"


def pair(spark, right):
    return spark.createDataFrame(PASSES, COLUMNS), spark.createDataFrame(right, COLUMNS)


def test_sources_that_agree(spark):
    right = [(m, o, p, None if x is None else x * (1 + 9e-6)) for m, o, p, x in reversed(PASSES)]
    found = A.aligned(*pair(spark, right), ["match_id", "ordinal"], ["player_id"], ["x"])
    assert found.count() == 4 and found.columns == ["match_id", "ordinal", "left_player_id", "left_x", "right_player_id", "right_x"]


@pytest.mark.parametrize(
    ("right", "fault"),
    [
        ([PASSES[0], (1, 1, 8, 20.0), (1, 2, 7, None), PASSES[3]], "player_id': 2"),  # a swapped pair
        (PASSES[:3], "only on the left': 1"),
        ([*PASSES, (2, 1, 7, 1.0)], "only on the right': 1"),
        ([(1, 0, 7, 10.001), *PASSES[1:]], "x': 1"),
        ([(1, 0, 7, None), *PASSES[1:]], "x': 1"),
        ([*PASSES[:2], (1, 2, 8, 0.0), PASSES[3]], "x': 1"),
        ([*PASSES, PASSES[0]], "right side repeat"),
    ],
)
def test_sources_that_do_not_agree(spark, right, fault):
    with pytest.raises(ValueError, match=fault):
        A.aligned(*pair(spark, right), ["match_id", "ordinal"], ["player_id"], ["x"])


def test_positions(spark):
    rows = spark.createDataFrame([(1, 5), (1, 3), (2, 9), (1, 4)], "m long, at long").repartition(3)
    both = A.with_global_ordinal(A.with_group_ordinal(rows, "m", ["at"], "inside"), ["m", "at"], "overall")
    assert {(r.m, r.at): (r.inside, r.overall) for r in both.collect()} == {(1, 3): (0, 0), (1, 4): (1, 1), (1, 5): (2, 2), (2, 9): (0, 3)}
    assert spark.range(1).select(A.close(F.lit(float("nan")), F.lit(None)).alias("a"), A.close(F.lit(float("inf")), F.lit(float("inf"))).alias("b")).first() == (True, True)
