import pytest
from pyspark.sql import functions as F

from touchline.operators import contracts as C
from touchline.operators import metrics as M
from touchline.operators import models as L
from touchline.operators import profiles as P
from touchline.operators import selection as X
from touchline.operators import sequences as S
from touchline.operators import similarity as V


def test_dominant_breaks_ties_by_text(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (2, None), (2, "z")], "k int, v string")
    assert {r.k: r.dominant_v for r in P.dominant(rows, "k", "v").collect()} == {1: "a", 2: ""}


def test_percentile_averages_ties(spark):
    rows = spark.createDataFrame([(i, "g", float(v)) for i, v in enumerate([1, 2, 2, 3, 4, 5, 6, 7, 8, 9])], "id int, g string, v double")
    got = {r.id: r.p for r in rows.withColumn("p", S.percentile("v", ["g"])).collect()}
    assert got[0] == 0 and got[9] == 100 and got[1] == got[2] == pytest.approx(100 * 1.5 / 9)
    assert rows.limit(9).withColumn("p", S.percentile("v", ["g"])).where("p is not null").count() == 0


def test_possessions_and_score(spark):
    rows = spark.sql("select * from values (1L, 1L, timestamp_ntz'2020-01-01 00:00:00', 0L, 1), (2L, 1L, timestamp_ntz'2020-01-01 01:00:00', 1L, 0), (3L, 1L, timestamp_ntz'2020-01-02 00:00:00', 0L, 0) as t(event_id, match_id, ts, team_id, is_goal)")
    got = {r.event_id: (r.possession_id, r.score_difference) for r in S.with_score(S.with_possessions(rows)).collect()}
    assert got == {1: (1, 0), 2: (1, -1), 3: (2, 1)}


def test_zero_vector_and_gaps(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>").select(V.cosine_distance(F.col("a"), F.col("b")).alias("c"), V.contributions(F.col("a"), F.col("a")).alias("z"), V.gaps(F.col("a"), F.col("b"), ["x", "y"]).alias("g")).first()
    assert row.c == 1.0 and row.z == [0.0, 0.0] and [g.name for g in row.g] == ["x", "y"]


def test_auc_matches_pairs(spark):
    data = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.3)]
    pairs = [1.0 if a > b else 0.5 if a == b else 0.0 for ya, a in data if ya for yb, b in data if not yb]
    assert M.probability_metrics(spark.createDataFrame(data, "y int, p double"), "y", "p").first().auc == pytest.approx(sum(pairs) / len(pairs))


def test_folds_and_resamples(spark):
    rows = spark.range(34).withColumnRenamed("id", "m")
    assert sorted(r["count"] for r in X.folds(rows, "m").groupBy("fold").count().collect()) == [6, 7, 7, 7, 7]
    assert {r["count"] for r in X.resamples(rows, "m", 3).groupBy("resample").count().collect()} == {27}
    assert {r["count"] for r in X.resamples(rows, "m", 3, round_up=True).groupBy("resample").count().collect()} == {28}


def test_page_refuses_bad_input(spark):
    with pytest.raises(ValueError):
        X.page(spark.range(3), "id", "id", 0)
    with pytest.raises(ValueError):
        X.page(spark.range(3), "id", "id", 5, allowed=("name",))
    with pytest.raises(ValueError):
        X.in_order(spark.range(3), "id", [1, 1])


def test_contracts(spark):
    good = spark.createDataFrame([(1, 0.5), (2, 0.7)], "id int, p double")
    bad = spark.createDataFrame([(1, 1.5), (1, None)], "id int, p double")
    assert C.require_range(C.require_unique(C.require_columns(good, ["id", "p"]), ["id"]), "p", 0, 1) is good
    for broken in (lambda: C.require_columns(good, ["x"]), lambda: C.forbid_columns(good, ["p"]), lambda: C.require_unique(bad, ["id"]), lambda: C.require_range(bad, "p", 0, 1), lambda: C.require_domain(good, "id", [1]), lambda: C.require_parents(good, "id", good.where("id = 1").withColumnRenamed("id", "pid"), "pid"), lambda: C.require_disjoint(good, good, "id")):
        with pytest.raises(C.ContractError):
            broken()
    ranked = spark.createDataFrame([(1, 2, 1, 0.1), (1, 3, 2, 0.2)], "k int, o int, r int, d double")
    assert C.require_ranks(ranked, "k", "o", "r", "d") is ranked
    with pytest.raises(C.ContractError):
        C.require_ranks(ranked.withColumn("d", -F.col("d")), "k", "o", "r", "d")


def test_kmeans_finds_two_groups(spark):
    rows = spark.createDataFrame([(i, [float(i % 2) * 10, float(i) / 100]) for i in range(20)], "id int, v array<double>")
    got = {r.id: r.cluster for r in L.kmeans(rows, "id", "v").collect()}
    assert all(got[i] == i % 2 for i in range(20))


def test_every_player_has_ranked_similar_players(spark):
    from tests.conftest import SF_DIR
    from touchline.plans import registry, vectors

    players = {r.player_id: r.position_group for r in vectors.style_vectors(spark, SF_DIR).select("player_id", "position_group").collect()}
    found = {}
    for r in sorted(registry.queries()["similar_players_ranked"](spark, SF_DIR).collect(), key=lambda r: (r.left_id, r.rank)):
        assert r.left_id != r.right_id and players[r.left_id] == players[r.right_id]
        found.setdefault(r.left_id, []).append(r)
    groups = list(players.values())
    assert {p: min(10, groups.count(g) - 1) for p, g in players.items() if groups.count(g) > 1} == {p: len(rows) for p, rows in found.items()}
    for rows in found.values():
        assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
        assert [r.similarity for r in rows] == sorted((r.similarity for r in rows), reverse=True)


def test_close_tables_have_equal_keys_and_nulls(spark):
    from touchline.operators import contracts as C

    table = lambda rows: spark.createDataFrame(rows, "k int, v double")
    C.require_close(table([(1, 2.0), (2, None)]), table([(2, None), (1, 2.0 + 1e-8)]), "k", ["v"])
    for other in ([(1, 2.0)], [(1, 2.0), (2, 1.0)], [(1, 2.1), (2, None)], [(1, 2.0), (2, None), (3, 1.0)]):
        with pytest.raises(C.ContractError):
            C.require_close(table([(1, 2.0), (2, None)]), table(other), "k", ["v"])


def test_optional_filters(spark):
    from touchline.operators import selection as X

    rows = spark.createDataFrame([(1, "a", 5), (1, "b", 9), (2, "a", 5)], "k int, s string, n int")
    assert X.filtered(rows, "k", 1).count() == 2 and X.filtered(rows, "k", 1, {"s": "a"}, {"n": (None, 6)}).count() == 1
    with pytest.raises(ValueError):
        X.filtered(rows, "k", 1, between={"n": (3, 2)})


def test_zscores_of_large_values(spark):
    """Of 20,000 values about 100,000.5 a plain running sum is off in the tenth digit of the score."""
    from fractions import Fraction

    values = [100000 + i * 7919 % 1000 / 1000 for i in range(20000)]
    exact = [Fraction(x) for x in values]
    mean = sum(exact) / len(exact)
    deviation = float(sum((x - mean) ** 2 for x in exact) / len(exact)) ** 0.5
    want = [float(x - mean) / deviation for x in exact]
    rows = spark.createDataFrame([(i, "a", x) for i, x in enumerate(values)], "id long, g string, x double").unionByName(spark.createDataFrame([(-1, "b", 0.1), (-2, "b", 0.1), (-3, "b", 0.1)], "id long, g string, x double"))
    got = {r.id: r.z_x for r in S.zscores(rows, "g", ["x"]).select("id", "z_x").collect()}
    assert [got[i] for i in (-1, -2, -3)] == [None] * 3
    off = max(abs(got[i] - w) for i, w in enumerate(want))
    assert off < 3e-11


def test_unique_pairs_of_blocks(spark):
    """Every pair once, the smaller id first with its own vector."""
    rows = spark.createDataFrame([(i * 37 % 101, "a", [float(i)]) for i in range(90)] + [(500, "b", [1.0])], "id long, g string, v array<double>")
    own = {r.id: r.v for r in rows.collect()}
    found = V.blocked_pairs(rows, "id", ["g"], block=9, unique=True)
    got = [(r.left_id, r.right_id) for r in found.collect()]
    ids = sorted(i for i in own if i != 500)
    assert sorted(got) == [(a, b) for a in ids for b in ids if a < b]
    assert all(r.a == own[r.left_id] and r.b == own[r.right_id] for r in found.collect())
    sent = found._jdf.queryExecution().optimizedPlan().toString()
    assert sent.count("Generate explode") == 2 and sent.count("<= _r") + sent.count(" <= ") >= 2
