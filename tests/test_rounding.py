import __spark_entry__ as entry
from touchline.plans import teams


def test_page_is_ordered_by_the_values_shown(spark, tmp_path):
    """0.08 - 0.06 and 0.02 - 0.0 differ as doubles only; the key decides."""
    import shutil

    for name in ("supplier", "nation", "part"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path)
    line = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_suppkey = 3").limit(1)
    cases = spark.createDataFrame([(50 * 121, 0.08, 0.06), (121, 0.02, 0.0)], "k long, t double, d double")
    other = [c for c in line.columns if c not in ("l_orderkey", "l_tax", "l_discount", "l_linenumber", "l_partkey")]
    rows = line.select(*other).crossJoin(cases).selectExpr(*other, "k as l_orderkey", "t as l_tax", "d as l_discount", "4 as l_linenumber", "0L as l_partkey").select(*line.columns)
    rows.withColumn("l_linenumber", rows.l_linenumber.cast("int")).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = [(r.order_key, r.attacking_value) for r in entry.queries()["player_actions_page"](spark, str(tmp_path)).collect()]
    assert got == [(121, 0.02), (6050, 0.02)]


def test_role_distance_is_rounded_once():
    assert not teams._FIT_D.startswith("round")
