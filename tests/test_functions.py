from pyspark.sql import functions as F

from touchline.functions import pitch
from touchline.functions import text as T


def one(spark, schema, values, *columns):
    return spark.createDataFrame([values], schema).select(*columns).first()


def test_progressive_and_zone(spark):
    row = one(
        spark, "a double, b double, c double, d double", (60.0, 40.0, 80.0, 40.0), pitch.is_progressive(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("p"), pitch.zone(F.col("a"), F.col("b")).alias("z"), pitch.enters_final_third(F.lit(79.0), F.col("c")).alias("e"), pitch.zone(F.lit(130.0), F.col("b")).alias("out"), pitch.is_progressive(F.lit(None).cast("double"), F.col("b"), F.col("c"), F.col("d")).alias("n")
    )
    assert (row.p, row.z, row.e, row.out, row.n) == (True, "middle_centre", True, "Unknown", False)


def test_angle_grows_near_goal(spark):
    row = one(spark, "x double, y double", (114.0, 40.0), pitch.angle_to_goal(F.col("x"), F.col("y")).alias("near"), pitch.angle_to_goal(F.lit(90.0), F.col("y")).alias("far"))
    assert row.near > row.far > 0


def test_text_functions(spark):
    row = one(
        spark, "s string", ("x",), T.category(F.lit("  "), "Unknown").alias("c"), T.clock_seconds(F.lit("01:02:03.500")).alias("k"), T.clock_seconds(F.lit("02:03")).alias("k2"), T.season(F.lit("2023-24")).alias("y"), T.name_key(F.lit("  O'Neil,  Jr. ")).alias("n"),
        T.citation_ids(F.lit("a [Evidence-1; evidence2] b [evidence3; z] [evidence2] [evidence 4]")).alias("i"), T.without_controls(F.lit("a\x01b\nc")).alias("w"), T.ordinal(F.lit(111)).alias("o"), T.percent_label(F.lit(0.125)).alias("p"), T.similarity_index(F.lit(2.0), F.lit(2.0)).alias("h"),
    )
    assert (row.c, row.k, row.k2, row.y, row.n, row.i, row.w, row.o, row.p) == ("Unknown", 3723.5, None, "2023/2024", "oneil jr", ["Evidence-1", "evidence2", "evidence2"], "ab\nc", "111th", "12.5%")
    assert abs(row.h - 50) < 1e-9


def test_names_and_sources(spark):
    rows = spark.createDataFrame([("O’Neil ﬁne ʼx",), ("Straße`b",), ("A.B-c 1",), (None,)], "s string").select(T.name_key(F.col("s")).alias("k")).collect()
    assert [r.k for r in rows] == ["oneil fine x", "strasse b", "a b c 1", None]
    hosts = spark.createDataFrame([("www.uefa.com",), ("en.UEFA.com",), ("notuefa.com",), ("sport.bbc.com",), ("",)], "h string").select(T.source_quality(F.col("h")).alias("q")).collect()
    assert [r.q for r in hosts] == ["official", "official", "other", "reputable_media", "other"]
