"""Registered model queries: rows and schema are stable, the numbers are MLlib's, so they have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import models as L
from touchline.operators import selection as X
from touchline.plans.base import query
from touchline.plans.profiles import features
from touchline.plans.vectors import style_vectors

_NUMBERS = ["pass_length", "forward_distance", "start_goal_distance"]


def _oof(spark, sf_dir, kind):
    f = features(spark, sf_dir)
    ids = ["match_id", "order_key", "player_id", "match_number"]
    return L.out_of_fold(f, X.folds(f, "match_id", 3), "match_id", ids, "completed", _NUMBERS, ["start_zone"], kind)


@query("logistic_oof")
def logistic_oof(spark, sf_dir):
    return _oof(spark, sf_dir, "logistic")


@query("gbt_oof")
def gbt_oof(spark, sf_dir):
    return _oof(spark, sf_dir, "gbt")


@query("kmeans_assign")
def kmeans_assign(spark, sf_dir):
    return L.kmeans(style_vectors(spark, sf_dir), "player_id", "v")


@query("gmm_assign")
def gmm_assign(spark, sf_dir):
    return L.gaussian_mixture(style_vectors(spark, sf_dir), "player_id", "v")


@query("pca_scores")
def pca_scores(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return L.principal_components(e, "vec_id", "v")
