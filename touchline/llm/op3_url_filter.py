r"""URL filters: gradient-boosted trees on lexical features, with DataFrame functions and MLlib only.

Rules (host suffix, path prefix) judge the urls they fit; the longest rule wins. The trees are trained on urls labelled
by the rules (block 1, allow 0) and judge the rest. Features: lengths, path depth, digit ratio, entropy of the host's characters,
counts of parameters, hyphens, labels and digits, and, for hash buckets of the host's last label, its last two labels and the path's first part,
how often they occur among all urls and how often they are blocked among the labelled ones (additively smoothed).

Training takes at most ``FIT_ROWS`` labelled urls, those with the smallest hashes of url and id; counts cover all rows. Where a
class is missing, there is nothing to learn: every url without a rule is allowed.

Edge cases: a null url, or one without ``://``, has an empty host and path and no rule; it gets the trees' verdict for these features.
Ties of probability (0.5) are allowed; ids may be null or repeat, each row is judged by its own url; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import stored

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
FIT_ROWS = 20_000
"""Bound of the training sample."""
BUCKETS = 512
"""Hash buckets of the suffix statistics."""
TREES, DEPTH = 15, 4

LEXICAL = ["url_length", "host_length", "path_length", "depth", "digit_ratio", "host_entropy", "parameters", "hyphens", "labels", "digits"]
SUFFIXES = ["last_label", "last_two", "first_part"]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    folded = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.when(at > 0, folded), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, null if none: its host or a subdomain of it, and a path that starts with its path."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def with_features(pages: DataFrame) -> DataFrame:
    """Lexical features and suffix buckets; expects ``url``, ``host`` and ``path``."""
    url, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    letters = F.filter(F.split(host, ""), lambda c: c != "")
    n = F.length(host)
    entropy = F.aggregate(
        F.array_distinct(letters),
        F.lit(0.0),
        lambda acc, c: acc - (n - F.length(F.replace(host, c, F.lit("")))) / n * F.log2((n - F.length(F.replace(host, c, F.lit("")))) / n),
    )
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    labels = F.split(host, r"\.")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    bucket = lambda name, value: F.pmod(F.xxhash64(F.lit(name), value), F.lit(BUCKETS)).cast("int").alias(name)
    return pages.select(
        "*",
        F.length(url).cast("double").alias("url_length"),
        n.cast("double").alias("host_length"),
        F.length(path).cast("double").alias("path_length"),
        F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double").alias("depth"),
        F.when(F.length(url) > 0, digits / F.length(url)).otherwise(0.0).alias("digit_ratio"),
        F.when(n > 0, entropy).otherwise(0.0).alias("host_entropy"),
        F.when(query != "", F.size(F.split(query, "&"))).otherwise(0).cast("double").alias("parameters"),
        F.length(F.regexp_replace(host, "[^-]", "")).cast("double").alias("hyphens"),
        F.size(labels).cast("double").alias("labels"),
        digits.cast("double").alias("digits"),
        bucket("last_label", F.substring_index(host, ".", -1)),
        bucket("last_two", F.substring_index(host, ".", -2)),
        bucket("first_part", F.substring_index(F.substring_index(path, "/", 2), "/", -1)),
    )


def with_statistics(rows: DataFrame, labelled: Column, blocked: Column) -> DataFrame:
    """For each suffix bucket its share of all rows and its smoothed rate of blocked rows; ``BUCKETS`` rows per suffix are broadcast."""
    total = F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1))  # over the buckets, not the rows
    for name in SUFFIXES:
        per = rows.groupBy(name).agg(
            F.count("*").alias("n"),
            F.sum(F.when(labelled, 1).otherwise(0)).alias("seen"),
            F.sum(F.when(labelled & blocked, 1).otherwise(0)).alias("bad"),
        )
        per = per.select(F.col(name).alias("_b"), (F.col("n") / total).alias(f"{name}_share"), ((F.col("bad") + 1) / (F.col("seen") + 2)).alias(f"{name}_rate"))
        rows = rows.join(F.broadcast(per), F.col(name) == F.col("_b"), "left").drop("_b")
    return rows


def url_filter(pages: DataFrame, rules=RULES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, and the trees' probability of ``block``."""
    verdict_of = F.lit(None).cast("string")
    for rule, verdict in rules:
        verdict_of = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(verdict_of)
    parts = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    parts = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("_ruled", verdict_of)
    labelled, blocked = F.col("_ruled").isNotNull(), F.coalesce(F.col("_ruled") == "block", F.lit(False))
    columns = LEXICAL + [f"{s}_{k}" for s in SUFFIXES for k in ("share", "rate")]
    rows = stored(with_statistics(with_features(parts), labelled, blocked).select("page_id", "host", "path", "rule", "_ruled", "url", *columns), "url-features")
    vectors = VectorAssembler(inputCols=columns, outputCol="_features").transform(rows)
    fit = (
        vectors.where(labelled)
        .select(blocked.cast("double").alias("label"), "_features", F.xxhash64("url", "page_id").alias("_h"))
        .orderBy("_h")
        .limit(fit_rows)
        .select("label", "_features")
    )
    sample = stored(fit, "url-sample")
    if sample.select("label").distinct().count() < 2:
        judged = rows.withColumn("p_block", F.lit(0.0))
    else:
        model = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7).fit(sample)
        judged = model.transform(vectors).withColumn("p_block", vector_to_array("probability")[1])
    verdict = F.coalesce(F.col("_ruled"), F.when(F.col("p_block") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "p_block")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op3_url_filter": op3}
