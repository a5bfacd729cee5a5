"""The corpus pipeline over documents: language, near-duplicates, benchmark leaks, secrets, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns of documents.
Rows are told apart by their id and a hash of their text, so null and repeated ids are handled row by row. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import crc_fold, stored
from touchline.llm.op2_hyperminhash import near_duplicates
from touchline.llm.op6_secret_scan import redacted, scan_secrets
from touchline.llm.op7_decontamination import leaks
from touchline.llm.op8_byte_bpe import Codec, read_ranks
from touchline.llm.op9_language_id import identify, prototypes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARE_OF_USUAL = 0.5
"""A text goes if its score is less than this share of the usual one: that which 99 of 100 labelled texts of its length reach with their own language."""
LEAST_LABELLED = 50
"""Length bands with fewer labelled texts take the usual score of the next shorter band that has them; the shortest ones reject nothing."""


def _usual_scores(judged: DataFrame) -> DataFrame:
    """(band, usual) for each length band, a power of two of letters; a row for each band that texts can have."""
    right = judged.where((F.col("lang") == F.col("lang_pred")) & F.col("band").isNotNull())
    per = right.groupBy("band").agg(F.count("*").alias("n"), F.percentile_approx("score", 0.01, 1000).alias("usual")).where(F.col("n") >= LEAST_LABELLED).collect()
    known, rows, last = {r.band: r.usual for r in per}, [], 0.0
    for band in range(40):
        last = known.get(band, last)
        rows.append((band, float(last)))
    return judged.sparkSession.createDataFrame(rows, "band int, usual double")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and those unlike every learned language, go; a missing lang, and one that the text contradicts with a usual score, becomes the predicted one.

    The score grows with a text's length, so it is held against that of labelled texts of like length. Where no text is labelled, nothing can be learned: all texts with a letter stay as they are.
    """
    profiles = prototypes(docs.where(F.coalesce(crc_fold("doc_id", 5) != 0, F.lit(True))))
    if not profiles:
        return docs.where(F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False))).select(*COLUMNS)
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    judged = stored(identify(docs.select(*COLUMNS), profiles).withColumn("band", F.when(letters > 0, F.floor(F.log2(letters)).cast("int"))), "judged-languages")
    rated = judged.where("lang_pred <> 'und'").join(F.broadcast(_usual_scores(judged)), "band")  # 40 rows
    kept = rated.where(F.col("score") >= SHARE_OF_USUAL * F.col("usual"))
    lang = F.when(F.col("lang").isNull() | (F.col("score") >= F.col("usual")), F.col("lang_pred")).otherwise(F.col("lang"))
    return kept.withColumn("lang", lang).select(*COLUMNS)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose id and text hash are in ``gone``."""
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.join(gone, same, "left_anti").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, similarity 0.8): that of smallest id, null ids last. Texts without words stay.

    Rows are compared by a key of id and text, after rows equal in both have become one; so rows with a null or repeated id take part.
    """
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("key"))
    repeated = stored(rows.where(worded).groupBy("key").count().where("count > 1").select("key"), "repeated-rows")
    if repeated.limit(1).count():
        one = rows.join(repeated, "key", "left_semi").groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("m")).select("m.*", "key")
        rows = stored(rows.join(repeated, "key", "left_anti").select(*COLUMNS, "key").unionByName(one), "distinct-rows")
    groups = near_duplicates(rows.select(F.col("key").alias("doc_id"), "text"), distinct_ids=True).where("n_shingles > 0").select(F.col("doc_id").alias("key"), "component_id")
    judged = stored(groups.join(rows.where(worded).select("key", "doc_id"), "key"), "judged-rows")
    first = judged.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m")).select("m.key")
    return rows.join(judged.join(first, "key", "left_anti").select("key"), "key", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    return _without(docs, leaks(hashed, benchmark, keys=("doc_id", "text_hash")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; no document goes."""
    found = redacted(scan_secrets(docs.select(*COLUMNS)))
    return found.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text."""
    codec = Codec(spark, read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    coded = codec.decode(codec.encode(docs.select("doc_id", "text")))
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("tokens", tokens)]

ORACLE_SQL = None  # trigram profiles and alignments can't be said in SQL; tests/llm compares the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
