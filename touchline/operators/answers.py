"""Answers in Markdown as claims: units, rules with findings, sections, and the scoring of cases against expectations.

Texts are exploded to lines; windows run inside one answer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import markdown as M
from touchline.functions.text import citation_ids, without_controls


def numbered_lines(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, raw, line): the lines of each text, from 1, as they are and trimmed. A null text has none."""
    each = answers.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("i", "raw"))
    return each.select(key, (F.col("i") + 1).alias("at"), "raw", M.trimmed(F.col("raw")).alias("line"))


def claim_units(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unit, text, first_line, last_line, current): paragraphs and list items, wrapped lines joined, headings left out.

    ``current`` tells that the last heading before announces the world outside of the data. Blank lines, headings and list marks begin a new unit.
    """
    w = Window.partitionBy(key).orderBy("at")
    lines = numbered_lines(answers, key, text).withColumns({"before": F.lag("line").over(w), "after": F.lead("line").over(w)})
    line, rule = F.col("line"), lambda c: F.coalesce(M.rlike(F.col(c), M.UNDERLINE), F.lit(False))
    blank = line == ""
    # an underline belongs to the text before it; one that follows an underline is a heading of its own
    taken = rule("line") & ~F.coalesce(F.col("before") == "", F.lit(True)) & ~rule("before")
    heading = M.only_if(~blank & ~taken, F.when(rule("after"), True).otherwise(M.only_if(~rule("line"), M.is_heading(line, F.col("before"), F.col("after")))))
    kinds = lines.withColumn("heading", heading).withColumn("plain", ~blank & ~F.col("heading") & ~rule("line"))
    starts = blank | F.col("heading") | (F.col("plain") & M.rlike(line, r"^[-*+] "))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("heading"), M.outside_world(M.heading_text(line))), ignorenulls=True).over(upto)
    placed = kinds.withColumns({"island": F.sum(starts.cast("int")).over(upto), "current": F.coalesce(section, F.lit(False))}).where("plain")
    units = placed.groupBy(key, "island").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), " ").alias("text"), F.min("at").alias("first_line"), F.max("at").alias("last_line"), F.min_by("current", "at").alias("current"))
    order = Window.partitionBy(key).orderBy("first_line")
    return units.select(key, F.row_number().over(order).alias("unit"), "text", "first_line", "last_line", "current")


@dataclass(frozen=True)
class Rule:
    """A claim that matches ``pattern`` needs a citation of ``category`` beside it. ``section_only``: counts only in sections on the outside world."""

    code: str
    pattern: str
    category: str
    section_only: bool = False


def findings(units: DataFrame, key: str, evidence: DataFrame, rules: list[Rule]) -> DataFrame:
    """(key, unit, code, first_line, last_line, text, cited): claims that a rule asks evidence for and that don't cite any of its category.

    ``evidence``: (key, evidence_id, category). An answer's evidence meets its units as one row, so the units are worked out once, whatever the number of rules.
    """
    kept = evidence.where(F.col("evidence_id").isNotNull()).groupBy(key, "evidence_id").agg(F.collect_set("category").alias("categories"))
    held = kept.groupBy(key).agg(F.collect_list(F.struct("evidence_id", "categories")).alias("held"))  # one answer's evidence
    text = F.col("text")
    ids = F.when(F.contains(text, F.lit("[")), F.array_distinct(citation_ids(text))).otherwise(F.array().cast("array<string>"))
    joined = units.withColumn("ids", ids).join(held, key, "left")
    found = F.when(F.size("ids") > 0, F.filter("held", lambda e: F.array_contains("ids", e["evidence_id"])))
    joined = joined.withColumn("found", F.coalesce(found, F.array().cast(held.schema["held"].dataType)))
    joined = joined.withColumns({"categories": F.flatten(F.transform("found", lambda e: e["categories"])), "cited": F.array_sort(F.transform("found", lambda e: e["evidence_id"]))})
    asked = lambda r: ~F.array_contains("categories", r.category) & (F.col("current") if r.section_only else F.lit(True))
    broken = [F.when(M.only_if(asked(r), M.rlike(text, r.pattern)), r.code) for r in rules]
    return joined.select(key, "unit", F.explode(F.array_compact(F.array(*broken))).alias("code"), "first_line", "last_line", "text", "cited")


def pattern_matches(answers: DataFrame, key: str, text: str, patterns: dict[str, str], around: int = 30) -> DataFrame:
    """(key, code, start, match, line_number, context): every match of every pattern, with its offset, line and surroundings. Control characters are dropped first."""
    clean = answers.select(key, without_controls(F.col(text)).alias("t"))
    each = clean.withColumn("p", F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.regexp_replace("t", f"({p})", "\x01$1\x02").alias("m")) for c, p in patterns.items()])))
    parts = each.select(key, "t", "p.code", F.posexplode(F.split("p.m", "\x01", -1)).alias("i", "part"))
    w = Window.partitionBy(key, "code").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    bare = F.length(F.regexp_replace("part", "\x02", ""))
    placed = parts.withColumn("start", F.coalesce(F.sum(bare).over(w), F.lit(0)).cast("int")).where("i > 0")
    match = F.substring_index("part", "\x02", 1)
    line = F.length(F.substring(F.col("t"), F.lit(1), F.col("start"))) - F.length(F.replace(F.substring(F.col("t"), F.lit(1), F.col("start")), F.lit("\n"), F.lit(""))) + 1
    first = F.greatest(F.col("start") - around, F.lit(0))
    context = F.substring(F.col("t"), first + 1, F.col("start") - first + F.length(match) + around)
    return placed.select(key, "code", "start", match.alias("match"), line.alias("line_number"), context.alias("context"))


def without_known_section(answers: DataFrame, key: str, text: str, title: str, known: DataFrame) -> DataFrame:
    """(key, text): sections headed ``title`` go if they have lines and all of them, without list marks, are among the answer's ``known`` (key, item) ones."""
    plain = lambda c: F.lower(F.regexp_replace(M.trimmed(c), r"\s+", " "))
    w = Window.partitionBy(key).orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    raw = F.col("raw")
    lines = numbered_lines(answers, key, text).withColumn("head", M.rlike(raw, r"^\s*#{1,6}\s+")).withColumn("section", F.sum(F.col("head").cast("int")).over(upto))
    body = plain(F.regexp_replace(raw, r"^\s*(?:[-*+]\s+|[0-9]+[.)]\s+)", ""))
    lines = lines.withColumns({"titled": M.rlike(raw, rf"^(?i)\s*#{{1,6}}\s+{title}\s*#*\s*$"), "item": F.when(~F.col("head") & (F.col("line") != ""), body)})
    inside = lines.join(known.select(key, plain(F.col("item")).alias("item"), F.lit(True).alias("is_known")).distinct(), [key, "item"], "left")
    judged = inside.groupBy(key, "section").agg(F.max("titled").alias("titled"), F.count("item").alias("n"), F.count(F.when(F.col("item").isNotNull() & F.col("is_known"), 1)).alias("of_them"))
    gone = judged.where("titled and n > 0 and n = of_them").select(key, "section", F.lit(True).alias("gone"))
    marked = lines.join(gone, [key, "section"], "left")
    # blank lines before a section that goes, go as well
    later = w.rowsBetween(1, Window.unboundedFollowing)
    follows = F.first(F.when(F.coalesce("gone", F.lit(False)), "gone").when(F.col("line") != "", "stays"), ignorenulls=True).over(later)
    kept = marked.withColumn("follows", follows).where(~F.coalesce("gone", F.lit(False)) & ~((F.col("line") == "") & F.coalesce(F.col("follows") == "gone", F.lit(False))))
    joined = kept.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "raw"))), lambda x: x["raw"]), "\n").alias("t"))
    return answers.select(key).join(joined, key, "left").select(key, M.trimmed(F.coalesce("t", F.lit(""))).alias("text"))


# Cases -----------------------------------------------------------------------------------------------------------------


def case_scores(cases: DataFrame, key: str) -> DataFrame:
    """What each case did against what it should have done; a check without an expectation is null and can't fail.

    Columns: status, statuses (allowed); called, required, optional, forbidden (arrays of names); arguments, expected (maps of
    texts); categories, needed (arrays). A case passes if no check is false; ``failures`` names those that are.
    """
    missing = F.array_except("required", "called")
    unexpected = F.array_except("called", F.array_union("required", "optional"))
    wrong = F.map_keys(F.map_filter("expected", lambda k, v: ~v.eqNullSafe(F.try_element_at("arguments", k))))
    asked = lambda c: F.size(c) > 0
    scored = cases.select(
        key, F.array_sort(missing).alias("missing"), F.array_sort(unexpected).alias("unexpected"), F.array_sort(wrong).alias("wrong_arguments"),
        F.when(asked("required"), 1 - F.size(missing) / F.size("required")).alias("recall"),
        F.when(asked("statuses"), F.array_contains("statuses", F.col("status"))).alias("status_correct"),
        F.when(asked("required") | asked("forbidden"), (F.size(missing) == 0) & ~F.arrays_overlap("called", "forbidden")).alias("tools_correct"),
        F.when(asked("expected"), F.size(wrong) == 0).alias("arguments_correct"),
        F.when(asked("needed"), F.size(F.array_except("needed", "categories")) == 0).alias("evidence_correct"),
    )
    checks = ["status_correct", "tools_correct", "arguments_correct", "evidence_correct"]
    failed = F.array_compact(F.array(*[F.when(~F.col(c), c.removesuffix("_correct")) for c in checks]))
    return scored.withColumn("failures", failed).withColumn("passed", F.size("failures") == 0)

