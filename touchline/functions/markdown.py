"""Scalar functions on Markdown answers: headings, cited ids, renumbering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.functions.text import citation_ids

# Which headings carry no facts, which announce the present, and which words make a line a statement.
PLAIN_HEADING = r"historical analysis|role fit(?: analysis)?|summary|limitations|methodology|sources|analysis"
PRESENT_HEADING = r"current situation|current status|latest update|current update|current context"
OUTSIDE_HEADING = r"current\s+(?:club|team|manager|coach|squad|lineup)|injury\s+(?:status|update)|availability(?:\s+update)?|transfer\s+(?:status|update|reporting)|(?:latest|recent)\s+news"
PREDICATE = r"\b(?:is|are|was|were|has|have|had|plays?|joined?|sign(?:ed|s)?|manages?|remains?|injured|available|unavailable|sidelined)\b"
UNDERLINE = r"^(?:=+|-+)$"
CITATION_GROUP = r"\[[^\[\]]*evidence-[0-9]+(?:\s*;\s*[^\[\]]*evidence-[0-9]+)*\]"


def rlike(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def only_if(first: Column, then: Column) -> Column:
    """Both hold. The optimizer may work out what an ``&`` repeats for every row; a condition it works out only where the first one holds."""
    return F.when(first, then).otherwise(False)


def words(c: Column) -> Column:
    return F.when(trimmed(c) == "", 0).otherwise(F.size(F.split(trimmed(c), r"\s+")))


def heading_text(line: Column) -> Column:
    """A heading without its marks."""
    bare = F.regexp_replace(trimmed(F.regexp_replace(trimmed(line), "^#+", "")), r"^[*_ ]+|[*_ ]+$", "")
    return trimmed(F.regexp_replace(bare, ":+$", ""))


def of_the_present(text: Column) -> Column:
    """A heading on the present, perhaps with a remark in brackets that states nothing."""
    remark = F.regexp_extract(text, rf"^(?i:{PRESENT_HEADING})\s*\(([^()\n]{{1,80}})\)$", 1)
    return rlike(text, rf"^(?i:{PRESENT_HEADING})$") | ((remark != "") & ~rlike(remark, rf"(?i){PREDICATE}"))


def outside_world(text: Column) -> Column:
    """A heading whose section speaks about the world outside of the data."""
    return of_the_present(text) | rlike(text, rf"^(?i:{OUTSIDE_HEADING})$")


def is_heading(line: Column, before: Column, after: Column) -> Column:
    """Whether a trimmed line is a heading, by its marks, its words, or as a short title between blank lines. ``before`` and ``after`` are null at the ends."""
    text, cited = heading_text(line), F.size(citation_ids(line)) > 0
    named = only_if(rlike(line, rf"^[#*_\s]*+(?i:{PLAIN_HEADING}|{PRESENT_HEADING})"), rlike(text, rf"^(?i:{PLAIN_HEADING})$") | of_the_present(text))
    bold = only_if(rlike(line, r"^(?:\*\*|__).+(?:\*\*|__)$"), ~cited & (words(text) <= 8) & ~rlike(line, r"[.?!][*_ ]*$"))
    alone = (F.coalesce(before, F.lit("")) == "") & (F.coalesce(after, F.lit("")) == "") & rlike(line, r"^\p{Lu}")
    title = only_if(alone, words(line).between(1, 5) & ~F.contains(line, F.lit(":")) & ~rlike(line, r"[.,;?!]$") & ~cited & ~rlike(line, rf"(?i){PREDICATE}"))
    return rlike(line, r"^#{1,6}\s") | named | bold | title


def unescaped_headings(c: Column) -> Column:
    """A backslash before a heading's marks is dropped."""
    return F.regexp_replace(c, r"(?m)^([ \t]{0,3})\\(#{1,6}[ \t]+)", "$1$2")


def cited_in_order(c: Column) -> Column:
    """The distinct evidence ids in the order of their first citation."""
    groups = F.regexp_extract_all(c, F.lit(f"(?i)({CITATION_GROUP})"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, _members)))


def _members(group: Column) -> Column:
    return F.transform(F.split(F.substring(group, F.lit(2), F.length(group) - 2), ";"), trimmed)


def renumbered(c: Column, ids: Column) -> Column:
    """Citation groups become ``[1] [2]``: places in ``ids``; ids that aren't there vanish."""
    pattern = f"(?i){CITATION_GROUP}"
    groups = F.regexp_extract_all(c, F.lit(f"(?i)({CITATION_GROUP})"), F.lit(1))
    numbers = F.transform(groups, lambda g: F.array_join(F.transform(F.filter(F.transform(_members(g), lambda i: F.array_position(ids, i)), lambda n: n > 0), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), " "))
    around = F.split(c, pattern, -1)
    return F.array_join(F.transform(around, lambda part, i: F.concat(part, F.coalesce(F.get(numbers, i), F.lit("")))), "")
