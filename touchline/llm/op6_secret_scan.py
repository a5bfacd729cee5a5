r"""Secret scans by a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: an AND of clauses, each an OR of
strings, each an AND of the string's trigrams (lower case). The index holds a posting (trigram, doc_id) for
every document and every trigram that some rule asks for. Joining postings with the query and counting
intersects them; a rule's candidates are then verified with the expression itself. A rule without a mandatory
trigram scans every text.

Spans are code points, end exclusive, leftmost and non-overlapping per rule; a match whose ``group`` is
shorter than ``least`` is dropped after matching.

Edge cases: a null text is empty and has no span; null and repeated ids are kept, each row is judged on its own
text; other columns pass through; an empty table gives an empty one; spans of equal start are ordered as the
rules are listed.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import documents

try:
    from re import _constants as sre
    from re import _parser as sre_parser
except ImportError:  # older Python
    import sre_constants as sre
    import sre_parse as sre_parser


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # a run of 24 or more is matched whole, shorter runs would be dropped
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES
MOST_STRINGS = 16
"""A clause of more strings is cut; that only makes the query weaker."""


def trigram_query(pattern: str) -> list[list[set[str]]]:
    """AND of clauses, each an OR of AND-ed trigram sets; an empty list if no trigram is mandatory."""
    clauses: list[list[set[str]]] = []

    def close(strings: set[str]) -> None:
        if strings and min(map(len, strings)) >= 3:
            clauses.append([{s[i : i + 3] for i in range(len(s) - 2)} for s in sorted(strings)])

    def options(node) -> set[str] | None:
        """All strings that a node can match, or None if too many."""
        op, arg = node
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN:
            found: set[str] = set()
            for kind, x in arg:
                if kind is sre.LITERAL:
                    found.add(chr(x).lower())
                elif kind is sre.RANGE and x[1] - x[0] < MOST_STRINGS:
                    found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
            return found if len(found) <= MOST_STRINGS else None
        if op is sre.SUBPATTERN:
            return sequence(arg[-1])
        if op is sre.BRANCH:
            parts = [sequence(x) for x in arg[1]]
            return set().union(*parts) if all(p is not None for p in parts) and sum(map(len, parts)) <= MOST_STRINGS else None
        if op is sre.MAX_REPEAT:
            low, high, inner = arg
            one = sequence(inner)
            if one is None or high is sre.MAXREPEAT or high > 4:
                return None
            return {"".join(x) for n in range(low, high + 1) for x in itertools.product(one, repeat=n)}
        return None

    def sequence(nodes) -> set[str] | None:
        found = {""}
        for node in nodes:
            some = options(node)
            if some is None or len(found) * len(some) > MOST_STRINGS:
                return None
            found = {a + b for a in found for b in some}
        return found

    def walk(nodes) -> None:
        held: set[str] = {""}
        for op, arg in nodes:
            some = options((op, arg))
            if some is not None and len(held) * len(some) <= MOST_STRINGS:
                held = {a + b for a in held for b in some}
                continue
            close(held)
            held = some if some is not None else {""}
            if some is None and op is sre.SUBPATTERN:
                walk(arg[-1])
            elif some is None and op is sre.MAX_REPEAT and arg[0] > 0:
                walk(arg[2])
        close(held)

    walk(sre_parser.parse(pattern))
    return clauses


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id): the index, restricted to the trigrams that rules ask for."""
    held = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("folded"), t))
    return docs.select("doc_id", F.lower("text").alias("folded")).select("doc_id", F.explode(held).alias("trigram")).distinct()


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(doc_id, rules): for each document the rules whose trigram query holds; None if no rule has one."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    rows = [(k, i, j, t, len(alt), len(q)) for k, q in queries.items() for i, clause in enumerate(q) for j, alt in enumerate(clause) for t in sorted(alt)]
    if not rows:
        return None
    wanted = docs.sparkSession.createDataFrame(rows, "kind string, clause int, option int, trigram string, need int, clauses int")
    hits = postings(docs, sorted({r[3] for r in rows})).join(F.broadcast(wanted), "trigram")  # as many rows as the rules have trigrams
    met = hits.groupBy("doc_id", "kind", "clause", "option").agg(F.count("*").alias("n"), F.first("need").alias("need"), F.first("clauses").alias("clauses")).where("n = need")
    whole = met.groupBy("doc_id", "kind").agg(F.countDistinct("clause").alias("n"), F.first("clauses").alias("clauses")).where("n = clauses")
    return whole.groupBy("doc_id").agg(F.collect_set("kind").alias("_kinds"))


SPAN = "array<struct<start:int,place:int,end:int,kind:string,value:string>>"


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """Spans of one rule: the gaps between matches and the matches themselves add up to the offsets."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["g"])
        end = begin + F.length(x["m"])
        span = F.struct(begin.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind"), x["m"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    spans = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    if rule.least:
        spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["value"], rule.pattern, rule.group)) >= rule.least)
    return F.when(F.rlike(text, pattern), spans).otherwise(F.array().cast(SPAN))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of ``docs`` with ``secrets``: spans of all rules by start, then as the rules are listed."""
    docs = docs.drop("secrets", "_kinds")
    chosen = candidates(docs, rules)
    if chosen is None:
        joined = docs.withColumn("_kinds", F.array().cast("array<string>"))
    else:
        chosen = chosen.withColumnRenamed("doc_id", "_id")
        joined = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    text = F.coalesce(F.col("text"), F.lit(""))
    empty = F.array().cast(SPAN)
    parts = []
    for place, rule in enumerate(rules):
        spans = spans_of(text, rule, place)
        if trigram_query(rule.pattern):
            spans = F.when(F.array_contains(F.col("_kinds"), rule.kind), spans).otherwise(empty)
        parts.append(spans)
    return joined.withColumn("secrets", F.array_sort(F.concat(*parts))).drop("_kinds")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``text`` with each span of ``secrets`` replaced; overlapping spans count as one. The marks hold no secret themselves."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    clean = F.aggregate("secrets", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return docs.withColumn("text", F.when(F.size("secrets") > 0, clean).otherwise(F.col("text")))


def digest(found: DataFrame) -> DataFrame:
    base = [r.kind for r in BASE_RULES]

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(listed(F.filter("secrets", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_secrets(documents(spark, sf_dir).select("doc_id", "text")))


def _sql() -> str:
    quoted = lambda r: r.pattern.replace("'", "''")
    each = []
    for place, r in enumerate(RULES):
        p = quoted(r)
        each.append(
            f"SELECT doc_id, {place} AS place, '{r.kind}' AS kind, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::BIGINT AS start, m[i] AS value"
            f" FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d))"
            + (f" WHERE length(regexp_extract(m[i], '{p}', {r.group})) >= {r.least}" if r.least else "")
        )
    line = "kind || ':' || start || ':' || (start + length(value))"
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (" + " UNION ALL ".join(each) + ") "
        "SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, "
        f"sha256(coalesce(string_agg({line}, ',' ORDER BY start, place) FILTER (place < {len(BASE_RULES)}), '')) AS base_sha256, coalesce(string_agg({line}, ',' ORDER BY start, place), '') AS spans "
        "FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"
    )


QUERIES = {"op6_secret_scan": op6}
SQL = {"op6_secret_scan": _sql()}
