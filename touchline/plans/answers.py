"""Registered queries on Markdown answers (documents with marks put in), rules, sections and cases (conversations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import markdown as M
from touchline.operators import answers as A
from touchline.plans.base import query
from touchline.session import table

# The adapter: marks by line number -----------------------------------------------------------------------------------------

_MARKS = {0: "## Current status", 1: "", 3: "---", 4: "### Current club", 5: "**Summary**", 6: "Recent form", 8: "\\# Limitations", 9: "  "}
_CASES = " ".join(f"when {k} then '{v}'" for k, v in _MARKS.items())
_MD_SQL = (
    "select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: case (doc_id*3 + i - 1) % 16 " + _CASES + " when 2 then '- ' || l when 10 then '* ' || l "
    "when 7 then l || ' [web-evidence-' || ((i - 1) % 3) || '; db-evidence-' || ((i - 1) % 5) || ']' when 11 then l || ' [db-evidence-' || ((i - 1) % 7) || '].' else l end), chr(10)) as md from documents where text is not null"
)


def _answers(spark, sf_dir):
    def marked(line, i):
        k = (F.col("doc_id") * 3 + i) % 16
        cite = lambda name, n: F.concat(F.lit(f"{name}-evidence-"), (i % n).cast("string"))
        out = F.when(k == 2, F.concat(F.lit("- "), line)).when(k == 10, F.concat(F.lit("* "), line))
        out = out.when(k == 7, F.concat(line, F.lit(" ["), cite("web", 3), F.lit("; "), cite("db", 5), F.lit("]"))).when(k == 11, F.concat(line, F.lit(" ["), cite("db", 7), F.lit("].")))
        for at, text in _MARKS.items():
            out = out.when(k == at, text)
        return out.otherwise(line)

    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), marked), "\n").alias("md"))


# Claim units -------------------------------------------------------------------------------------------------------------

_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_HEAD = _TRIM.format("regexp_replace(regexp_replace(" + _TRIM.format("regexp_replace({0}, '^#+', '')") + ", '^[*_ ]+|[*_ ]+$', '', 'g'), ':+$', '')")
_IDS = "list_distinct(flatten(list_filter(list_transform(regexp_extract_all({0}, '\\[([^\\[\\]]+)\\]', 1), lambda g: list_transform(string_split(g, ';'), lambda x: trim(x))), lambda g: len(list_filter(g, lambda x: not regexp_full_match(x, '(?i)\\S*evidence\\S*'))) = 0)))"
_PRESENT = f"(regexp_full_match({{0}}, '(?i:{M.PRESENT_HEADING})') or (regexp_extract({{0}}, '^(?i:{M.PRESENT_HEADING})\\s*\\(([^()\\n]{{{{1,80}}}})\\)$', 1) <> '' and not regexp_matches(regexp_extract({{0}}, '^(?i:{M.PRESENT_HEADING})\\s*\\(([^()\\n]{{{{1,80}}}})\\)$', 1), '(?i){M.PREDICATE}')))"
_WORDS = "len(string_split_regex({0}, '\\s+'))"
_LINES = (
    f"l0 as (select doc_id, unnest(string_split(md, chr(10))) as raw, unnest(range(1, len(string_split(md, chr(10))) + 1)) as ln from ({_MD_SQL})), l1 as materialized (select *, {_TRIM.format('raw')} as line from l0), "
    f"l2 as materialized (select *, lag(line) over w as before, lead(line) over w as after, {_HEAD.format('line')} as title, len({_IDS.format('line')}) > 0 as cited from l1 window w as (partition by doc_id order by ln)), "
    "l3 as (select *, coalesce(regexp_matches(line, '^(=+|-+)$'), false) as r, coalesce(regexp_matches(before, '^(=+|-+)$'), false) as rb, coalesce(regexp_matches(after, '^(=+|-+)$'), false) as ra from l2), "
    "l4 as (select *, line <> '' and not (r and coalesce(before <> '', false) and not rb) and (ra or (not r and ("
    f"regexp_matches(line, '^#{{1,6}}\\s') or regexp_full_match(title, '(?i:{M.PLAIN_HEADING})') or {_PRESENT.format('title')} or (regexp_full_match(line, '(\\*\\*|__).+(\\*\\*|__)') and not cited and {_WORDS.format('title')} <= 8 and not regexp_matches(line, '[.?!][*_ ]*$')) "
    f"or (coalesce(before, '') = '' and coalesce(after, '') = '' and {_WORDS.format('line')} between 1 and 5 and regexp_matches(line, '^\\p{{Lu}}') and not contains(line, ':') and not regexp_matches(line, '[.,;?!]$') and not cited and not regexp_matches(line, '(?i){M.PREDICATE}'))))) as heading from l3), "
    "l5 as (select *, line <> '' and not heading and not r as plain from l4), "
    f"l6 as (select *, sum((line = '' or heading or (plain and regexp_matches(line, '^[-*+] ')))::int) over w as island, coalesce(last_value(case when heading then ({_PRESENT.format('title')} or regexp_full_match(title, '(?i:{M.OUTSIDE_HEADING})')) end ignore nulls) over w, false) as current from l5 window w as (partition by doc_id order by ln rows unbounded preceding)), "
    "u as materialized (select doc_id, row_number() over (partition by doc_id order by min(ln))::integer as unit, string_agg(line, ' ' order by ln) as text, min(ln)::integer as first_line, max(ln)::integer as last_line, arg_min(current, ln) as current from l6 where plain group by doc_id, island) "
)


@query("claim_units", "with " + _LINES + "select * from u")
def claim_units(spark, sf_dir):
    return A.claim_units(_answers(spark, sf_dir), "doc_id", "md")


# Rules -------------------------------------------------------------------------------------------------------------------

RULES = [
    A.Rule("current_claim_requires_web", r"(?i)(?:^|\s)(?:is|est|es|ist|der|the|la)(?:\s|$)", "web", section_only=True),
    A.Rule("strong_claim_requires_methodology", r"(?i)\s(?:and|und|et|y)\s.*\s(?:the|der|la|el)\s", "methodology"),
    A.Rule("number_requires_analytics", r"[0-9]{3,}", "analytics"),
]
_EVIDENCE = "select doc_id, 'web-evidence-' || i as evidence_id, case when i = 2 then 'methodology' else 'web' end as category from documents, (select unnest(range(3)) as i) union all select doc_id, 'db-evidence-' || i, case when (doc_id + i) % 2 = 0 then 'analytics' else 'methodology' end from documents, (select unnest(range(5)) as i)"


@query(
    "rule_findings",
    "with " + _LINES.rstrip() + f", ev as ({_EVIDENCE}), c as (select doc_id, unit, unnest({_IDS.format('text')}) as evidence_id from u), h as (select c.doc_id, c.unit, list_sort(list_distinct(list(category))) as cats, list_sort(list_distinct(list(c.evidence_id))) as ids from c join ev on c.doc_id = ev.doc_id and c.evidence_id = ev.evidence_id group by 1, 2), "
    "r(code, pattern, category, only_current) as (values " + ", ".join(f"('{r.code}', '{r.pattern}', '{r.category}', {str(r.section_only).lower()})" for r in RULES) + ") "
    "select u.doc_id, u.unit, r.code, u.first_line, u.last_line, md5(u.text) as text_md5, array_to_string(coalesce(h.ids, []), ' ') as cited from u left join h on u.doc_id = h.doc_id and u.unit = h.unit, r where regexp_matches(u.text, r.pattern) and (current or not only_current) and not list_contains(coalesce(h.cats, []), r.category)",
)
def rule_findings(spark, sf_dir):
    """Claims without the evidence that a rule asks for."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    named = lambda name, n, category: ids.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("doc_id", F.concat(F.lit(f"{name}-evidence-"), F.col("i").cast("string")).alias("evidence_id"), category.alias("category"))
    evidence = named("web", 3, F.when(F.col("i") == 2, "methodology").otherwise("web")).unionAll(named("db", 5, F.when((F.col("doc_id") + F.col("i")) % 2 == 0, "analytics").otherwise("methodology")))
    found = A.findings(A.claim_units(_answers(spark, sf_dir), "doc_id", "md"), "doc_id", evidence, RULES)
    return found.select("doc_id", "unit", "code", "first_line", "last_line", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.array_join("cited", " ").alias("cited"))


PATTERNS = {"license": r"(?i)licen[sc]ed?", "number": r"[0-9]+(?:[.,][0-9]+)*", "capitals": r"[A-Z]{4,}"}


@query(
    "pattern_matches",
    "with d as (select doc_id, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g') as t from documents), r(code, pattern) as (values " + ", ".join(f"('{c}', '{p}')" for c, p in PATTERNS.items()) + "), "
    "m as (select doc_id, t, code, string_split(regexp_replace(t, '(' || pattern || ')', chr(1) || '\\1' || chr(2), 'g'), chr(1)) as parts from d, r), e as (select doc_id, t, code, unnest(parts) as part, unnest(range(len(parts))) as i from m), "
    "s as (select *, coalesce(sum(length(replace(part, chr(2), ''))) over (partition by doc_id, code order by i rows between unbounded preceding and 1 preceding), 0)::integer as start from e) "
    "select doc_id, code, start, string_split(part, chr(2))[1] as match, (length(t[1:start]) - length(replace(t[1:start], chr(10), '')) + 1)::integer as line_number, md5(t[greatest(start - 30, 0) + 1:start + length(string_split(part, chr(2))[1]) + 30]) as context_md5 from s where i > 0",
)
def pattern_matches(spark, sf_dir):
    found = A.pattern_matches(table(spark, sf_dir, "documents"), "doc_id", "text", PATTERNS)
    return found.select("doc_id", "code", "start", "match", "line_number", F.md5(F.col("context").cast("binary")).alias("context_md5"))


# Presentation ------------------------------------------------------------------------------------------------------------

_ORDER = ["web-evidence-1", "db-evidence-0", "web-evidence-0", "db-evidence-2", "db-evidence-4", "db-evidence-6"]
_GROUP = M.CITATION_GROUP.replace("'", "''")


@query(
    "renumbered_citations",
    f"with m as (select doc_id, regexp_replace(md, '(?m)^([ \\t]{{0,3}})\\\\(#{{1,6}}[ \\t]+)', '\\1\\2', 'g') as md from ({_MD_SQL})), g as (select doc_id, md, regexp_extract_all(md, '(?i){_GROUP}') as groups, string_split(regexp_replace(md, '(?i){_GROUP}', chr(1), 'g'), chr(1)) as around from m), "
    f"n as (select *, list_transform(groups, lambda g: array_to_string(list_transform(list_filter(list_transform(string_split(g[2:-2], ';'), lambda x: list_position({_ORDER}, trim(x))), lambda p: p is not null), lambda p: '[' || p || ']'), ' ')) as numbers from g) "
    "select doc_id, len(groups)::integer as groups, md5(array_to_string(list_transform(around, lambda a, i: a || coalesce(numbers[i], '')), '')) as text_md5 from n",
)
def renumbered_citations(spark, sf_dir):
    """Headings without their escapes, citations as places in a list of sources."""
    ids = F.array(*[F.lit(i) for i in _ORDER])
    found = _answers(spark, sf_dir).withColumn("md", M.unescaped_headings(F.col("md")))
    groups = F.size(F.regexp_extract_all("md", F.lit(f"(?i)({M.CITATION_GROUP})"), F.lit(1)))
    return found.select("doc_id", groups.alias("groups"), F.md5(M.renumbered(F.col("md"), ids).cast("binary")).alias("text_md5"))


@query(
    "known_sections_dropped",
    f"with m as (select doc_id, regexp_replace(md, '(?m)^([ \\t]{{0,3}})\\\\(#{{1,6}}[ \\t]+)', '\\1\\2', 'g') as md from ({_MD_SQL})), l as (select doc_id, unnest(string_split(md, chr(10))) as raw, unnest(range(1, len(string_split(md, chr(10))) + 1)) as ln from m), "
    f"a as (select *, {_TRIM.format('raw')} as line, regexp_matches(raw, '^\\s*#{{1,6}}\\s+') as head from l), b as (select *, sum(head::int) over (partition by doc_id order by ln rows unbounded preceding) as section, regexp_matches(raw, '^(?i)\\s*#{{1,6}}\\s+limitations\\s*#*\\s*$') as titled, case when not head and line <> '' then lower(regexp_replace({_TRIM.format("regexp_replace(raw, '^\\s*(?:[-*+]\\s+|[0-9]+[.)]\\s+)', '')")}, '\\s+', ' ', 'g')) end as item from a), "
    "k as (select distinct doc_id, item from b where item is not null and (doc_id % 2 = 0 or ln % 2 = 0)), c as (select b.*, k.item is not null as known from b left join k on b.doc_id = k.doc_id and b.item = k.item), "
    "s as (select doc_id, section from c group by 1, 2 having bool_or(titled) and count(item) > 0 and count(item) = count(*) filter (item is not null and known)), d as (select c.*, s.section is not null as gone from c left join s on c.doc_id = s.doc_id and c.section = s.section), "
    "f as (select *, first_value(case when gone then 'gone' when line <> '' then 'stays' end ignore nulls) over (partition by doc_id order by ln rows between 1 following and unbounded following) as follows from d), "
    f"t as (select doc_id, string_agg(raw, chr(10) order by ln) as t from f where not gone and not (line = '' and coalesce(follows = 'gone', false)) group by 1) select m.doc_id, md5({_TRIM.format("coalesce(t, '')")}) as text_md5, length(md) - length({_TRIM.format("coalesce(t, '')")}) as dropped from m left join t on m.doc_id = t.doc_id",
)
def known_sections_dropped(spark, sf_dir):
    """Sections on limitations go where every line of them is known; for odd documents only every second line is."""
    answers = _answers(spark, sf_dir).withColumn("md", M.unescaped_headings(F.col("md")))
    lines = A.numbered_lines(answers, "doc_id", "md").where("line <> '' and (doc_id % 2 = 0 or at % 2 = 0)").where(~M.rlike(F.col("raw"), r"^\s*#{1,6}\s+"))
    known = lines.select("doc_id", F.regexp_replace("raw", r"^\s*(?:[-*+]\s+|[0-9]+[.)]\s+)", "").alias("item"))
    found = A.without_known_section(answers, "doc_id", "md", "limitations", known)
    return found.join(answers, "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), (F.length("md") - F.length("text")).cast("long").alias("dropped"))


# Cases -------------------------------------------------------------------------------------------------------------------

_CASE_SQL = (
    "select conv_id, case when count(*) > 3 then 'long' else 'short' end as status, case when conv_id % 2 = 1 then ['long'] else [] end as statuses, list_distinct(list(role || (turn % 3))) as called, "
    "case conv_id % 3 when 0 then ['user0', 'assistant1'] when 1 then ['user0', 'assistant2', 'system0'] else [] end as required, ['assistant0', 'user2', 'user1'] as optional, case when conv_id % 4 = 1 then ['assistant2'] else [] end as forbidden, "
    "map_from_entries(list({k: 't' || turn, v: role})) as arguments, case when conv_id % 5 = 0 then map(['t0', 't9'], ['user', 'user']) when conv_id % 2 = 0 then map(['t0', 't1'], ['user', 'assistant']) else map([]::varchar[], []::varchar[]) end as expected, case when conv_id % 6 = 0 then ['user0'] when conv_id % 6 = 1 then ['system2'] else [] end as needed from conversations group by conv_id"
)


@query(
    "case_scores",
    f"with c as ({_CASE_SQL}), s as (select conv_id, list_sort(list_filter(required, lambda x: not list_contains(called, x))) as missing, list_sort(list_filter(called, lambda x: not list_contains(list_concat(required, optional), x))) as unexpected, list_sort(list_filter(map_keys(expected), lambda k: arguments[k] is distinct from expected[k])) as wrong, "
    "case when len(required) > 0 then 1 - len(list_filter(required, lambda x: not list_contains(called, x)))/len(required)::double end as recall, case when len(statuses) > 0 then list_contains(statuses, status) end as status_correct, "
    "case when len(required) + len(forbidden) > 0 then len(list_filter(required, lambda x: not list_contains(called, x))) = 0 and not list_has_any(called, forbidden) end as tools_correct, case when cardinality(expected) > 0 then len(list_filter(map_keys(expected), lambda k: arguments[k] is distinct from expected[k])) = 0 end as arguments_correct, "
    "case when len(needed) > 0 then list_has_all(called, needed) end as evidence_correct from c), "
    "f as (select *, list_filter([case when not status_correct then 'status' end, case when not tools_correct then 'tools' end, case when not arguments_correct then 'arguments' end, case when not evidence_correct then 'evidence' end], lambda x: x is not null) as failures from s) "
    "select conv_id, array_to_string(missing, ' ') as missing, array_to_string(unexpected, ' ') as unexpected, array_to_string(wrong, ' ') as wrong_arguments, round(recall, 6) as recall, status_correct, tools_correct, arguments_correct, evidence_correct, array_to_string(failures, ' ') as failures, len(failures) = 0 as passed from f",
)
def case_scores(spark, sf_dir):
    """Conversations as cases: what was called, with which arguments, against what each should hold."""
    names = lambda *n: F.array(*[F.lit(x) for x in n]).cast("array<string>")
    texts = lambda *kv: F.create_map(*[F.lit(x) for x in kv]) if kv else F.create_map().cast("map<string,string>")
    c, i = table(spark, sf_dir, "conversations"), F.col("conv_id")
    held = c.groupBy("conv_id").agg(F.when(F.count("*") > 3, "long").otherwise("short").alias("status"), F.collect_set(F.concat("role", (F.col("turn") % 3).cast("string"))).alias("called"), F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("t"), F.col("turn").cast("string")), "role"))).alias("arguments"))  # one conversation's turns
    cases = held.withColumns(
        {
            "statuses": F.when(i % 2 == 1, names("long")).otherwise(names()),
            "required": F.when(i % 3 == 0, names("user0", "assistant1")).when(i % 3 == 1, names("user0", "assistant2", "system0")).otherwise(names()),
            "optional": names("assistant0", "user2", "user1"),
            "forbidden": F.when(i % 4 == 1, names("assistant2")).otherwise(names()),
            "expected": F.when(i % 5 == 0, texts("t0", "user", "t9", "user")).when(i % 2 == 0, texts("t0", "user", "t1", "assistant")).otherwise(texts()),
            "needed": F.when(i % 6 == 0, names("user0")).when(i % 6 == 1, names("system2")).otherwise(names()),
            "categories": F.col("called"),
        }
    )
    s = A.case_scores(cases, "conv_id")
    return s.select("conv_id", *[F.array_join(x, " ").alias(x) for x in ("missing", "unexpected", "wrong_arguments", "failures")], F.round("recall", 6).alias("recall"), "status_correct", "tools_correct", "arguments_correct", "evidence_correct", "passed")
