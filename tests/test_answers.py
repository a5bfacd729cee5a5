import pytest
from pyspark.sql import functions as F

from touchline.functions import markdown as M
from touchline.operators import answers as A


def units(spark, text):
    found = A.claim_units(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("unit").collect()
    return [(r.text, r.first_line, r.last_line, r.current) for r in found]


def test_wrapped_lines_join_and_lists_break(spark):
    text = "First line\n  goes on.\n\n- one\n- two\n  wraps\n* three\n\nLast is here."
    assert units(spark, text) == [("First line goes on.", 1, 2, False), ("- one", 4, 4, False), ("- two wraps", 5, 6, False), ("* three", 7, 7, False), ("Last is here.", 9, 9, False)]


@pytest.mark.parametrize(
    ("heading", "current"),
    [("## Current status", True), ("### Transfer update", True), ("Current situation (as of May)", True), ("## Current status (he is injured)", False), ("**Summary:**", False), ("# Anything at all", False), ("Role fit analysis:", False), ("__Latest news__", True), ("Recent form", False)],
)
def test_headings_end_a_unit_and_set_the_section(spark, heading, current):
    assert units(spark, f"Before is text.\n\n{heading}\n\nAfter is text.") == [("Before is text.", 1, 1, False), ("After is text.", 5, 5, current)]


def test_underlines(spark):
    assert units(spark, "Current club\n====\nHe plays there.\nMore") == [("He plays there. More", 3, 4, True)]
    assert units(spark, "Current club\n---\nA is b.\n\n---\n---\n\nC is d.") == [("A is b.", 3, 3, True), ("C is d.", 8, 8, False)]
    assert units(spark, "Current club\n---\nA is b.\n\n---\n\nC is d.") == [("A is b.", 3, 3, True), ("C is d.", 7, 7, True)]


def test_what_is_no_heading(spark):
    for line in ("He is here", "Short title.", "Title: with colon", "lower case title", "One two three four five six", "Short title [evidence-1]", "**He left.**", "**Bold title** [evidence-2]"):
        assert [u[0] for u in units(spark, f"\n{line}\n")] == [line], line
    assert units(spark, "Short Title\nfollowed by text") == [("Short Title followed by text", 1, 2, False)]
    assert units(spark, "") == [] and units(spark, None) == [] and units(spark, "\n \n") == []


def test_rules_look_at_the_evidence_of_their_own_claim(spark):
    text = "## Current club\nHe plays for A [web-evidence-1].\n\nHe plays for B [db-evidence-1].\n\n# Analysis\nHe plays for C.\n\nTuned 12 times [evidence-9]."
    evidence = spark.createDataFrame([(1, "web-evidence-1", "web"), (1, "db-evidence-1", "analytics"), (2, "evidence-9", "methodology")], "k int, evidence_id string, category string")
    rules = [A.Rule("current", "(?i)plays", "web", True), A.Rule("any", "(?i)plays", "analytics"), A.Rule("tuned", "Tuned", "methodology")]
    found = A.findings(A.claim_units(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t"), "k", evidence, rules)
    assert sorted((r.code, r.first_line, r.cited) for r in found.collect()) == [("any", 2, ["web-evidence-1"]), ("any", 7, []), ("current", 4, ["db-evidence-1"]), ("tuned", 9, [])]


def test_each_line_is_judged_once(spark):
    units = A.claim_units(spark.createDataFrame([(1, "a\nb")], "k int, t string"), "k", "t")
    assert units._jdf.queryExecution().optimizedPlan().toString().count(r"^#{1,6}\s") == 1


def test_units_meet_the_rules_in_one_pass(spark):
    units = A.claim_units(spark.createDataFrame([(1, "a\nb")], "k int, t string"), "k", "t")
    found = A.findings(units, "k", spark.createDataFrame([(1, "x", "web")], "k int, evidence_id string, category string"), [A.Rule("c", "p", "web")])
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2


def test_citations_of_one_id_in_several_categories_or_none(spark):
    answers = spark.createDataFrame([(1, "It is [a-evidence; a-evidence; b-evidence]."), (2, "It is [b-evidence]."), (None, "It is [a-evidence]."), (3, "It is [unknown-evidence].")], "k int, t string")
    evidence = spark.createDataFrame([(1, "a-evidence", "web"), (1, "a-evidence", "analytics"), (1, "a-evidence", "web"), (1, None, "methodology"), (2, "b-evidence", None), (None, "a-evidence", "web")], "k int, evidence_id string, category string")
    found = A.findings(A.claim_units(answers, "k", "t"), "k", evidence, [A.Rule(c, "is", c) for c in ("web", "analytics", "methodology")])
    assert sorted(((r.k or 0, r.code, r.cited) for r in found.collect()), key=repr) == sorted([(1, "methodology", ["a-evidence"])] + [(k, c, ["b-evidence"] if k == 2 else []) for k in (0, 2, 3) for c in ("web", "analytics", "methodology")], key=repr)


def test_trimmed_equals_the_sql(spark, duck):
    for text in (" \t a b \r\n", "a  \u2028", "\u2028 a", " \n ", "", "a \u0085"):
        want = duck.execute("select regexp_replace($1, '^\\s+|\\s+$', '', 'g')", [text]).fetchone()[0]
        assert column(spark, text, M.trimmed) == want, repr(text)


def test_matches_have_offsets_lines_and_context(spark):
    text = "ab 12\n\x07cd 345 ab\nxab"
    found = A.pattern_matches(spark.createDataFrame([(1, text), (2, "none"), (3, None)], "k int, t string"), "k", "t", {"n": "[0-9]+", "ab": r"\bab\b", "at end": "b$"}, around=2)
    clean = text.replace("\x07", "")
    got = sorted((r.code, r.start, r.match, r.line_number, r.context) for r in found.collect())
    assert got == [("ab", 0, "ab", 1, "ab 1"), ("ab", 13, "ab", 2, "5 ab\nx"), ("at end", 18, "b", 3, "xab"), ("n", 3, "12", 1, "b 12\nc"), ("n", 9, "345", 2, "d 345 a")]
    assert all(clean[start : start + len(match)] == match for _, start, match, _, _ in got)


def column(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first().x


def test_citations_are_renumbered(spark):
    text = "A [web-evidence-2; db-evidence-1]. B [db-evidence-1] [evidence-7] [other] c[EVIDENCE-3]"
    assert column(spark, text, M.cited_in_order) == ["web-evidence-2", "db-evidence-1", "evidence-7", "EVIDENCE-3"]
    ids = F.array(*[F.lit(i) for i in ("db-evidence-1", "web-evidence-2", "EVIDENCE-3")])
    assert column(spark, text, lambda c: M.renumbered(c, ids)) == "A [2] [1]. B [1]  [other] c[3]"
    assert column(spark, text, lambda c: M.renumbered(c, M.cited_in_order(c))) == "A [1] [2]. B [2] [3] [other] c[4]"
    assert column(spark, "no group", lambda c: M.renumbered(c, ids)) == "no group" and column(spark, "", lambda c: M.renumbered(c, ids)) == ""


def test_escaped_headings(spark):
    assert column(spark, "\\# A\n  \\### B\n    \\# code\na \\# b\n\\#no", M.unescaped_headings) == "# A\n  ### B\n    \\# code\na \\# b\n\\#no"


def test_known_sections_go(spark):
    text = "Intro\n\n## Limitations\n- Small  sample\n1. One league\n\n## Next\nText\n\n# limitations #\nSomething new\n- small sample"
    answers = spark.createDataFrame([(1, text), (2, text), (3, None)], "k int, t string")
    known = spark.createDataFrame([(1, "small sample"), (1, "One League"), (2, "small sample")], "k int, item string")
    found = {r.k: r.text for r in A.without_known_section(answers, "k", "t", "limitations", known).collect()}
    assert found == {1: "Intro\n## Next\nText\n\n# limitations #\nSomething new\n- small sample", 2: text, 3: ""}


def test_case_scores(spark):
    schema = "k int, status string, statuses array<string>, called array<string>, required array<string>, optional array<string>, forbidden array<string>, arguments map<string,string>, expected map<string,string>, categories array<string>, needed array<string>"
    rows = [
        (1, "ok", ["ok"], ["a", "b"], ["a"], ["b"], ["z"], {"x": "1"}, {"x": "1"}, ["web"], ["web"]),
        (2, "bad", ["ok"], ["b", "z"], ["a"], [], ["z"], {"x": "2"}, {"x": "1", "y": "1"}, [], ["web"]),
        (3, None, [], ["q"], [], [], [], {}, {}, [], []),
    ]
    got = {r.k: r for r in A.case_scores(spark.createDataFrame(rows, schema), "k").collect()}
    assert got[1].passed and got[1].failures == [] and got[1].recall == 1.0 and got[1].unexpected == []
    assert got[2].failures == ["status", "tools", "arguments", "evidence"] and got[2].missing == ["a"] and got[2].unexpected == ["b", "z"] and got[2].wrong_arguments == ["x", "y"] and got[2].recall == 0.0
    assert got[3].passed and got[3].unexpected == ["q"] and [got[3][c] for c in ("recall", "status_correct", "tools_correct", "arguments_correct", "evidence_correct")] == [None] * 5
