"""Patterns through the automaton against every pattern on every line."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators.corpus import IMPORT, SYMBOL_RULES, TEST_NAME, pattern_hits
from tessera.operators.multipattern import literals, matching, occurrences, starts_of

LINES = [
    "export class Widget7 extends Base {", "  public static void Main(String[] a) {", "func (s *Server) Serve1() error {", "it(\"should fail\")", "import x from './s1'", "TYPE Order struct {", "colour color colr", "a+b(c)", "", None, "type Order struct {",
    "xyzzy" * 50, "aaaaaa", "[x] {y} | z", "data class Item(val id: Int)", "#[test]", "Straße STRASSE", "interface é {",
]
PATTERNS = [r"colou?r", r"a\+b\(", r"(?i)type\s+order", r"^$", r"x|", r"(foo|bar)?aaa", r"[Ww]idget\d+", r"(?:static|final)\s+void", r"a{2,}", r"(xy)+zzy", r"\[x\] \{y\}", r"(?=.*struct)type", r"it\(|test\(", r"é", *[r[3] for r in SYMBOL_RULES], IMPORT, TEST_NAME]


@pytest.mark.parametrize(("pattern", "want"), [(r"colou?r", ["colo"]), (r"a\+b\(", ["a+b("]), (r"x|", None), (r"(foo|bar)?aaa", ["aaa"]), (r"a|bc", ["a", "bc"]), (r"[ab]c*", None), (r"(get|post)\(", ["get", "post"]), (r"ab+c", ["ab"]), (r"\d+", None), (r"(?i)TYPE", ["type"]), (r"a)b", None)])
def test_required_literals(pattern, want):
    assert literals(pattern) == want


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_every_match_holds_a_literal(data):
    pattern = data.draw(st.sampled_from([p for p in PATTERNS if p != "^$"]))
    text = data.draw(st.from_regex(re.compile(pattern, re.A)))
    need = literals(pattern)
    assert need is None or any(w in text.lower() for w in need)


def brute(lines, patterns):
    return sorted((i, p) for i, text in enumerate(lines) if text is not None for p in patterns if re.search(p, text))


@pytest.mark.parametrize("block", [50_000, 7])
def test_matching_equals_every_pattern_on_every_line(spark, block):
    lines = spark.createDataFrame([(i, x, "p") for i, x in enumerate(LINES)], "lineno int, content string, other string").repartition(3)
    rules = spark.createDataFrame([(f"r{i}", p) for i, p in enumerate(PATTERNS)] + [("r0", PATTERNS[0])], "rule string, pattern string")
    found = matching(lines, rules, block=block)
    assert found.columns == ["lineno", "content", "other", "rule", "pattern"]
    assert sorted((r.lineno, r.pattern) for r in found.collect()) == brute(LINES, PATTERNS)


def test_thousands_of_patterns_take_one_pass(spark):
    lines = spark.range(2000).selectExpr("id AS lineno", "concat('call name', id, '(x)') AS content")
    rules = spark.range(5000).selectExpr("id AS rule", r"concat('name', id, '\\(') AS pattern")
    assert sorted(r.rule for r in matching(lines, rules).collect()) == list(range(2000))


def test_hits_of_a_pattern_table_equal_those_of_a_list(spark):
    lines = spark.createDataFrame([("r", f"f{i % 7}", i, LINES[i % len(LINES)]) for i in range(200)], "repo string, rel string, lineno int, content string")
    rules = spark.createDataFrame([(p,) for p in PATTERNS[:8]], "pattern string")
    key = lambda df: sorted((r.repo, r.rel, r.lineno, r.pattern, r.truncated) for r in df.collect())
    assert key(pattern_hits(lines, rules, cap=5)) == key(pattern_hits(lines, PATTERNS[:8], cap=5))


def test_occurrences_do_not_overlap_and_tables_may_be_empty(spark):
    lines = spark.createDataFrame([(1, "aaaa ab"), (2, None), (3, "")], "k int, line string")
    words = spark.createDataFrame([("aa",), ("a",), ("b",), ("",), (None,), ("zz",)], "stem string")
    assert sorted((r.k, r.stem, r.times_found) for r in occurrences(lines, words, "line", "stem").collect()) == [(1, "a", 5), (1, "aa", 2), (1, "b", 1)]
    assert occurrences(lines.limit(0), words, "line", "stem").count() == 0 and occurrences(lines, words.limit(0), "line", "stem").count() == 0


def test_lines_are_read_once_for_any_number_of_words(spark):
    """Only the lengths of words by their start go through the driver, and the lines stand once in the plan."""
    words = spark.range(120_000).selectExpr("concat(CASE WHEN id % 2 = 0 THEN 'p' ELSE 's' END, id) AS stem").unionByName(spark.createDataFrame([("é",), ("a b",)], "stem string"))
    lines = spark.createDataFrame([(1, "=== /r/src/p12.ts ==="), (2, "é p1 p12 a b"), (3, "s3s3p119998")], "k int, line string")
    assert starts_of(words, "stem").count() == 4
    found = occurrences(lines, words, "line", "stem")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = {(1, "p12", 1), (2, "p12", 1), (2, "é", 1), (2, "a b", 1), (3, "s3", 2), (3, "p119998", 1)}
    assert {(r.k, r.stem, r.times_found) for r in found.collect()} == want
