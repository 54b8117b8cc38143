"""Exact phrases and proximity matches against brute force over token lists."""

import re

import pytest

from tessera.llm.positional_index import build_index, contamination, matches, windows_of

DOCS = "doc_id long, text string, item_id string, places string"
ITEMS = "item_id long, text string, doc_id long"
LONG = "w " * 30000 + "a b c d e " + "w " * 30000
ROWS = [
    (1, "A b c d e f g", "x", "y"), (2, "b c d. e f! g h a b c d", "x", "y"), (3, "a b c", None, None), (4, None, "x", "y"), (5, "", "x", "y"), (6, " .. ", "x", "y"),
    (1, "A b c d e f g", "x", "y"), (None, "zeta a b c d", "x", "y"), (7, LONG, "x", "y"), (8, "été naïve Ünder été naïve", "x", "y"), (9, "a a a a a a", "x", "y"), (10, "d e", None, None), (11, "c x b y a z d", None, None),
]
ASKED = [(100, "a b c d e", 1), (101, "b c d e f g", 1), (102, "a b", 1), (103, "été naïve", 1), (104, "a a a a", 1), (105, None, 1), (106, "!", 1), (107, "nowhere to be found", 1), (100, "a b c d e", 1), (2, "zeta A b c", 1), (None, "w a", 1)]


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def windows(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, asked, width):
    """(doc_id, n_words, n_hit, item ids) of each row."""
    out = []
    for doc, text, *_ in rows:
        w, hit, items = words(text), set(), set()
        for item, said, *_ in asked:
            for win in windows(said, width):
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit.update(range(i, i + len(win)))
                        items.update([str(item)] if item is not None else [])
        out.append((doc, len(w), len(hit), sorted(items)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["item_ids"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def index(spark):
    return build_index(spark.createDataFrame(ROWS, DOCS).repartition(3), shard_bytes=64)


@pytest.mark.parametrize("width", [1, 2, 4, 5])
def test_contamination_equals_brute_force(spark, index, width):
    items = spark.createDataFrame(ASKED, ITEMS)
    assert got(contamination(index, items, width)) == brute(ROWS, ASKED, width)


def test_blocks_of_the_test_set_change_nothing(spark, index):
    items = spark.createDataFrame(ASKED, ITEMS)
    assert got(contamination(index, items, 4, block=2)) == brute(ROWS, ASKED, 4)


def test_matches_are_all_places(spark, index):
    found = sorted((r.doc_id or 0, r["item_id"], r.start, r.length) for r in matches(index, spark.createDataFrame(ASKED, ITEMS), 4).filter("item_id = '104' OR doc_id = 7").collect())
    assert found == [(7, "100", 30000, 4), (7, "100", 30001, 4), (7, "101", 30001, 4), (7, "102", 30000, 2), *[(9, "104", i, 4) for i in range(3)]]


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_near_matches_equal_brute_force(spark, index, slop):
    want = set()
    for doc, text, *_ in ROWS:
        w = words(text)
        for item, said, *_ in ASKED:
            for win in windows(said, 4):
                for i in range(len(w)):
                    if item is not None and w[i] in win and set(win) <= set(w[i : i + len(win) + slop]):
                        want.add((doc, str(item), i, len(win) + slop))
    found = matches(index, spark.createDataFrame(ASKED, ITEMS), 4, slop=slop).collect()
    assert {(r.doc_id, r["item_id"], r.start, r.length) for r in found} == want


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame(ASKED, ITEMS)
    assert contamination(build_index(none), items, 4).count() == 0
    some = build_index(spark.createDataFrame(ROWS, DOCS))
    assert got(contamination(some, spark.createDataFrame([], ITEMS), 4)) == brute(ROWS, [], 4)
    assert windows_of(spark.createDataFrame([(1, None), (2, "..")], "item_id long, text string"), 3).count() == 0


def test_windows_longer_than_the_gap_are_refused(spark):
    index = build_index(spark.createDataFrame(ROWS, DOCS), gap=4)
    with pytest.raises(Exception, match="gap"):
        contamination(index, spark.createDataFrame(ASKED, ITEMS), 5).collect()


def test_no_list_is_larger_than_a_shard(spark):
    rows = spark.range(2000).selectExpr("id AS doc_id", "repeat('the of ', 50) AS text")
    index = build_index(rows, shard_bytes=10_000)
    assert index.filter("term IS NOT NULL").selectExpr("max(n)").first()[0] <= 10_000 and index.filter("term = 'the'").selectExpr("sum(n)").first()[0] == 100_000
