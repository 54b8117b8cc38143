"""Phrase, prefix and boolean search on a written index against brute force."""

import math
import re

import pytest

from pyspark.sql import functions as F

from tessera.operators.docs import search_index, write_index
from tessera.operators.search import parse, search_positions, write_positions

DOCS = [
    (1, "alpha beta gamma"), (2, "beta x alpha"), (3, "alpha beta alpha beta"), (4, "Alphabet soup, beta!"), (5, ""), (6, None), (7, "gamma gamma delta"), (8, "beta alpha beta gamma delta epsilon"), (9, "über straße alpha"), (10, "x y z " * 40 + "alpha beta"),
    *[(100 + i, f"word{i} alpha " + "filler " * (i % 9)) for i in range(60)],
]
QUERIES = ['"alpha beta"', "alpha beta", "alph*", "alpha NOT beta", "gamma OR delta", "beta NOT (gamma OR x)", '"alpha bet" *', "alpha AND gamma OR delta", '"beta alpha beta"', "über", "word1* alpha", "zzz", "zzz OR gamma", "alpha NOT beta gamma"]


def brute(query, k, k1=1.2, b=0.75):
    tree, phrases = parse(query)
    toks = {d: re.findall(r"[^\W_]+", (t or "").lower()) for d, t in DOCS}
    avg = sum(map(len, toks.values())) / len(toks)

    def count(words, prefix, t):
        n = len(words)
        ok = lambda a, w, last: a.startswith(w) if last and prefix else a == w
        return sum(all(ok(t[i + j], words[j], j == n - 1) for j in range(n)) for i in range(len(t) - n + 1))

    tf = {d: [count(w, p, t) for w, p in phrases] for d, t in toks.items()}
    df = [sum(x[i] > 0 for x in tf.values()) for i in range(len(phrases))]

    def holds(tree, x):
        op, *rest = tree
        if op == "is":
            return x[rest[0]] > 0
        a, c = holds(rest[0], x), holds(rest[1], x)
        return {"OR": a or c, "AND": a and c, "NOT": a and not c}[op]

    out = []
    for d, x in tf.items():
        if holds(tree, x):
            idf = [max(math.log((len(toks) - n + 0.5) / (n + 0.5)), 1e-6) for n in df]
            out.append((-round(sum(i * f * (k1 + 1) / (f + k1 * (1 - b + b * len(toks[d]) / avg)) for i, f in zip(idf, x) if f), 9), d))
    return [(d, round(-s, 6)) for s, d in sorted(out)[:k]]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    write_positions(spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3), path, block_docs=7, files=3)
    return path


@pytest.mark.parametrize("query", QUERIES)
def test_search_equals_brute_force(spark, index, query):
    got = search_positions(index, spark.createDataFrame(DOCS, "doc_id long, text string"), query, k=5, first_blocks=2).collect()
    want = brute(query, 5)
    assert sorted(((r.doc_id, r.score) for r in got), key=repr) == sorted(want, key=repr)


def test_snippets_mark_phrases_and_prefixes(spark, index):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert {r.doc_id: r.snippet for r in search_positions(index, docs, '"beta gamma" delt*').collect()} == {8: "[beta] [gamma] [delta] epsilon"}


@pytest.mark.parametrize("query", ["", "NOT a", "a AND", "(a", "a )", "a OR OR b", "!!"])
def test_odd_queries_are_errors(query):
    with pytest.raises(ValueError):
        parse(query)


def test_a_common_term_is_many_rows(spark, index):
    rows = spark.read.parquet(f"{index}/postings").filter("term = 'alpha'")
    assert rows.count() > 5 and rows.selectExpr("max(n)").first()[0] < 30


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    write_positions(none, str(tmp_path / "i"))
    assert search_positions(str(tmp_path / "i"), none, "a OR b*").count() == 0


def test_a_block_of_documents_is_one_file(spark, index):
    """Postings stay in the task that their texts were shuffled to."""
    rows = spark.read.parquet(f"{index}/postings").selectExpr("input_file_name() AS file", "block", "explode(docs) AS d").select("file", "block", "d.doc_id")
    assert rows.groupBy("block").agg(F.count_distinct("file").alias("n")).filter("n > 1").count() == 0
    assert rows.select("block").distinct().count() > 3 and rows.select("doc_id").distinct().count() == len(DOCS) - 2


def test_a_document_of_the_word_index_is_in_one_file(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    write_index(docs, str(tmp_path / "i"), 4, bucket_docs=10)
    rows = spark.read.parquet(str(tmp_path / "i" / "postings")).selectExpr("input_file_name() AS file", "doc_id")
    assert rows.groupBy("doc_id").agg(F.count_distinct("file").alias("n")).filter("n > 1").count() == 0
    assert rows.select("file").distinct().count() > 4
    assert {r.doc_id for r in search_index(str(tmp_path / "i"), docs, "gamma delta").collect()} == {7, 8}
