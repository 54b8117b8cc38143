import corpus_pipeline
import pytest
import regex

import __spark_entry__
from tessera.llm.language_id import identify_language
from tessera.llm.queries_op8 import language_model

from .test_jaccard_join import brute
from .test_packing import check_packing

SF = "/root/testdata/sf0.01"


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 10
    assert __spark_entry__.oracle_sql().keys() <= names.keys()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = corpus_pipeline.language_stage(spark, docs, SF)
    assert known.columns == docs.columns
    left = {r.doc_id for r in known.collect()}
    assert all((i in left) or not regex.search(r"\p{L}", t or "") for i, t in texts.items())  # short clean texts stay too
    low = {r.doc_id for r in identify_language(docs, language_model(docs)).collect() if r.lang_pred == "und" or r.score < 0.5}
    assert left == texts.keys() - low
    clean = corpus_pipeline.toxicity_stage(spark, known, SF)
    assert clean.columns == docs.columns
    kept = {r.doc_id for r in clean.collect()}
    assert kept <= left and sum(toxic.get(i) == 0 for i in left - kept) == 0 and sum(toxic.get(i) == 1 for i in left - kept) > 20
    unique = corpus_pipeline.near_duplicate_stage(spark, clean, SF)
    assert unique.columns == docs.columns
    want = {i for i, _, c in brute([(i, texts[i]) for i in kept], 5, 80) if i == c}
    rows = unique.collect()
    assert {r.doc_id for r in rows} == want and len(rows) == len(want)
    check_packing(corpus_pipeline.packing_stage(spark, unique, SF).collect(), {i: texts[i] for i in want})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, name, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, "no id", "en", "s", 1), (-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "Same words here now again", "en", "s", 3), (-3, "Same words here now again", "en", "s", 3)], docs.schema)
    more = docs.limit(200).union(nulls).selectExpr("*", "'x' AS n", "1 AS score")
    out = stage(spark, more, SF)
    assert out.count() > 0
    if name != "best_fit_packing":
        assert out.columns == more.columns
    empty = stage(spark, more.limit(0), SF)
    assert empty.collect() == []


def test_near_duplicates_by_row(spark):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(30)) for w in "abcd")
    rows = [(3, a), (5, a), (5, b), (None, c), (None, c), (None, a), (None, d), (7, "short"), (7, "short"), (7, "other"), (None, "short"), (8, None), (8, None), (None, "")]
    hot = [(9, " ".join(f"{k}h{i}" for i in range(12))) for k in range(40)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows + hot)], "doc_id long, text string, n int").repartition(5)
    out = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert out.columns == docs.columns
    want = [(3, a), (5, b), (None, c), (None, d), (7, "short"), (7, "other"), (8, None), (None, ""), *hot]
    assert sorted(map(str, [(r.doc_id, r.text) for r in out.collect()])) == sorted(map(str, want))


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())
