"""Quality, toxicity and language models: held-out accuracy on the synthetic tables, and odd rows."""

import zlib

import numpy as np
import pytest
import regex

from tessera.llm.language_id import identify_language, train_language
from tessera.llm.quality import passages, score_quality, train_quality
from tessera.llm.queries_op5 import op5_quality
from tessera.llm.queries_op7 import op7_toxicity
from tessera.llm.queries_op8 import op8_language_id
from tessera.llm.textvec import code_points, ngrams
from tessera.llm.toxicity import fit_toxicity, score_toxicity, train_toxicity

SF = "/root/testdata/sf0.01"
ODD = ["", " ", "\n\n", "a", "1234 !!", "é", "日本語の文", "x" * 200_000, "word " * 30_000, "\x00", "😀", "same same same"]


@pytest.fixture(scope="module")
def truth(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return docs, labels


def test_quality_held_out(spark, truth):
    docs, labels = truth
    rows = op5_quality(spark, SF).collect()
    assert {r.doc_id for r in rows} == docs.keys() and len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id].quality) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_toxicity_held_out(spark, truth):
    docs, labels = truth
    rows = op7_toxicity(spark, SF).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id].toxic) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.93 and not any(a > b for a, b in held)


def test_language_held_out(spark, truth):
    docs, _ = truth
    rows = op8_language_id(spark, SF).collect()
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]) > 0.97
    assert all((r.lang_pred == "und") == (not regex.search(r"\p{L}", docs[r.doc_id].text or "")) for r in rows)


def test_language_is_sparse_and_calibrated(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train_language(docs)
    assert 0.01 < (model.weights == 0).mean() < 1 and 0.1 <= model.temperature <= 5


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 2.0) for i, t in enumerate(texts)], "doc_id long, text string, predicted string, score double")


def test_odd_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    both = docs.select("doc_id", "text").join(labels, "doc_id")
    df = frame(spark, [*ODD, None, *ODD])
    for rows in (score_quality(df, train_quality(both)).collect(), score_toxicity(df, train_toxicity(both)).collect()):
        assert len(rows) == 2 * len(ODD) + 1
        by = {r.doc_id: r.score for r in rows}
        assert all(0 <= s <= 1 for s in by.values()) and by[len(ODD)] == by[0]
        assert all(abs(by[i] - by[len(ODD) + 1 + i]) < 1e-6 for i in range(len(ODD)))
    model = train_language(docs)
    found = {r.doc_id: r for r in identify_language(df, model).collect()}
    und = {i for i, t in enumerate(ODD) if not regex.search(r"\p{L}", t)} | {len(ODD)}
    assert {i for i in found if i <= len(ODD) and found[i].lang_pred == "und"} == und and all(found[i].score == 0 for i in und)
    for f, m in ((score_quality, train_quality(both)), (score_toxicity, train_toxicity(both)), (identify_language, model)):
        assert f(df.limit(0), m).collect() == []


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string, toxic int, quality int, lang string")
    df = frame(spark, ["a", None])
    assert [r.score for r in score_quality(df, train_quality(none)).collect()] == [0.5, 0.5]
    assert all(r.score < 1e-9 for r in score_toxicity(df, train_toxicity(none)).collect())
    assert {r.lang_pred for r in identify_language(df, train_language(none)).collect()} == {"und"}
    one = spark.createDataFrame([(1, "abc", 1, 1, "en"), (2, None, 0, 0, "de"), (3, "x", None, None, None)], none.schema)
    assert {r.lang_pred for r in identify_language(df.limit(1), train_language(one)).collect()} == {"en"}
    assert all(r.predicted == 1 for r in score_toxicity(df, train_toxicity(one)).collect())


def test_scores_do_not_depend_on_neighbours():
    texts = ["you idiot", "fine words here", "", "é idiot é"] * 10
    model = fit_toxicity(texts, np.array([1, 0, 0, 1] * 10))
    alone = [model.scores([t])[0] for t in texts]
    assert np.allclose(model.scores(texts), alone)


def test_ngrams_stay_within_texts():
    texts = ["ab", "", "abc", "b"]
    codes, bounds = code_points(texts)
    for n, (h, doc) in zip((1, 2, 3, 5, 9), ngrams(codes, bounds, (1, 2, 3, 5, 9), 20), strict=True):
        padded = [f" {t} " for t in texts]
        want = [(i, p[k : k + n]) for i, p in enumerate(padded) for k in range(len(p) - n + 1)]
        assert doc.tolist() == [i for i, _ in want]
        names = {}
        for (_, g), b in zip(want, h.tolist()):
            assert names.setdefault(g, b) == b
        assert len(set(names.values())) == len(names)


def test_passages():
    x, first = passages(["", "w " * 130, "one"], words=64)
    assert first.tolist() == [0, 1, 4, 5] and x.shape[0] == 5
    alone = passages(["w " * 130], words=64)[0]
    assert np.allclose(alone, x[1:4])


def test_toxicity_recall():
    """Held-out toxic documents of the 0.1 tables, all of whose labelled rows fit the sample."""
    import duckdb

    rows = duckdb.sql("SELECT doc_id, text, toxic FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) WHERE text IS NOT NULL ORDER BY doc_id").fetchall()
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows]
    learn = [r for r, h in zip(rows, held) if not h]
    model = fit_toxicity([t for _, t, _ in learn], np.array([y for _, _, y in learn]))
    score, y = model.scores([t for (_, t, _), h in zip(rows, held) if h]), np.array([y for (_, _, y), h in zip(rows, held) if h])
    assert (score[y == 1] >= 0.7).mean() >= 0.9 and not (score[y == 0] >= 0.7).any()
