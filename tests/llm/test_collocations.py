"""Phrase mining against plain loops, with tries and shards small enough to be many."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.collocations import bucket_bits, collocations, frequent_phrases, numbered, token_shards
from tessera.llm.double_array import build

KIND = "doc_id long, text string, lang string, phrase string, n long"
TEXTS = [
    ("red car. red car! old red car, new red car; the red car of the old man", "en"), ("the old man, the old man the old man", "en"), ("A B a b A B\tA  B\nA B\x0bA B", "en"), (None, "en"), ("", "en"), (" ., ", "fr"),
    ("été été été  été été", "fr"), ("red car", None), ("red car\nred\ncar", None), ("red car", "und"), ("the old man, the old man the old man", "en"), ("x " * 5000 + "y", "de"), ("nb\xa0sp nb\xa0sp nb\xa0sp", "fr"), ("z\x00 z\x00 z\x00", ""),
]


def brute(rows, max_words, min_count, percent, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    often = {p: c for p, c in f.items() if c >= min_count}
    out = {}
    for (lang, p), a in often.items():
        if len(p) < 2 or any(x == lang and len(q) > len(p) and 100 * c >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), c in often.items()):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def frame(spark, texts):
    return spark.createDataFrame([(i, t, x, "other", 5) for i, (t, x) in enumerate(texts)], KIND).repartition(3)


@pytest.mark.parametrize(("max_words", "min_count", "percent", "top", "how"), [(3, 2, 50, 2000, {}), (3, 2, 50, 3, {"block": 3, "per_pass": 2, "shard_bytes": 60}), (4, 3, 80, 2000, {"block": 5, "shard_bytes": 60}), (2, 1, 50, 2000, {"block": 7, "per_pass": 1})])
def test_equals_brute_force(spark, max_words, min_count, percent, top, how):
    assert got(collocations(frame(spark, TEXTS), max_words, min_count, percent, top, **how)) == brute(TEXTS, max_words, min_count, percent, top)


def test_empty_tables_and_nothing_frequent(spark):
    assert got(collocations(frame(spark, []).limit(0))) == []
    assert got(collocations(frame(spark, [("a b c", "en")]))) == []


def test_a_phrase_is_counted_across_shards(spark):
    shards = token_shards(frame(spark, [("common pair", "en")] * 12), shard_bytes=20)
    assert shards.count() > 5
    assert [sorted((r.phrase, r.f) for r in x.collect()) for x in frequent_phrases(shards, 2, 12)] == [[("common", 12), ("pair", 12)], [("common pair", 12)]]


def test_each_language_fills_its_shards(spark):
    rows = [("one two three", x) for _ in range(30) for x in ("en", "de", "fr", "es")]
    shards = token_shards(frame(spark, rows).coalesce(1), shard_bytes=200).collect()
    assert len(shards) == 8 and sum(r.n for r in shards) == 360  # 15 texts of 13 bytes each fill one


def test_passes_read_numbers_of_frequent_words_alone(spark):
    rows = [(f"red car rare{i} rare{i}x, red rare{i}y", "en") for i in range(20)] + [("red car", "de")] * 4
    words, shards = numbered(token_shards(frame(spark, rows), shard_bytes=300), 5)
    key = {r.phrase: int.from_bytes(r.key, "big") for r in words.collect()}
    assert sorted((r.lang, r.phrase, r.f) for r in words.collect()) == [("en", "car", 20), ("en", "red", 40)]
    said = []
    for r in shards.collect():
        ids = np.frombuffer(r.ids, "<i8").tolist()
        assert sorted(ids) == sorted(key.values())
        said += "".join({0: ".", key["red"]: "r", key["car"]: "c"}[ids[c - 1] if c else 0] for c in np.frombuffer(r.codes, "<i4").tolist()).split(".")
    assert sorted(filter(None, said)) == ["r"] * 20 + ["rc"] * 20


def test_buckets_grow_with_the_text():
    assert bucket_bits(10) == bucket_bits(1000) and 2 ** bucket_bits(10**12) >= 10**12 // 2


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3), st.sampled_from([2, 300, 70000, 20_000_000]), st.integers(0, 400), st.integers(0, 2**32))
def test_trie_knows_its_phrases_alone(depth, words, m, seed):
    rng = np.random.default_rng(seed)
    rows = np.unique(np.minimum((rng.pareto(0.5, (m, depth)) * 3).astype(np.int64), words - 1), axis=0) if m else np.zeros((0, depth), np.int64)
    trie, known = build(rows, words), {tuple(r): i for i, r in enumerate(rows.tolist())}
    asked = np.concatenate([rows, rng.integers(-1, words, (200, depth))])
    state = np.ones(len(asked), np.int64)
    for k in range(depth):
        state = trie.step(state, asked[:, k])
    assert np.where(state > 0, trie.leaf[state], -1).tolist() == [known.get(tuple(r), -1) for r in asked.tolist()]
