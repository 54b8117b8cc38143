import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.common import written
from tessera.llm.packing import _dominates, fillings, lower_bound, pack, pack_documents, pieces, plan
from tessera.llm.queries_op3 import op3_best_fit_packing
from tessera.llm.word_tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)
ODD = ["", " ", "a\nb", "It's  WE'LL 12 3!!", "é É ß İ ſ", "<|endoftext|> x<|startoftext|>y", "\t   z", "é ́ x", "###%%% don't", "x" * 5000, "ΑΣ Σ ς", "\x1c\x85q", "日本 語", "word, word. " * 3000, "<|endoftext|"]


@pytest.mark.parametrize("room", [3, 10**6])
def test_ids(room):
    encoder = WordEncoder(PATH, room)
    assert encoder.by_word
    for text, data in zip(ODD, encoder.encode(ODD)):
        assert np.frombuffer(data, "<u4").tolist() == TOK.encode(text, add_special_tokens=False).ids
    assert not WordEncoder(public_tokenizers.path("byte_bpe_50k.json")).by_word


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sS \n\t.é́<|>1İ"), max_size=25))
def test_any_text(text):
    data = WordEncoder.encode(ENC, [text])[0]
    assert np.frombuffer(data, "<u4").tolist() == TOK.encode(text, add_special_tokens=False).ids


ENC = WordEncoder(PATH)


def check_plan(counts, capacity):
    made = plan(np.array(counts), capacity)
    used = np.zeros(len(counts), int)
    for items, times in made:
        assert sum(items) <= capacity
        for k in items:
            used[k] += times
    assert used.tolist() == list(counts)
    return sum(n for _, n in made)


def fewest(lengths, capacity):
    """Bins of an optimal packing, by trying all."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_plan_is_optimal_on_small_inputs(lengths):
    counts = np.bincount(lengths, minlength=21) if lengths else np.zeros(21, int)
    n = check_plan(counts, 20)
    assert lower_bound(counts, 20) <= fewest(sorted(lengths, reverse=True), 20) == n


@pytest.mark.parametrize("lengths", [[40, 39, 38, 36, 34, 31, 29, 27, 26], [30, 30, 30, 25, 25, 25, 45, 45, 45]])
def test_no_filling_is_left_out(lengths):
    assert check_plan(np.bincount(lengths, minlength=101), 100) == fewest(lengths, 100) == 3


def test_fillings():
    rng = np.random.default_rng(3)
    for _ in range(100):
        lengths, room = rng.integers(1, 16, 6).tolist(), int(rng.integers(1, 40))
        found = [x for x in fillings(np.bincount(lengths, minlength=41), room) if x is not None]
        assert [sum(x) for x in found] == sorted((sum(x) for x in found), reverse=True)
        assert not any(_dominates(a, b) for a in found for b in found if a is not b)
        every = {tuple(sorted(c, reverse=True)) for n in range(7) for c in combinations(lengths, n) if sum(c) <= room}
        assert set(found) <= every and all(any(_dominates(a, b) for a in found) for b in every)


def test_plan_of_many():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.clip(rng.lognormal(6, 1, 100_000).astype(int), 1, 2047), minlength=2049)
    assert check_plan(counts, 2048) <= lower_bound(counts, 2048) * 1.001 + 1
    assert check_plan([0] * 1500 + [7] + [0] * 548, 2048) == 7
    assert check_plan([0, 10**9] + [0] * 2047, 2048) == -(-(10**9) // 2048)


def check_packing(rows, texts, capacity=2048):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert by_doc.keys() == texts.keys()
    for doc, text in texts.items():
        ids = np.array([*TOK.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc]) == want
    return len(by_seq)


def test_odd_rows(spark):
    rows = [(i, t, 9) for i, t in enumerate(ODD)] + [(100, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    check_packing(pack_documents(df, PATH).collect(), {i: t for i, t, _ in rows})
    assert pack_documents(df.limit(0), PATH).collect() == []
    twice = pack_documents(df.limit(2).union(df.limit(2)), PATH).collect()
    assert len(twice) == 4 and len({(r.sequence_id, r.offset) for r in twice}) == 4


def test_hot_length(spark):
    df = spark.createDataFrame([(i, "same words here") for i in range(3000)] + [(-i, "w " * i) for i in range(1, 300)], "doc_id long, text string")
    made = written(pieces(df, PATH), "pieces")
    packed = pack(made, rows_per_salt=50).collect()
    assert len(packed) == 3299
    total = sum(r.length for r in packed)
    assert len({r.sequence_id for r in packed}) <= -(-total // 2048) + 1


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op3_best_fit_packing(spark, sf_dir).collect()
    n = check_packing(rows, texts)
    counts = np.bincount([r.length for r in rows], minlength=2049)
    assert n <= lower_bound(counts, 2048) + 1
