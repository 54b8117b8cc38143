"""Alignment of two tokenizers against a brute-force version on whole texts, and its coalescing against byte offsets."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.queries_op13 import op13_cross_tokenizer_alignment
from tessera.llm.token_alignment import Aligner, align, alignments, byte_level_alphabet, coalesce

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", "The quick brown fox.", "The quick brown fox.", "  lead and  double   spaces ", "tabs\tand\nnew\n\nlines \n x", "<|endoftext|> <s> </s> <unk> <0x41>", "▁mark", "a ▁ b", "éàü 日本語 😀 é",
    "\x00nul", "a\x00b", " nbsp  x", "don't we'll I'M", "x" * 3000, "word " * 3000, "﻿bom", "　wide  sep", "trail ", "a\x1c b \x85c", "12345 67,89", "\r\n", "​ zero", "Ünïcödé " * 5,
]


def brute(texts):
    """Per text, by whole texts, byte sets and plain loops."""
    a, b, alphabet = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_level_alphabet()
    a.encode_special_tokens = True
    a_vocab = {i: t for t, i in a.get_vocab().items()}
    made = []
    for text in texts:
        want = b" " + (text or "").encode()
        ia, ib = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        ta = [bytes(alphabet[c] for c in a_vocab[i]) for i in ia]
        tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not text or b"".join(ta) != want or b"".join(tb) != want:
            made.append(None)
            continue
        ends = [set(np.cumsum([len(t) for t in x]).tolist()) for x in (ta, tb)]
        groups, at, cuts = [], [0, 0], sorted(ends[0] & ends[1])
        places = [np.cumsum([len(t) for t in x]).tolist() for x in (ta, tb)]
        for cut in cuts:
            part = []
            for k, ids in enumerate((ia, ib)):
                stop = places[k].index(cut) + 1
                part.append(ids[at[k] : stop])
                at[k] = stop
            groups.append(part)
        made.append((ia, ib, groups))
    docs = Counter(p for m in made if m for p in {(x, y) for g in m[2] for x in g[0] for y in g[1]})
    top: dict = {}
    for (x, _), n in docs.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for m in made:
        if not m:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for g in m[2] for x in g[0] for y in g[1]]
        said = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in m[2])
        out.append((len(m[0]), len(m[1]), len(m[2]), len(links), sum(docs[p] == top[p[0]] for p in links), sum(docs[p] for p in links), hashlib.sha256(said.encode()).hexdigest()))
    return out


def got(df):
    return {r.doc_id: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()}


@pytest.mark.parametrize("few", [10**6, 0])
def test_odd_texts_equal_brute_force(spark, few):
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(ODD)], "doc_id long, text string, n_a long, pair string").repartition(3)
    assert got(alignments(docs, A, B, few=few, shard_bytes=2000)) == dict(enumerate(brute(ODD)))


def test_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert got(op13_cross_tokenizer_alignment(spark, sf_dir)) == dict(zip([r.doc_id for r in rows], brute([r.text for r in rows])))


def test_rows_repeat_ids_may_lack_and_tables_may_be_empty(spark):
    kind = "doc_id long, text string"
    found = alignments(spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "same text")], kind), A, B).collect()
    assert [r.count_sum for r in found] == [3 * r.n_links for r in found] and sorted(str(r.doc_id) for r in found) == ["1", "1", "None"]
    assert alignments(spark.createDataFrame([], kind), A, B).count() == 0


def cut():
    """Where neither tokenizer joins bytes, as a pattern."""
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    pieces, letters = [b.id_to_piece(i) for i in range(b.get_piece_size())], "A-Za-zÀ-ÖØ-öø-ÿ"
    marks = "".join(m for m in ".,;:!?|" if not any(re.search(f"[{letters}][{m}]", p) for p in pieces))
    space = " " if any("\n" in p for p in pieces) else " \n"
    return re.compile(rf"(?<=\S)(?=[{space}]\S)" + (f"|(?<=[{letters}])(?=[{marks}])" if marks else ""))


CUT = cut()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\x1c\x85\u00a0\u2028\u3000\u3001.,;:!?|aZé×ß日😀0'", min_size=1, max_size=25), min_size=1, max_size=4))
def test_chunks_lie_between_the_cuts(texts):
    chunks, places, n_of = Aligner(A, B).chunks(texts)
    found = np.split(np.array(chunks, object)[places], np.cumsum(n_of)[:-1])
    assert [x.tolist() for x in found] == [CUT.split(" " + t) for t in texts]


def test_rows_and_row_groups_stay_small_whatever_a_task_reads(spark):
    chance = random.Random(7)
    words = ["".join(chance.choices("abcdefghijklmnopqrstuvwxyz", k=chance.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(chance.choices(words, k=400)) for _ in range(3600)] + ["many words said again " * 60_000]
    shards = align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), A, B)
    (file,) = [f.removeprefix("file://") for f in shards.inputFiles()]
    groups = pq.ParquetFile(file).metadata
    assert groups.num_row_groups > 1 and max(groups.row_group(i).total_byte_size for i in range(groups.num_row_groups)) < 5 << 20
    rows = pq.read_table(file).to_pylist()
    said = {r["docs"][-1]: sum(len(x) for x in r.values() if isinstance(x, bytes)) for r in rows}
    assert sorted(i for r in rows for i in r["docs"]) == list(range(3601)) and max(said.values()) < 400_000
    assert said[3600] < 1000  # a long text's row grows with its distinct pairs only


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.randoms())
def test_groups_end_where_both_end(sizes, random):
    a = np.cumsum(sizes)
    inner = sorted(random.sample(range(1, int(a[-1])), random.randint(0, int(a[-1]) - 1))) if a[-1] > 1 else []
    b = np.array([*inner, a[-1]])
    ga, gb = coalesce(np.concatenate([[0], a[:-1]]), a, np.concatenate([[0], b[:-1]]), b)
    both = sorted(set(a.tolist()) & set(b.tolist()))
    assert ga.tolist() == np.searchsorted(both, a).tolist() and gb.tolist() == np.searchsorted(both, b).tolist()
