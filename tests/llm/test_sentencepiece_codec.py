import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from tessera.llm.queries_op10 import op10_sentencepiece
from tessera.llm.sentencepiece_codec import CharacterMap, Codec, decode, digests, encode, mark_words, normalise

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "▁", "a▁b ▁", "\n\t x", "😀é́", "12 345", "a\0b", "ﬁ ½", "word " * 5000, "x" * 3000, "​ 　", " \n ", "日本語 テキスト"]
CODEC = Codec(MODEL)
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("text", ODD)
def test_ids_and_spans(text):
    ids, starts, ends = CODEC.encode(text)
    assert ids.tolist() == SP.encode(text, add_bos=True, add_eos=True)
    data = text.encode()
    assert b"".join(data[a:b] for a, b in zip(starts, ends)) == data
    for i, a, b in zip(ids[1:-1].tolist(), starts[1:-1], ends[1:-1]):
        if not SP.is_byte(i) and "▁" not in SP.id_to_piece(i):
            assert data[a:b].decode() == SP.id_to_piece(i)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab ▁\n\t.é😀1"), max_size=30))
def test_any_text(text):
    assert CODEC.encode(text)[0].tolist() == SP.encode(text, add_bos=True, add_eos=True)


def test_words_in_bulk_equal_the_normaliser():
    words = ["", "a", "é", "日本", "x" * 40, "a\tb", "😀é́"]
    normal, source = mark_words(words)
    for w, n in zip(words, normal):
        want, record = normalise(b" " + w.encode(), CharacterMap(b""), False, False, True)
        assert n.encode() == want
        starts = [k for k in range(len(want) + 1) if k == len(want) or want[k] & 0xC0 != 0x80]  # where characters begin
        assert source(np.array(starts)).tolist() == [record[k] for k in starts]


def test_small_cache():
    small = Codec(MODEL, room=3)
    for text in ODD:
        assert small.encode(text)[0].tolist() == SP.encode(text, add_bos=True, add_eos=True)


def trie(words: dict[str, str]) -> bytes:
    """A compiled character map, built here to test its reader: a node's children lie at its base XOR their byte."""
    replacements, places = bytearray(), {}
    for new in words.values():
        places.setdefault(new, len(replacements))
        if places[new] == len(replacements):
            replacements += new.encode() + b"\0"
    tree: dict = {}
    for old, new in words.items():
        node = tree
        for b in old.encode():
            node = node.setdefault(b, {})
        node[-1] = places[new]
    units, used, following = {0: 0}, {0}, [1]

    def place(node: dict, at: int) -> None:
        labels = [0 if b == -1 else b for b in node]
        base = following[0] * 256
        following[0] += 1
        offset = at ^ base
        assert offset < 1 << 21
        units[at] |= offset << 10 | (256 if -1 in node else 0)
        for b in labels:
            used.add(base ^ b)
        for b, child in node.items():
            spot = base ^ max(b, 0)
            units[spot] = child | 1 << 31 if b == -1 else b
        for b, child in node.items():
            if b != -1:
                place(child, base ^ b)

    place(tree, 0)
    array = np.zeros(max(units) + 257 & ~255, "<u4")
    for k, v in units.items():
        array[k] = v
    return array.nbytes.to_bytes(4, "little") + array.tobytes() + bytes(replacements)


def test_character_map_against_the_library():
    words = {"ﬁ": "fi", "½": "1/2", "\t": " ", "　": " ", "é": "é", "éx": "EX", "​": ""}
    for squeeze in (False, True):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(open(MODEL, "rb").read())
        proto.normalizer_spec.precompiled_charsmap = trie(words)
        proto.normalizer_spec.remove_extra_whitespaces = squeeze
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        codec = Codec(proto.SerializeToString())
        assert codec.chars.units and not codec.by_word
        for text in ["ﬁne ½", " a\t\tb ", "céx é", "​", "x　 y  "]:
            got, source = normalise(text.encode(), codec.chars, *codec.spec)
            assert got.decode() == sp.normalize(text)
            ids, starts, ends = codec.encode(text)
            assert ids.tolist() == sp.encode(text, add_bos=True, add_eos=True)
            assert (np.diff(starts[1:-1]) >= 0).all() and (ends >= starts).all() and source[-1] == len(text.encode())


def test_frames(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(99, None, "x"), (1, " ", "again"), (None, "no id", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = encode(df, MODEL)
    texts = {r.doc_id: r.decoded for r in decode(coded, MODEL).collect()}
    found = digests(df, MODEL).collect()
    assert len(found) == len(rows) == coded.count()
    want = sorted(hashlib.sha256(np.array(SP.encode(t or "", add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest() for _, t, _ in rows)
    assert sorted(r.ids_sha256 for r in found) == want
    for i, t in enumerate(ODD):
        assert texts[i] == SP.decode(SP.encode(t, add_bos=True, add_eos=True))
    assert digests(df.limit(0), MODEL).collect() == []


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op10_sentencepiece(spark, sf_dir).collect():
        ids = SP.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(SP.decode(ids).encode()).hexdigest() and r.span_bytes == len(texts[r.doc_id].encode())


def test_the_map_decides_ids_on_the_query_road(spark, tmp_path):
    """A model with a map goes through the same function that the query calls; without the map its ids would differ."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.normalizer_spec.precompiled_charsmap = trie({"q": "the", "qu": "of", "Z": ""})
    path = str(tmp_path / "mapped.model")
    open(path, "wb").write(proto.SerializeToString())
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["q word", "quit q", "Zebra", "plain", "", "ZZ"]
    found = {r.doc_id: r for r in digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t, add_bos=True, add_eos=True)
        assert found[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and found[i].n_tokens == len(ids)
        assert found[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sp.encode("q word") != SP.encode("q word")
    _, starts, ends = Codec(path).encode("quit")
    assert (starts[1], ends[1]) == (0, 2)  # "of" came from "qu"
