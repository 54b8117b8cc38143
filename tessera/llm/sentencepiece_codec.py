"""Offset-preserving SentencePiece encoding and decoding.

Normalisation takes the longest prefix that the model's compiled character map knows (a double-array trie in front of zero-ended replacements) and
records for every normalised byte the source byte it came from. The normalised text, not the source, is cut into pieces, and every piece is projected
through that record to a byte range of the source. With a model whose map is empty (each character is its own longest prefix), whose normalisation
only marks spaces, and no piece of which holds a space mark after another character, this is done word by word with a bounded cache: merges cannot
cross a word's start there, so the ids are those of the whole text.

Defined results: null text is the empty text; an empty text has only the begin and end ids; repeated rows give repeated rows; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memo import Memo

MARK = "▁"
_WORDS = re.compile(r" +[^ ]*")


class CharacterMap:
    """The compiled character map of a model: little-endian trie size, trie units, replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """(length, place of the replacement) of the longest known prefix of data[at:]; length 0 if none."""
        if not self.units:
            return 0, 0
        step = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node, best = step(self.units[0]), (0, 0)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[i]:
                break
            unit = self.units[node]
            node ^= step(unit)
            if unit >> 8 & 1:
                best = i + 1 - at, self.units[node] & 0x7FFFFFFF
        return best

    def replacement(self, place: int) -> bytes:
        return self.replacements[place : self.replacements.index(b"\0", place)]


def _width(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


def normalise(data: bytes, chars: CharacterMap, dummy_prefix: bool, squeeze: bool, escape: bool) -> tuple[bytes, list[int]]:
    """Normalised bytes, and for each of them (and for the end) the source byte it starts from."""
    out, source, at = bytearray(), [], 0
    space = MARK.encode() if escape else b" "

    def put(piece: bytes, place: int) -> None:
        for byte in piece:
            for b in space if byte == 0x20 else bytes([byte]):
                out.append(b)
                source.append(place)

    started = last_space = False
    while at < len(data):
        length, place = chars.longest(data, at)
        got = chars.replacement(place) if length else data[at : at + _width(data[at])]
        length = length or _width(data[at])
        if squeeze and not started and got == b" ":  # spaces at the head
            at += length
            continue
        if not started and dummy_prefix:
            put(b" ", at)
        if squeeze and (last_space or not started):
            got = got.lstrip(b" ")
        started = True
        if got:
            put(got, at)
            last_space = got.endswith(b" ")
        at += length
    if squeeze:
        while out.endswith(space):
            del out[-len(space) :], source[-len(space) :]
    source.append(len(data))
    return bytes(out), source


def mark_words(words: list[str]) -> tuple[list[str], Callable[[np.ndarray], np.ndarray]]:
    """``normalise`` with an empty map for many words, each with the space before it: every character is its own longest prefix, so only the space grows, to
    the three bytes of the mark; and the source byte of a place in a normalised word."""
    return [MARK + w for w in words], lambda place: np.maximum(place - 2, 0)


class Codec:
    """Encoder and decoder of one model (a path, or the model itself); made once in each task."""

    def __init__(self, model: str | bytes, room: int = 200_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(**{"model_file" if isinstance(model, str) else "model_proto": model})
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.sp.serialized_model_proto())
        spec = proto.normalizer_spec
        self.chars = CharacterMap(spec.precompiled_charsmap)
        self.spec = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        own = {p.type for p in proto.pieces} <= {1, 2, 3, 6}
        self.by_word = not self.chars.units and self.spec == (True, False, True) and own and not any(MARK in p.piece.lstrip(MARK) for p in proto.pieces)
        self.size = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces], np.int64)  # normalised bytes of a piece
        spec.precompiled_charsmap, spec.name = b"", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())  # cuts what is normalised already
        self.memo = Memo(room)
        self.edge = self.sp.bos_id(), self.sp.eos_id()

    def _project(self, ids: list[int], normal: str, source: list[int]) -> np.ndarray:
        """Where each piece of a normalised text ends in its source."""
        ends = np.cumsum(self.size[ids])
        if len(ids) and ends[-1] != len(source) - 1:  # unknown pieces: by their surfaces
            ends = np.cumsum([1 if self.sp.is_byte(i) else len(p.encode()) for p, i in zip(self.pieces.encode(normal, out_type=str), ids, strict=True)])
        return np.array(source, np.int64)[ends]

    def _words(self, text: str) -> np.ndarray:
        """(id, source bytes) of each piece; each word is normalised with the space before it."""
        if not text:
            return np.zeros((0, 2), np.uint32)
        plain = "  " not in text and text[0] != " " and text[-1] != " "
        words = text.split(" ") if plain else [w[1:] for w in _WORDS.findall(" " + text)]
        new = self.memo.missing(set(words))
        if new:
            self._learn(new)
        out = np.frombuffer(b"".join(map(self.memo.young.__getitem__, words)), np.uint32).reshape(-1, 2)
        self.memo.turn()
        return out

    def _learn(self, words: list[str]) -> None:
        """Put the (id, source bytes) of new words, each with the space before it, into the cache."""
        for word in [w for w in words if " " in w]:  # one after further spaces
            normal, source = normalise(b" " + word.encode(), self.chars, False, *self.spec[1:])
            ids = self.pieces.encode(normal.decode())
            self.memo.young[word] = np.array([ids, np.diff(self._project(ids, normal.decode(), source), prepend=0)], np.uint32).T.tobytes()
        words = [w for w in words if " " not in w]
        normal, source = mark_words(words)
        ids = self.pieces.encode(normal, num_threads=1)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum()))
        first = np.cumsum(counts) - counts
        ends = np.cumsum(self.size[flat])
        ends -= np.repeat(np.concatenate([[0], ends])[first], counts)  # within each word's normalised bytes
        ends = source(ends)
        starts = np.concatenate([[0], ends[:-1]])
        starts[first[counts > 0]] = 0
        data, cuts = np.stack([flat, ends - starts], 1).astype(np.uint32).tobytes(), (8 * np.append(first, len(flat))).tolist()
        young = self.memo.young
        for word, a, b in zip(words, cuts, cuts[1:]):
            young[word] = data[a:b]
        last = np.where(counts > 0, np.append(ends, 0)[first + counts - 1], 0)
        for k in np.flatnonzero(last != np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words))).tolist():  # unknown pieces: by their surfaces
            _, record = normalise(b" " + words[k].encode(), self.chars, False, *self.spec[1:])
            young[words[k]] = np.array([ids[k], np.diff(self._project(ids[k], normal[k], record), prepend=0)], np.uint32).T.tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with begin and end, and each one's source bytes [start, end)."""
        if self.by_word and MARK not in text:  # a mark in the source acts as a space
            pairs = self._words(text)
            body = pairs[:, 0]
            ends = np.maximum(np.cumsum(pairs[:, 1], dtype=np.int64) - 1, 0)  # the first mark has no source byte
            size = int(ends[-1]) if len(ends) else 0
        else:
            data = text.encode()
            normal, source = normalise(data, self.chars, *self.spec)
            ids = self.pieces.encode(normal.decode())
            size, body, ends = len(data), np.array(ids, np.uint32), self._project(ids, normal.decode(), source)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        wrap = lambda first, mid, last: np.concatenate([[first], mid, [last]])
        return wrap(self.edge[0], body, self.edge[1]).astype("<u4"), wrap(0, starts, size), wrap(0, ends, size)

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def encode(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: its ids with begin and end, and the source bytes of each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [codec.encode(x) for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), *(pa.array([m[i].astype(np.int64) for m in made], pa.list_(pa.int64())) for i in range(3))], names=[key, "ids", "starts", "ends"])

    return _texts(df, key, text).mapInArrow(work, f"{key} long, ids array<long>, starts array<long>, ends array<long>")


def decode(df: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per list of ids: the decoded text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([codec.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=[key, "decoded"])

    return df.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias(ids)).mapInArrow(work, f"{key} long, decoded string")


def digests(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text in one pass; of ids, spans and decoded text only digests leave the task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            n, ids_sha, text_sha, spans = [], [], [], []
            for x in batch.column(1):
                ids, starts, ends = codec.encode(x.as_py())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids.tolist()).encode()).hexdigest())
                spans.append(int((ends - starts).sum()))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha), pa.array(spans, pa.int64())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "span_bytes"])

    return _texts(df, key, text).mapInArrow(work, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long")
