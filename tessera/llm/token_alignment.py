"""Alignment of two tokenizers' tokens over the bytes of the same text, and corpus-wide counts of aligned id pairs.

Both tokenizers see a space and the text. Tokens are byte intervals; ``coalesce`` sorts the intervals of A and B by start together, takes the running
maximum of their ends, and begins a group wherever a start reaches that maximum; inside a group every A token is linked with every B token. As neither
tokenizer joins a single space or line end between two other characters to the one before it, nor a letter to a mark like a comma behind it (A splits them
by its pattern, B has no such piece, which is looked up), a text is cut there into chunks; a chunk's groups are worked out once and kept in a task's
bounded cache, many new chunks in one call of each tokenizer.

``align`` writes shards: of some texts their results, their distinct linked pairs, and which of these each text holds how often. A pair's count is the
number of texts that hold it linked; shards count their own texts, and only sums by pair are shuffled. The counts go back to the shards by broadcast where
they are counted to be few, else by a join on the distinct pairs of each shard. A shard is a row: of few texts, and of a long text it grows with the
distinct pairs alone. Files of shards have small pages and row groups, so that what the JVM holds does not depend on how much a task reads or writes.

Defined results: a text that is null or empty, or whose joined A or B bytes differ from space + text, has no tokens (zeros, and '' as digest); repeated
rows are texts of their own, each counted; a row without id keeps its null id; other columns are ignored; an empty table gives no rows. A whole text is
held by one task, in slices of chunks for its digest: about 30 bytes for a byte of the longest text.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .memo import Memo
from .wordcodes import row_slices, strings

MARK, LETTERS = "▁", "A-Za-zÀ-ÖØ-öø-ÿ"
SHARD_BYTES, FEW_PAIRS = 250_000, 2_000_000
_SHARD = "shard long, docs array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs array<long>, pair_docs array<long>, firsts binary, held binary, times binary"
#: Parquet looks at sizes after 100 rows first, unless told; its pages and row groups are held whole by the writer and by the reader.
SMALL_GROUPS = {"parquet.block.size": 4 << 20, "parquet.page.size": 256 << 10, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def give_back() -> None:
    """Return what a task has freed to the system: a worker waits for further tasks beside others of its executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of glibc alone
        ctypes.CDLL(None).malloc_trim(0)


def coalesce(a_starts: np.ndarray, a_ends: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group (from 0) of each A interval and of each B interval."""
    starts, ends = np.concatenate([a_starts, b_starts]), np.concatenate([a_ends, b_ends])
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group[: len(a_starts)], group[len(a_starts) :]


def byte_level_alphabet() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies write: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Ids and bytes of both tokenizers; made once in each task."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        alphabet = byte_level_alphabet()
        spelt = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(alphabet[c] for c in spelt.get(i, "") if c in alphabet) for i in range(max(spelt) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.b.serialized_model_proto())
        self.b_bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        self.a_size, self.b_size = (np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, self.b_bytes))
        spec = proto.normalizer_spec  # chunks stand for themselves if nothing is rewritten and no piece crosses a space
        space = " " if any("\n" in p.piece for p in proto.pieces) else " \n"
        marks = "".join([m for m in ".,;:!?|" if not any(re.search(f"[{LETTERS}][{m}]", p.piece) for p in proto.pieces)])  # no piece joins them to a letter
        every = "".join(map(chr, range(0x3002)))  # no white space beyond U+3000
        self.white, self.space, self.letter, self.mark = (np.isin(np.arange(len(every)), [ord(c) for c in re.findall(p, every)]) for p in (r"\s", f"[{space}]", f"[{LETTERS}]", f"[{marks}]" if marks else r"(?!)"))
        self.by_chunk = not spec.precompiled_charsmap and (spec.add_dummy_prefix, spec.remove_extra_whitespaces) == (True, False) and not any(MARK in p.piece.lstrip(MARK) for p in proto.pieces)

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text that begins with the space both see."""
        return np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64), np.array(self.b.encode(text[1:]), np.int64)

    def spells(self, text: bytes, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the joined bytes of both are the text's."""
        return b"".join([self.a_bytes[i] for i in a.tolist()]) == text and b"".join([self.b_bytes[i] for i in b.tolist()]) == text


@lru_cache(1)
def tokenizers_of(a: str, b: str) -> Tokenizers:
    """Both tokenizers, read once in each worker."""
    return Tokenizers(a, b)


class Aligner:
    """Chunks to (A tokens, B tokens, groups, groups spelt out, linked pairs a << 32 | b); a bounded cache holds them."""

    def __init__(self, a: str, b: str, room: int = 120_000):
        self.of, self.memo, self.odd = tokenizers_of(a, b), Memo(room), False

    def chunks(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct chunks of space + text, each with its leading space or line end; which one stands at each place; the places of each text."""
        of, joined = self.of, "".join([" " + t for t in texts])
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        data = np.frombuffer(joined.encode(), np.uint8)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        cut = np.zeros(len(codes), bool)
        if of.by_chunk:
            kind = np.minimum(codes, len(of.white) - 1)
            solid = ~of.white[kind]
            cut[1:-1] = solid[:-2] & of.space[kind[1:-1]] & solid[2:]
            cut[1:] |= of.letter[kind[:-1]] & of.mark[kind[1:]]
        cut[bounds[:-1]] = True
        starts = np.flatnonzero(cut)
        n_of = np.diff(np.searchsorted(starts, bounds))
        if len(data) > len(codes):
            size = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)  # bytes of each character
            starts = (np.cumsum(size) - size)[starts]
        found = strings(data, np.diff(starts, append=len(data))).dictionary_encode()
        return found.dictionary.to_pylist(), found.indices.to_numpy(), n_of

    def learn(self, chunks: list[str], together: int = 512) -> None:
        for i in range(0, len(chunks), together):
            self._learn(chunks[i : i + together])

    def _learn(self, chunks: list[str]) -> None:
        part = [" a"]  # what is encoded begins with a space, and marks stand behind letters
        for c in chunks:
            part += (c,) if c[:1] in " \n" else (" a", c)
        if self.of.by_chunk and self._keep(part, *self.of.ids("".join(part))):
            return
        if len(chunks) > 1:  # some chunk's tokens don't spell it
            for half in (chunks[: len(chunks) // 2], chunks[len(chunks) // 2 :]):
                self._learn(half)
            return
        (c,) = chunks
        alone = [c] if c[:1] == " " else [" a", c]
        if c == " " or not self._keep(alone, *self.of.ids("".join(alone))):
            self.memo.young[c], self.odd = (), True

    def _keep(self, chunks: list[str], a: np.ndarray, b: np.ndarray) -> bool:
        """Put the groups of chunks that lie one after the other into the cache, if the tokens spell them and break between them."""
        of, data = self.of, [c.encode() for c in chunks]
        a_ends, b_ends, ends = np.cumsum(of.a_size[a]), np.cumsum(of.b_size[b]), np.cumsum(list(map(len, data)))
        if not of.spells(b"".join(data), a, b):
            return False
        ca, cb = np.searchsorted(a_ends, ends) + 1, np.searchsorted(b_ends, ends) + 1
        if not (np.array_equal(a_ends[ca - 1], ends) and np.array_equal(b_ends[cb - 1], ends)):
            return False
        ga, gb = coalesce(a_ends - of.a_size[a], a_ends, b_ends - of.b_size[b], b_ends)
        n = int(ga[-1]) + 1
        na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        per = nb[ga]  # links of each A token: the B tokens of its group
        first_b = np.cumsum(nb) - nb
        take = np.repeat(first_b[ga] - (np.cumsum(per) - per), per) + np.arange(per.sum())
        pairs = (np.repeat(a, per) << 32) | b[take]
        said_a, said_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        cg = ga[ca - 1] + 1
        links = np.concatenate([[0], np.cumsum(per)])[ca]
        fa, fb = np.cumsum(na).tolist(), np.cumsum(nb).tolist()
        spelt, x, y = [], 0, 0
        for p, q in zip(fa, fb):
            spelt.append(f"{','.join(said_a[x:p])}|{','.join(said_b[y:q])}" if p - x > 1 or q - y > 1 else f"{said_a[x]}|{said_b[y]}")
            x, y = p, q
        young, (x, y, g, k) = self.memo.young, (0, 0, 0, 0)
        for c, p, q, h, m in zip(chunks, ca.tolist(), cb.tolist(), cg.tolist(), links.tolist()):
            young[c] = (p - x, q - y, h - g, ";".join(spelt[g:h]), pairs[k:m].tobytes())
            x, y, g, k = p, q, h, m
        return True


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each one's values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    firsts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[firsts], np.add.reduceat(values[order], firsts) if len(firsts) else values[:0]


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _digests(spelt: pa.StringArray, places: np.ndarray, n_places: np.ndarray, together: int = 100_000) -> list[str]:
    """The digest of each text's groups, from those of its chunks; '' without chunks."""
    out, end = [], 0
    for n in n_places.tolist():
        sha, start, end = hashlib.sha256(), end, end + n
        for i in range(start, end, together):
            part = spelt.take(pa.array(places[i : min(i + together, end)]))
            sha.update(b";" if i > start else b"")
            sha.update(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), ";")[0].as_buffer())
        out.append(sha.hexdigest() if n else "")
    return out


def _shard(aligner: Aligner, number: int, ids: list, texts: list[str | None]) -> pa.RecordBatch:
    """Results of some texts, their distinct pairs with the number of these texts that hold each, and each text's pairs with their number of links."""
    memo = aligner.memo
    memo.turn()
    full = [k for k, text in enumerate(texts) if text and MARK not in text]  # B writes that character's bytes as a space
    chunks, places, n_of = aligner.chunks([texts[k] for k in full])
    aligner.learn(memo.missing(set(chunks)))
    known, n_places = list(map(memo.young.__getitem__, chunks)), np.zeros(len(texts), np.int64)
    n_places[full] = n_of
    if aligner.odd and not all(known):  # texts with such chunks have no tokens
        doc = np.repeat(np.arange(len(texts)), n_places)
        n_places[doc[~np.array(list(map(bool, known)))[places]]] = 0
        kinds, places = np.unique(places[n_places[doc] > 0], return_inverse=True)
        known = [known[k] for k in kinds.tolist()]
    shas = _digests(pa.array([k[3] for k in known], pa.string()), places, n_places)
    n = max(len(known), 1)
    held, times = np.unique(np.repeat(np.arange(len(texts)), n_places) * n + places, return_counts=True)
    doc, chunk = np.divmod(held, n)
    counts = np.array([(k[0], k[1], k[2], len(k[4]) // 8) for k in known], np.int64).reshape(-1, 4)
    sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(counts[chunk] * times[:, None], axis=0)])
    totals = np.diff(sums[np.searchsorted(doc, np.arange(len(texts) + 1))], axis=0)
    pairs, links = np.unique(np.frombuffer(b"".join([k[4] for k in known]), np.int64), return_inverse=True)
    per = counts[chunk, 3]  # links of each chunk of a text
    at = np.repeat(np.cumsum(counts[:, 3])[chunk] - np.cumsum(per), per) + np.arange(per.sum())
    key, times = _summed(np.repeat(doc, per) * max(len(pairs), 1) + links[at], np.repeat(times, per))
    doc, held = np.divmod(key, max(len(pairs), 1))
    firsts = np.searchsorted(doc, np.arange(len(texts) + 1))
    lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (*totals.T, pairs, np.bincount(held, minlength=len(pairs)))]
    raw = [pa.array([x], pa.binary()) for x in (firsts.astype(np.int64).tobytes(), _narrow(held), _narrow(times))]
    return pa.record_batch([pa.array([number]), pa.array([ids], pa.list_(pa.int64())), *lists[:4], pa.array([shas], pa.list_(pa.string())), *lists[4:], *raw], names=[f.split()[0] for f in _SHARD.split(", ")])


def align(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The shards of all texts, written to the shared folder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner(a, b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j in row_slices(batch.column(1), shard_bytes):
                part = batch.slice(i, j - i)
                yield _shard(aligner, number, part.column(0).to_pylist(), part.column(1).to_pylist())
                number += 1
        del aligner, batches
        give_back()

    return written(docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)).mapInArrow(work, _SHARD), "aligned", SMALL_GROUPS)


def pair_counts(shards: DataFrame) -> DataFrame:
    """Rows (pair, docs, best): the texts that hold each pair linked, and whether no other pair of its A id is in more. pair is a << 32 | b."""
    counts = shards.select(F.inline(F.arrays_zip("pairs", "pair_docs")).alias("pair", "docs")).groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = written(counts.withColumn("a", F.shiftright("pair", 32)), "pairs")
    top = counts.groupBy("a").agg(F.max("docs").alias("top"))
    return counts.join(top, "a").select("pair", "docs", (F.col("docs") == F.col("top")).alias("best"))


def _scored(row: pa.RecordBatch, docs: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of counts, best links) of each text of a shard, from those of its distinct pairs."""
    firsts, held, times = (row.column(name)[0].as_buffer() for name in ("firsts", "held", "times"))
    firsts = np.frombuffer(firsts, np.int64)
    held, times = (np.frombuffer(x, f"u{x.size // max(int(firsts[-1]), 1) or 1}") for x in (held, times))
    total, n_best = (np.diff(np.concatenate([[0], np.cumsum(value[held] * times.astype(np.int64))])[firsts]) for value in (docs, best))
    return total, n_best


def alignments(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", few: int = FEW_PAIRS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per text: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    shards = align(docs, a, b, key, text, shard_bytes)
    counts = written(pair_counts(shards), "pair-counts")
    spark, names = docs.sparkSession, ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = f"{key} long, " + ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'long'}" for n in names)

    def rows(row: pa.RecordBatch, docs: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
        total, n_best = _scored(row, docs, best)
        got = lambda name: row.column(name)[0].values
        return pa.record_batch([got("docs"), *(got(n) for n in names[:4]), pa.array(n_best), pa.array(total), got("groups_sha256")], names=[key, *names])

    if counts.count() <= few:
        found = counts.toArrow()
        order = np.argsort(found.column("pair").to_numpy())
        held = spark.sparkContext.broadcast([found.column(c).to_numpy()[order] for c in ("pair", "docs", "best")])

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, docs, best = held.value
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    at = np.searchsorted(pair, row.column("pairs")[0].values.to_numpy())
                    yield rows(row, docs[at], best[at])

        return shards.drop("shard", "pair_docs").mapInArrow(look_up, schema)

    asked = shards.select("shard", F.explode("pairs").alias("pair"))
    told = asked.join(counts, "pair").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("pair", "docs", "best"))).alias("told"))  # of one shard's distinct pairs
    told = told.select("shard", F.col("told.docs").alias("told_docs"), F.col("told.best").alias("told_best"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                docs, best = (np.array(row.column(c)[0].as_py() or [], kind) for c, kind in (("told_docs", np.int64), ("told_best", bool)))
                yield rows(row, docs, best)

    return shards.drop("pairs", "pair_docs").join(told, "shard", "left").drop("shard").mapInArrow(joined, schema)
