"""Distributed positional inverted index, and exact phrase and proximity search of a test set in it.

``build_index`` writes the postings of every word of the training texts once. A task cuts its texts into shards of a few megabytes and writes, shard by
shard, one row per term: how often it stands there, and its ascending positions. Positions run through a shard's texts one after the other with a gap
between two texts that no search window spans, so a position says the text as well. A frequent term is spread over all shards, and no row is larger than
a shard.

``find`` asks for windows of words of a test set. Corpus-wide counts of the test words (two small columns are read for them) order the words of each
window from the rarest; the postings of test words alone are gathered by shard, where the list of each window's rarest word, less that word's offset in
the window, is intersected with the offset-adjusted lists of the next rarest, and so on until the window is sure or out. Equal windows are searched once
for all items that hold them. The test set goes to the tasks in blocks of items of bounded size, so its size is not bounded by a task's memory.

Defined results: null and empty texts have no words, so an item without words is no window and a document without words is never hit; repeated rows, of
documents or of items, are rows of their own (equal item ids of different texts count as one item); a document without id is answered under a null id;
other columns are ignored; empty tables give no windows and no hits. A whole text is one shard's part, so a task holds about 60 bytes for a byte of its
longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .wordcodes import byte_class, row_slices, words_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
SHARD_BYTES, GAP, FEW_TERMS = 8_000_000, 1024, 500_000
INDEX = "shard long, term string, n long, places binary, docs array<long>"


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", word: str = WORD, gap: int = GAP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all texts, written to the shared folder.

    Rows (shard, term, n, places): the n ascending positions of a term in a shard, as 32-bit steps. The row without term holds the shard's texts: their ids,
    and in ``places`` the steps between the positions at which they begin and, last, at which one more would; its n is the gap."""
    inside = byte_class(word)
    names = ["shard", "term", "n", "places", "docs"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in row_slices(batch.column(1), shard_bytes):
                part = batch.slice(a, b - a)
                found = words_of(part.column(1), inside)
                places = np.arange(len(found.codes)) + np.repeat(np.arange(len(part)) * gap, found.counts)
                n = np.bincount(found.codes, minlength=len(found.dictionary)).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(n)])
                steps = np.diff(places[np.argsort(found.codes, kind="stable")], prepend=0)
                steps[ends[1:-1]] += np.cumsum(np.add.reduceat(steps, ends[:-1]))[:-1] if len(n) > 1 else 0  # a list's first step is from 0
                lists = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends * 4), pa.py_buffer(steps.astype("<i4"))]).cast(pa.binary())
                yield pa.record_batch([pa.array(np.full(len(n), shard)), found.dictionary.cast(pa.string()), pa.array(n), lists, pa.nulls(len(n), pa.list_(pa.int64()))], names=names)
                top = np.concatenate([[0], found.counts + gap]).astype("<i4").tobytes()
                ids = pa.array([part.column(0).to_pylist()], pa.list_(pa.int64()))
                yield pa.record_batch([pa.array([shard]), pa.nulls(1, pa.string()), pa.array([gap]), pa.array([top]), ids], names=names)
                shard += 1

    return written(docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)).mapInArrow(work, INDEX), "positions")


def windows_of(items: DataFrame, width: int, key: str = "item_id", text: str = "text", word: str = WORD) -> DataFrame:
    """Rows (window, item): the distinct windows of ``width`` words of every item; an item of fewer words, but not none, is one window."""
    cut = word.replace("[^", "[", 1) + "+"
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, cut), lambda x: x != "")
    held = items.select(F.col(key).cast("string").alias("item"), words.alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1))
    return held.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, width))).alias("window")).distinct()


def _plan(index: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per distinct window that can occur: its words by their corpus-wide counts, rarest first, and the items that hold it."""
    asked = windows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    terms = written(windows.select(F.explode("window").alias("term")).distinct(), "terms")
    terms = F.broadcast(terms) if terms.count() <= FEW_TERMS else terms
    counts = index.filter("term is not null").select("term", "n").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("total"))
    words = asked.select("window", "items", F.posexplode("window").alias("at", "term")).join(counts, "term", "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("total", F.lit(0)).alias("total"), "at", "term")))
    return words.groupBy("window").agg(order.alias("words"), F.first("items").alias("items")).filter("words[0].total > 0")


class _Windows:
    """A block of windows as arrays, words of each from the rarest."""

    def __init__(self, rows: list[tuple[list[tuple[str, int]], list[str]]]):
        self.items = [items for _, items in rows]
        self.terms = sorted({t for words, _ in rows for t, _ in words})
        self.number = {t: i for i, t in enumerate(self.terms)}
        self.size = np.array([len(words) for words, _ in rows], np.int64)
        width = int(self.size.max(initial=1))
        self.term, self.at = np.full((len(rows), width), -1, np.int64), np.zeros((len(rows), width), np.int64)
        for i, (words, _) in enumerate(rows):
            self.term[i, : len(words)] = [self.number[t] for t, _ in words]
            self.at[i, : len(words)] = [p for _, p in words]


class _Lists:
    """The posting lists of some terms of one shard as one ascending array of (term, position)."""

    BITS = 40  # of a position; a shard's texts have fewer words

    def __init__(self, terms: np.ndarray, steps: list[bytes]):
        order = np.argsort(terms)
        flat = np.frombuffer(b"".join([steps[i] for i in order.tolist()]), "<i4").astype(np.int64)
        n = np.array([len(p) // 4 for p in steps], np.int64)[order]
        run = np.cumsum(flat)
        self.places = run - np.repeat(np.concatenate([[0], run])[np.cumsum(n) - n], n)
        self.keys = (np.repeat(terms[order], n) << self.BITS) | self.places

    def of(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each term's list begins and how long it is."""
        a = np.searchsorted(self.keys, term << self.BITS)
        return a, np.searchsorted(self.keys, (term + 1) << self.BITS) - a

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each term stands at its place."""
        key = (term << self.BITS) | np.maximum(place, 0)
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return (self.keys[at] == key) & (place >= 0) if len(self.keys) else np.zeros(len(key), bool)

    def after(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place of each term at or after its place; a very large one if there is none."""
        at = np.searchsorted(self.keys, (term << self.BITS) | np.maximum(place, 0))
        key = self.keys[np.minimum(at, max(len(self.keys) - 1, 0))] if len(self.keys) else np.zeros(len(at), np.int64)
        return np.where((at < len(self.keys)) & (key >> self.BITS == term), key & ((1 << self.BITS) - 1), 1 << self.BITS)


def _starts(lists: _Lists, asked: _Windows, room: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, position of its rarest word) in ascending windows, in portions of about ``room`` rows."""
    first, n = lists.of(asked.term[:, 0])
    ids = np.flatnonzero(n)
    cuts = np.flatnonzero(np.diff(np.cumsum(n[ids]) // room, prepend=0))
    for part in np.split(ids, cuts):
        if len(part):
            begins, m = first[part], n[part]
            yield np.repeat(part, m), lists.places[np.repeat(begins - (np.cumsum(m) - m), m) + np.arange(m.sum())]


def phrases_in(lists: _Lists, asked: _Windows, room: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(window, first position) of every occurrence: offset-adjusted lists, intersected from the rarest word."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for window, place in _starts(lists, asked, room):
        start = place - asked.at[window, 0]
        for k in range(1, asked.term.shape[1]):
            term = asked.term[window, k]
            keep = (term < 0) | lists.has(term, start + asked.at[window, k])
            window, start = window[keep], start[keep]
        out.append((window, start))
    return tuple(np.concatenate(x) for x in zip(*out))


def near_in(lists: _Lists, asked: _Windows, slop: int, room: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """(window, first position) of every run of (words of the window + slop) words that holds all its distinct words in any order and begins with one."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for window, place in _starts(lists, asked, room):
        span = asked.size[window] + slop
        for back in range(int(span.max(initial=0))):
            w, start, reach = window[span > back], place[span > back] - back, span[span > back]
            begins = np.zeros(len(w), bool)
            for k in range(asked.term.shape[1]):
                term = asked.term[w, k]
                found = lists.after(np.maximum(term, 0), start)
                keep = (term < 0) | (found < start + reach)
                begins |= (term >= 0) & (found == start)
                w, start, reach, begins = w[keep], start[keep], reach[keep], begins[keep]
            out.append((w[begins & (start >= 0)], start[begins & (start >= 0)]))
    both = np.unique(np.stack([np.concatenate(x) for x in zip(*out)], 1), axis=0)
    return both[:, 0], both[:, 1]


def _blocks(plan: DataFrame, block: int) -> Iterator[list]:
    """The planned windows in blocks of about ``block``, one at a time."""
    full = written(plan, "windows")
    of = max(1, -(-full.count() // block))
    for k in range(of):
        part = full if of == 1 else full.filter(F.pmod(F.xxhash64("window"), F.lit(of)) == k)
        yield [([(w.term, w.at) for w in r.words], r["items"]) for r in part.select("words", "items").collect()]


def find(index: DataFrame, items: DataFrame, width: int, summarise: Callable, schema: str, slop: int | None = None, key: str = "item_id", text: str = "text", word: str = WORD, block: int = 50_000) -> tuple[DataFrame, int]:
    """``summarise(shard, ids, starts, gap, asked, window, start)`` of each shard and block of the test set: an Arrow table of ``schema`` from the shard's
    texts (ids and where they begin), the windows asked for, and (window, first position) of every match - exact ones, or with ``slop`` those within that
    many further words in any order. Shards without a test word are given too. And the number of blocks."""
    spark, out, blocks = index.sparkSession, None, 0

    def searcher(held):
        def work(group):  # the rows of a shard
            asked, terms, places = held.value, group.column("term").to_pylist(), group.column("places").to_pylist()
            head = terms.index(None)
            gap, ids, starts = group.column("n")[head].as_py(), group.column("docs")[head].as_py(), np.cumsum(np.frombuffer(places[head], "<i4"), dtype=np.int64)
            if width + (slop or 0) > gap:
                raise ValueError(f"a window of {width + (slop or 0)} words needs an index with as large a gap between texts, not {gap}")
            lists = _Lists(np.array([asked.number[t] for t in terms if t is not None], np.int64), [p for p, t in zip(places, terms) if t is not None])
            window, start = phrases_in(lists, asked) if slop is None else near_in(lists, asked, slop)
            return summarise(group.column("shard")[0].as_py(), ids, starts, gap, asked, window, start)

        return work

    top = index.filter("term is null").select("shard", "term", "n", "places", "docs")
    for rows in _blocks(_plan(index, windows_of(items, width, key, text, word)), block):
        asked = _Windows(rows)
        held, terms = spark.sparkContext.broadcast(asked), spark.createDataFrame([(t,) for t in asked.terms], "term string")
        mine = index.join(F.broadcast(terms), "term", "left_semi").select(*top.columns).unionByName(top)  # terms of one block

        part = mine.groupBy("shard").applyInArrow(searcher(held), schema)
        out, blocks = (part if out is None else out.unionByName(part)), blocks + 1
    return out, blocks


def matches(index: DataFrame, items: DataFrame, width: int, slop: int | None = None, **how) -> DataFrame:
    """One row per document, item and start: a window of the item begins at that word of the document (from 0); exact windows have ``length`` words, near ones
    lie within as many."""

    def rows(shard, ids, starts, gap, asked, window, start):
        doc = np.searchsorted(starts, start, side="right") - 1
        take = np.repeat(np.arange(len(window)), [len(asked.items[w]) for w in window.tolist()])
        items = [i for w in window.tolist() for i in asked.items[w]]
        found = {"shard": pa.array(np.full(len(take), shard)), "place": pa.array(doc[take]), "doc_id": pa.array([ids[d] for d in doc[take].tolist()], pa.int64()), "item_id": pa.array(items, pa.string())}
        return pa.table(found | {"start": pa.array((start - starts[doc])[take]), "length": pa.array(asked.size[window][take] + (slop or 0))})

    found, _ = find(index, items, width, rows, "shard long, place long, doc_id long, item_id string, start long, length long", slop, **how)
    return found.distinct().drop("shard", "place")


def contamination(index: DataFrame, items: DataFrame, width: int, **how) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (its words inside any occurrence of a window), item_ids (sorted; of the items with such windows)."""
    def rows(shard, ids, starts, gap, asked, window, start):
        doc = np.searchsorted(starts, start, side="right") - 1
        hits: list[dict] = [[] for _ in ids]
        held: list[set] = [set() for _ in ids]
        for d, a, n in np.unique(np.stack([doc, start - starts[doc], asked.size[window]], 1), axis=0).tolist():
            if hits[d] and a <= hits[d][-1]["b"]:
                hits[d][-1]["b"] = max(hits[d][-1]["b"], a + n)
            else:
                hits[d].append({"a": a, "b": a + n})
        for d, w in np.unique(np.stack([doc, window], 1), axis=0).tolist():
            held[d].update(asked.items[w])
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        columns = [pa.array(np.full(len(ids), shard)), pa.array(np.arange(len(ids))), pa.array(ids, pa.int64()), pa.array(np.diff(starts) - gap), pa.array(hits, kind), pa.array([sorted(x) for x in held], pa.list_(pa.string()))]
        return pa.table(columns, names=["shard", "place", "doc_id", "n_words", "spans", "item_ids"])

    found, blocks = find(index, items, width, rows, "shard long, place long, doc_id long, n_words long, spans array<struct<a: long, b: long>>, item_ids array<string>", None, **how)
    if blocks > 1:  # what several blocks hit in a document
        several = F.flatten(F.collect_list("spans")), F.flatten(F.collect_list("item_ids"))
        found = found.groupBy("shard", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.sort_array(several[0]).alias("spans"), F.array_sort(F.array_distinct(several[1])).alias("item_ids"))
    n_hit = F.expr("aggregate(spans, struct(0L as n, 0L as reach), (x, s) -> struct(x.n + greatest(0L, s.b - greatest(s.a, x.reach)) as n, greatest(x.reach, s.b) as reach), x -> x.n)")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "item_ids")
