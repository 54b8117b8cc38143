"""Phrase collocation mining: Apriori levels counted with broadcast double-array tries.

Texts are cut into pieces and words once and written as shards of one language each: a dictionary of words, and codes in which 0 ends a piece. Words are
counted from the dictionaries, frequent ones get a number, and shards are written anew with these numbers alone; other words end a piece like its marks,
as no frequent phrase holds them. Then, for each further length:

1. Candidates. An occurrence whose words but the last are a frequent phrase (a walk of the last level's tries; any word, for the first) falls into a hash
   bucket; each shard sends its buckets and counts to the bucket's range, and hears which of its own buckets hold at least ``min_count`` occurrences over all
   shards. A bucket's sum is never less than a phrase's count, so what is left out can't be frequent. Distinct survivors whose other part is frequent as
   well are the candidates.
2. Counting. Candidates are dealt into tries of at most about ``block`` phrases, which are built in tasks; a few at a time are broadcast, and each pass
   walks all positions of a shard at once, level by level. Accepting states are counted with bincount, and the shards' counts are summed.

Work and messages grow with the text, tries in number and not in size; nothing is kept of all phrases outside of tables. A pass reads the shards once for
``per_pass`` tries, so passes grow with the number of candidates; it reads numbers, no strings. A phrase's key is its words' numbers, 8 bytes each.

Defined results: null text has no words; null language is ``und``; repeated rows count as often as they stand there; words of a phrase lie in one piece;
other columns are ignored; an empty table gives no rows. A text is cut by one task as a whole, about 60 bytes of memory for a byte of it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .double_array import DoubleArray, build
from .shingles import mix
from .wordcodes import byte_class, row_slices, words_of

INSIDE, BREAKS = byte_class(r"[^ \t.,;:!?\n-\r]"), ~byte_class(r"[^.,;:!?\n-\r]")
SHARD_BYTES, BLOCK, PER_PASS, RANGE_BITS = 6_000_000, 150_000, 6, 22
_ODD = np.random.default_rng(20240202).integers(0, 1 << 64, 65, dtype=np.uint64) | np.uint64(1)


def token_shards(docs: DataFrame, lang: str = "lang", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows (shard, lang, n, words, counts, codes), written to the shared folder: words[i] is code i + 1 and stands counts[i] times, 0 ends a piece."""

    def cut(name: str, texts: list[pa.Array], shard: int) -> Iterator[pa.RecordBatch]:
        found = words_of(pa.concat_arrays(texts), INSIDE)
        if not len(found.codes):
            return
        pieces = np.cumsum(BREAKS[found.data], dtype=np.int32)[found.begins]
        owner = np.repeat(np.arange(len(found.counts), dtype=np.int32), found.counts)
        fresh = np.append((np.diff(pieces) != 0) | (np.diff(owner) != 0), True)
        codes = np.zeros(len(fresh) + int(fresh.sum()), "<i4")
        codes[np.arange(len(fresh)) + np.cumsum(fresh) - fresh] = found.codes + 1
        counts = np.bincount(found.codes, minlength=len(found.dictionary))
        words, counts = (pa.ListArray.from_arrays([0, len(x)], x) for x in (found.dictionary.cast(pa.string()), pa.array(counts, pa.int64())))
        made = [pa.array([shard]), pa.array([name]), pa.array([len(found.codes)]), words, counts, pa.array([codes.tobytes()], pa.binary())]
        yield pa.record_batch(made, names=["shard", "lang", "n", "words", "counts", "codes"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, sizes = TaskContext.get().partitionId() << 32, {}, {}  # texts of each language that wait for a shard to fill, and their bytes
        for batch in batches:
            for name in pc.unique(batch.column(0)).to_pylist():
                texts = batch.column(1).filter(pc.equal(batch.column(0), name))
                for a, b in row_slices(texts, shard_bytes):
                    part = texts.slice(a, b - a)
                    size = pc.sum(pc.binary_length(part)).as_py() or 0
                    if name in held and sizes[name] + size > shard_bytes:
                        yield from cut(name, held.pop(name), shard)
                        shard += 1
                    sizes[name] = size + (sizes[name] if name in held else 0)
                    held.setdefault(name, []).append(part)
            while len(held) > 1 and sum(sizes[x] for x in held) > 4 * shard_bytes:
                name = max(held, key=sizes.get)
                yield from cut(name, held.pop(name), shard)
                shard += 1
        for name, texts in held.items():
            yield from cut(name, texts, shard)
            shard += 1

    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return written(texts.mapInArrow(work, "shard long, lang string, n long, words array<string>, counts array<long>, codes binary"), "tokens")


def numbered(shards: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame]:
    """The words that stand at least ``min_count`` times as rows (key, lang, phrase, f), and the shards of these words alone as rows (shard, ids, codes):
    ids[i] is the number of code i + 1, 0 is anything else."""
    entries = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w")).select("shard", "lang", "code", F.col("w.words").alias("phrase"), F.col("w.counts").alias("n"))
    entries = entries.repartition("phrase", "lang").withColumn("row", F.monotonically_increasing_id())
    same = Window.partitionBy("phrase", "lang")  # at most a row for each shard
    entries = entries.select("shard", "code", "lang", "phrase", "row", F.sum("n").over(same).alias("f"), F.min("row").over(same).alias("id")).filter(F.col("f") >= min_count)
    first = F.col("row") == F.col("id")
    entries = written(entries.select("shard", "code", "id", *(F.when(first, F.col(c)).alias(c) for c in ("lang", "phrase", "f"))), "entries")
    words = written(entries.filter("phrase IS NOT NULL").select(F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("key"), "lang", "phrase", "f"), "words")

    def work(shard, known):
        if not known.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.binary())], names=["shard", "ids", "codes"])
        codes, known = np.frombuffer(shard.column("codes")[0].as_py(), "<i4"), known.sort_by("code")
        number = np.zeros(codes.max() + 1, "<i4")
        number[known.column("code").to_numpy() + 1] = np.arange(1, known.num_rows + 1)
        codes = number[codes]
        codes = codes[(codes > 0) | np.append(True, codes[:-1] > 0)]  # one end of a piece after another says no more
        return pa.table([shard.column("shard"), pa.array([known.column("id").to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary())], names=["shard", "ids", "codes"])

    pairs = shards.select("shard", "codes").groupBy("shard").cogroup(entries.select("shard", "code", "id").groupBy("shard"))  # one shard at a time
    return words, written(pairs.applyInArrow(work, "shard long, ids binary, codes binary"), "numbers")


class Trie:
    """Phrases of one length, a row of word numbers each, as a double array."""

    def __init__(self, rows: np.ndarray):
        self.size, self.depth = rows.shape
        self.words, place = np.unique(rows, return_inverse=True)
        self.array: DoubleArray = build(place.reshape(rows.shape), len(self.words))

    def walk(self, ids: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, phrases): where phrases of this trie begin in a shard, and which."""
        place = np.minimum(np.searchsorted(self.words, ids), len(self.words) - 1)
        word = np.concatenate([[-1], np.where(self.words[place] == ids, place, -1)])  # of each code; an end of piece is no word
        state = self.array.step(np.ones(len(word), np.int64), word)[codes]  # the first level, once per distinct word
        at = np.flatnonzero(state)
        state = state[at]
        for k in range(1, self.depth):  # codes end in 0, so that behind a word there is always one more
            state = self.array.step(state, word[codes[at + k]])
            alive = np.flatnonzero(state)
            at, state = at[alive], state[alive]
        return at, self.array.leaf[state]


def tries(phrases: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (trie, keys, packed), written: the phrases' keys dealt by their first word into tries of about ``block``, so that a position goes on in one trie
    only; a first word of more phrases than a block holds is dealt by phrase as well."""
    of = max(1, -(-phrases.count() // block))

    def work(group):
        keys = group.column("key").to_pylist()
        rows = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(len(keys), -1)
        return pa.table([group.column("trie")[:1].combine_chunks(), pa.array([keys], pa.list_(pa.binary())), pa.array([pickle.dumps(Trie(rows))], pa.binary())], names=["trie", "keys", "packed"])

    rows = phrases.select("key", F.substring("key", 1, 8).alias("first"))
    parts = rows.groupBy("first").agg(F.ceil(F.count("*") / F.lit(block)).alias("parts")).filter("parts > 1")  # few: each has a block of phrases
    rows = rows.join(parts, "first", "left").withColumn("part", F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))))
    dealt = rows.select(F.pmod(F.xxhash64("first", "part"), F.lit(of)).cast("int").alias("trie"), "key")
    return written(dealt.groupBy("trie").applyInArrow(work, "trie int, keys array<binary>, packed binary"), "tries")


def passes(built: DataFrame, per_pass: int) -> Iterator[tuple[int, Broadcast]]:
    """(number, broadcast tries by their number), at most ``per_pass`` of bounded size at once."""
    spark, numbers = built.sparkSession, sorted(r.trie for r in built.select("trie").collect())
    for k in range(0, len(numbers), per_pass):
        few = built.filter(F.col("trie").isin(numbers[k : k + per_pass])).select("trie", "packed").collect()
        yield k, spark.sparkContext.broadcast({r.trie: pickle.loads(r.packed) for r in few})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for shard, ids, codes in zip(*(batch.column(c) for c in ("shard", "ids", "codes"))):
            yield shard.as_py(), np.frombuffer(ids.as_buffer(), "<i8"), np.frombuffer(codes.as_buffer(), "<i4")


def _longer(trie: Trie | None, ids: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct phrases of a shard that are one word longer than a phrase of the trie (without one: than a word), as rows of word numbers; their counts."""
    if trie is None:
        at, depth, size = np.flatnonzero(codes), 1, len(ids)
        phrase = codes[at] - 1
    else:
        (at, phrase), depth, size = trie.walk(ids, codes), trie.depth, trie.size
    last = codes[at + depth]
    more = np.flatnonzero(last)
    at, phrase, last = at[more], phrase[more], last[more]
    kinds, counts = np.unique((phrase.astype(np.int64) << 32) + last, return_counts=True)
    some = np.zeros(size, np.int64)  # where each phrase stands once
    some[phrase] = at
    at = some[kinds >> 32]
    return ids[np.stack([*(codes[at + k] for k in range(depth)), kinds & 0xFFFFFFFF], 1) - 1], counts


def _buckets(rows: np.ndarray, bits: int) -> np.ndarray:
    """The hash bucket of each row of word numbers."""
    total = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        total += mix(rows[:, k].astype(np.uint64)) * _ODD[k % 64]
    return (mix(total) >> np.uint64(64 - bits)).astype(np.int64)


def _sent(buckets: list[np.ndarray], counts: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's distinct buckets, their counts (up to 255), and where each range begins in them."""
    both = np.concatenate([np.zeros(0, np.int64), *((b << 8) + np.minimum(c, 255) for b, c in zip(buckets, counts))])
    both.sort()
    begins = np.flatnonzero(np.diff(both >> 8, prepend=-1))
    kinds = both[begins] >> 8
    sums = np.minimum(np.add.reduceat(both & 255, begins), 255) if len(both) else both
    return kinds, sums.astype(np.uint8), np.searchsorted(kinds, np.arange((1 << max(bits - RANGE_BITS, 0)) + 1) << RANGE_BITS)


def bucket_bits(n: int) -> int:
    """Buckets for n occurrences: at least one for every two."""
    return max(RANGE_BITS, int(n // 2).bit_length())


def candidates(shards: DataFrame, frequent: DataFrame, built: DataFrame | None, min_count: int, n: int, per_pass: int = PER_PASS) -> DataFrame:
    """Distinct keys one word longer than ``frequent`` that may stand ``min_count`` times; ``built`` has the tries of ``frequent``, none for words."""
    bits, out = bucket_bits(n), None
    for _, held in [(0, None)] if built is None else passes(built, per_pass):
        part = shards.mapInArrow(_asker(held, bits), "shard long, range int, lows binary, cuts binary, counts binary")
        told = part.groupBy("range").applyInArrow(_teller(min_count), "shard long, range int, kept binary")
        part = shards.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_namer(held, bits), "key binary")  # one shard at a time
        out = part if out is None else out.unionByName(part)
    if out is None:
        return frequent.select("key").limit(0)
    out = out.distinct()
    return out if built is None else out.withColumn("rest", F.expr("substring(key, 9)")).join(frequent.select(F.col("key").alias("rest")), "rest", "left_semi").select("key")


def _held(held: Broadcast | None) -> list[Trie | None]:
    return [None] if held is None else [t for _, t in sorted(held.value.items())]


def _asker(held: Broadcast | None, bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, ids, codes in _rows(batches):
            found = [_longer(t, ids, codes) for t in _held(held)]
            kinds, counts, ends = _sent([_buckets(f[0], bits) for f in found], [f[1] for f in found], bits)
            ranges = np.flatnonzero(np.diff(ends))
            lows, cuts, sums = [], [], []
            for r in ranges.tolist():
                part = kinds[ends[r] : ends[r + 1]] - (r << RANGE_BITS)
                lows.append((part & 0xFFFF).astype("<u2").tobytes())
                cuts.append(np.bincount(part >> 16, minlength=1 << (RANGE_BITS - 16)).astype("<i4").tobytes())
                sums.append(counts[ends[r] : ends[r + 1]].tobytes())
            yield pa.record_batch([pa.array(np.full(len(ranges), shard)), pa.array(ranges.astype(np.int32)), *(pa.array(x, pa.binary()) for x in (lows, cuts, sums))], names=["shard", "range", "lows", "cuts", "counts"])

    return work


def _teller(min_count: int):
    def work(group):  # what all shards sent of one range
        total, sent = np.zeros(1 << RANGE_BITS, np.int64), []
        for lows, cuts, counts in zip(*(group.column(c).to_pylist() for c in ("lows", "cuts", "counts"))):
            n = np.frombuffer(cuts, "<i4")
            sent.append((np.repeat(np.arange(len(n), dtype=np.int32) << 16, n) + np.frombuffer(lows, "<u2")).astype(np.int32))
            total[sent[-1]] += np.minimum(np.frombuffer(counts, np.uint8), min_count) if min_count > 255 else np.frombuffer(counts, np.uint8)
        enough = total >= min_count
        kept = [np.packbits(enough[s]).tobytes() for s in sent]
        return pa.table([group.column("shard"), group.column("range"), pa.chunked_array([pa.array(kept, pa.binary())])], names=["shard", "range", "kept"])

    return work


def _namer(held: Broadcast | None, bits: int):
    def work(shard, told):  # a shard, and a bit for each bucket that it sent
        out = []
        for _, ids, codes in _rows(shard.to_batches() if told.num_rows else []):
            rows = [_longer(t, ids, codes)[0] for t in _held(held)]
            buckets = np.concatenate([_buckets(r, bits) for r in rows])
            kinds, _, ends = _sent([buckets], [np.zeros(1, np.int64)], bits)
            keep = np.zeros(len(kinds), bool)
            for r, packed in zip(told.column("range").to_pylist(), told.column("kept").to_pylist()):
                keep[ends[r] : ends[r + 1]] = np.unpackbits(np.frombuffer(packed, np.uint8), count=int(ends[r + 1] - ends[r]))
            order = np.argsort(buckets)
            order = order[np.repeat(keep, np.diff(np.append(np.searchsorted(buckets[order], kinds), len(order))))]
            out.append(_keys(np.concatenate(rows)[np.sort(order)]))
        return pa.table([pa.chunked_array(out, pa.binary())], names=["key"])

    return work


def _keys(rows: np.ndarray) -> pa.Array:
    """The keys of phrases given as rows of word numbers."""
    m, depth = rows.shape
    return pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.arange(m + 1, dtype=np.int32) * (8 * depth)), pa.py_buffer(rows.astype(">i8").tobytes())])


def counted(shards: DataFrame, built: DataFrame, min_count: int, per_pass: int = PER_PASS) -> DataFrame:
    """Rows (key, f) of the tries' phrases that stand at least ``min_count`` times."""
    out = None
    for _, held in passes(built, per_pass):
        part = shards.mapInArrow(_counter(held), "trie int, i int, n long").groupBy("trie", "i").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)
        out = part if out is None else out.unionByName(part)
    keys = built.select("trie", F.posexplode("keys").alias("i", "key"))
    if out is None:
        return keys.select("key", F.lit(0).cast("long").alias("f")).limit(0)
    return out.join(keys, ["trie", "i"]).select("key", "f")


def _counter(held: Broadcast):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(t.size, np.int64) for k, t in held.value.items()}
        for _, ids, codes in _rows(batches):
            for k, t in held.value.items():
                sums[k] += np.bincount(t.walk(ids, codes)[1], minlength=t.size)
        for k, n in sums.items():
            i = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(i), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(n[i])], names=["trie", "i", "n"])

    return work


def frequent_phrases(shards: DataFrame, max_words: int, min_count: int, block: int = BLOCK, per_pass: int = PER_PASS) -> list[DataFrame]:
    """Tables (key, lang, phrase, f) of the phrases of 1, 2, ... ``max_words`` words that stand at least ``min_count`` times."""
    n = shards.agg(F.sum("n")).first()[0] or 0
    words, shards = numbered(shards, min_count)
    levels, built = [words], None
    for size in range(2, max_words + 1):
        found = written(candidates(shards, levels[-1], built, min_count, n, per_pass), "candidates")
        often = counted(shards, tries(found, block), min_count, per_pass)
        often = often.select("key", "f", F.substring("key", 1, 8 * size - 8).alias("before"), F.substring("key", 8 * size - 7, 8).alias("last"))
        often = often.join(levels[-1].select(F.col("key").alias("before"), "lang", F.col("phrase").alias("said")), "before").join(words.select(F.col("key").alias("last"), F.col("phrase").alias("word")), "last")
        levels.append(written(often.select("key", "lang", F.concat_ws(" ", "said", "word").alias("phrase"), "f"), "phrases"))
        built = tries(levels[-1], block) if size < max_words else None
    return levels


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, inside_percent: int = 50, top: int = 2000, lang: str = "lang", text: str = "text", block: int = BLOCK, per_pass: int = PER_PASS, shard_bytes: int = SHARD_BYTES, salts: int = 32) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``max_words`` words: lang, rank, phrase, a, l, r, n, score.

    A phrase standing a times, cut after its first k words into parts standing l and r times, scores floor(1000000 a a / (l r)); the lowest cut counts. A phrase inside a longer frequent one
    that stands at least ``inside_percent`` percent as often is left out. Order: score, then a, descending, then phrase in byte order."""
    shards = token_shards(docs, lang, text, shard_bytes)
    levels = frequent_phrases(shards, max_words, min_count, block, per_pass)
    known = levels[0]
    for x in levels[1:-1]:
        known = known.unionByName(x)
    found = levels[1]
    for x in levels[2:]:
        found = found.unionByName(x)
    found = found.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    part = lambda side, column: known.select("lang", F.col("phrase").alias(side), F.col("f").alias(column))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumn("first", F.array_join(F.slice("words", 1, F.col("k")), " ")).withColumn("rest", F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " "))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    d = lambda c: f"CAST({c} AS DECIMAL(15, 0))"  # noqa: E731  exact up to 10^15 occurrences
    cuts = cuts.withColumn("score", F.expr(f"CAST({d('a')} * {d('a')} * CAST(1000000 AS DECIMAL(7, 0)) div ({d('l')} * {d('r')}) AS BIGINT)"))
    least = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " ")))
    holders = found.filter(F.size("words") > 2).select("lang", "a", F.explode(F.array_distinct(F.flatten(inner))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = least.join(holders, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < inside_percent * F.col("a"), F.lit(True)))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)  # of at most salts * top rows
    totals = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
