"""N-gram Jaccard self-join with filters under several global token orders.

A pair of sets with Jaccard similarity of at least t shares a token among the first n - ceil(t n) + 1 of each set under every global order of tokens.
Three orders are used. The first takes a fixed part of the token space first, rarest tokens leading (document counts over all documents), so
that most documents' prefixes hold no token of another document and those leave at once. The second and third order tokens by hash from either
end; their prefixes are kept as bitmaps. A candidate pair must share a prefix token under all three, have compatible sizes, and pass a bound on the
symmetric difference: of each of 2048 parts of the token space a bit keeps whether the set holds an odd number of tokens there, and no two sets differ
by fewer tokens than bits. Survivors are verified on whole shingle sets.

Skew: equal sets are one node. A token's documents are dealt to blocks of bounded size, and only a spanning forest of a block's candidates is passed on,
surest pairs first, so m near copies give at most m - 1 pairs. Tokens of more than one block are then dealt again with what is linked known: members of
the largest linked part, which need not meet each other, once for each block of the rest. Nodes that candidates connect are a family. One whose candidates
were all verified is done; in the others whole sets meet, block by block, and a task passes on only links that join two parts. So the links that leave a
task grow with the members of a token or family, and no link is lost; but a member that stays unlinked is sent to each block of like size, which makes the
square of the members over the block's size in rows.

Defined results: null, empty and white-space texts have the empty set, linked with nothing; repeated rows (of one id and text) give repeated rows; a null
id is a document of its own whose links count but which never names a component unless alone; rows of one id with different texts keep their own sets;
an empty table gives no rows; other columns are ignored. A text's set is held whole by one task, as the text itself is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .components import components
from .shingles import mix, shingle_sets
from .textvec import slices

BITS = 2048
SETS = "doc_id long, n int, u int, key binary, tokens array<long>, parity binary, low binary, high binary"


def required(n: np.ndarray, percent: int) -> np.ndarray:
    """Prefix length of a set of n tokens: n - ceil(percent n / 100) + 1."""
    return n - (percent * n + 99) // 100 + 1


def regions(percent: int) -> int:
    """Parts of the token space; one part is well above a prefix long."""
    return max(1, round(80 / (100 - percent))) if percent < 100 else 80


def summaries(texts: list[str | None], width: int, percent: int) -> tuple:
    """For each text: set size, tokens of the first region, set key, first-order tokens that may need a count, parity bits and bitmaps."""
    t, starts = shingle_sets(texts, width)
    n = np.diff(starts)
    doc = np.repeat(np.arange(len(n)), n)
    rank = np.arange(len(t)) - starts[doc]
    k = np.where(n > 0, required(n, percent), 0)
    own = (t >> np.uint64(8)) % np.uint64(regions(percent)) == 0
    u = np.bincount(doc[own], minlength=len(n))
    other_rank = np.cumsum(~own) - ~own
    base = np.concatenate([[0], np.cumsum(~own)])[starts[:-1]]
    take = own | (~own & (other_rank - base[doc] < (k - u)[doc]))
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(t + np.uint64(s)))]) for s in (0x51ED27, 0xA5A5F1)]
    key = np.stack([s[starts[1:]] - s[starts[:-1]] for s in sums], 1)
    parity = np.empty((len(n), BITS // 8), np.uint8)
    for a in range(0, len(n), 1024):  # bounds the counters
        here, b = slice(starts[a], starts[min(a + 1024, len(n))]), min(a + 1024, len(n))
        cell = (doc[here] - a) * BITS + ((t[here] >> np.uint64(32)) & np.uint64(BITS - 1)).astype(np.int64)
        parity[a:b] = np.packbits(np.bincount(cell, minlength=(b - a) * BITS) & 1).reshape(-1, BITS // 8)
    bits = []
    for mask in (rank < k[doc], rank >= (n - k)[doc]):
        flags = np.zeros(len(n) * 512, bool)
        flags[doc[mask] * 512 + ((t[mask] >> np.uint64(20)) & np.uint64(511)).astype(np.int64)] = True
        bits.append(np.packbits(flags).reshape(len(n), 64))
    counts = np.bincount(doc[take], minlength=len(n))
    return n, u, key, t[take].view(np.int64), np.concatenate([[0], np.cumsum(counts)]), parity, bits[0], bits[1]


def _fixed(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    size = rows.nbytes // max(len(rows), 1)
    return pa.array([rows[i].tobytes() for i in range(len(rows))], pa.binary()) if size else pa.nulls(len(rows), pa.binary())


def document_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """docs(doc_id, text) to a summary of each document's shingle set."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                n, u, key, tokens, ends, parity, low, high = summaries(texts[a:b], width, percent)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(n, pa.int32()), pa.array(u, pa.int32()), _fixed(key), lists, _fixed(parity), _fixed(low), _fixed(high)], names=[x.split()[0] for x in SETS.split(", ")])

    return rows.mapInArrow(work, SETS)


def prefixes(nodes: DataFrame, percent: int) -> DataFrame:
    """nodes(node, n, u, tokens) to the tokens of each first-order prefix that another node's prefix holds too: (node, token, members). Tokens are counted
    by aggregates that combine before the shuffle. Of tokens in the prefixes of the very same nodes (by number and 128 bits of hash) one stands for all, for
    a pair of nodes needs to meet once."""
    rows = nodes.select("node", F.explode("tokens").alias("token"))
    shared = rows.join(rows.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "token")
    own = F.expr(f"pmod(cast(shiftrightunsigned(token, 8) as long), {regions(percent)}) = 0")
    of = Window.partitionBy("node")
    ranked = shared.withColumn("own", own).withColumn("shared_own", F.count_if("own").over(of)).withColumn("rank", F.row_number().over(of.orderBy(F.desc("own"), "df", "token")))
    sizes = nodes.select("node", "n", "u")
    # Tokens that no other document holds lead the order: u - shared_own of the prefix's places.
    room = F.expr(f"n - cast(floor(({percent} * cast(n as long) + 99) / 100) as int) + 1 - (u - shared_own)")
    kept = written(ranked.join(sizes, "node").filter(~F.col("own") | (F.col("rank") <= room)).select("node", "token"), "prefix-tokens")
    bits = (F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    members = kept.groupBy("token").agg(F.count("*").alias("members"), *bits).filter("members > 1")
    return kept.join(members.groupBy("members", "x", "y").agg(F.min("token").alias("token")), "token").select("node", "token", "members")


def dealt(rows: DataFrame, group: str, percent: int, block: int, tokens: int) -> DataFrame:
    """rows(group, node, n, part) to (group, i, j, own, node, part), where every two nodes of a group that lie in different parts and have compatible sizes
    share a pair (i, j) of blocks. Blocks hold about ``block`` nodes and ``tokens`` tokens of like size; those of a group's largest part don't meet."""
    parts = rows.groupBy(group, "part").agg(F.count("*").alias("count"), F.sum("n").alias("sum"))
    groups = parts.groupBy(group).agg(F.max(F.struct("count", "part")).alias("most"), F.sum("count").alias("all_count"), F.sum("sum").alias("all_sum"))
    one = (F.col("all_count") <= block) & (F.col("all_sum") <= tokens)
    band = F.col("n") if percent == 100 else F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.1 / percent))).cast("int")
    big = ~one & (F.col("most.count") > block) & (F.col("part") == F.col("most.part"))
    rows = rows.join(groups, group).select(group, "node", "n", "part", F.when(one, 0).otherwise(band).alias("band"), big.alias("big"))
    sizes = rows.groupBy(group, "band", "big").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / tokens)).cast("int").alias("blocks"))
    before = Window.partitionBy(group).orderBy("band", "big").rowsBetween(Window.unboundedPreceding, -1)  # a row per band of a group
    sizes = sizes.withColumn("base", F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("int"))
    all_of = sizes.groupBy(group).agg(F.collect_list(F.struct("band", "big", "base", "blocks")).alias("all"))
    own = F.col("base") + F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.join(sizes, [group, "band", "big"]).withColumn("own", own).select(group, "node", "part", "band", "big", "own").join(all_of, group)
    meets = F.filter("all", lambda x: (F.abs(x["band"] - F.col("band")) <= 1) & ~(x["big"] & F.col("big")))
    numbers = F.flatten(F.transform(meets, lambda x: F.sequence(x["base"], x["base"] + x["blocks"] - 1)))
    rows = rows.withColumn("other", F.explode(numbers))
    return rows.select(group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "part")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first three columns, cut so that no group of these spans two of them."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        keys = [batch.column(k).to_numpy() for k in range(3)]
        last = int(np.argmax((keys[0] == keys[0][-1]) & (keys[1] == keys[1][-1]) & (keys[2] == keys[2][-1])))
        if last:
            yield batch.slice(0, last)
        held = batch.slice(last)
    if held is not None:
        yield held


def _bytes(col: pa.Array) -> np.ndarray:
    """Rows of 64-bit words of a binary column whose values are of one length."""
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(col), -1).view(np.uint64)


def group_starts(batch: pa.RecordBatch) -> np.ndarray:
    """Where each group of the first three columns begins, and the end."""
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    for k in range(3):
        key = batch.column(k).to_numpy()
        new[1:] |= key[1:] != key[:-1]
    return np.append(np.flatnonzero(new), batch.num_rows)


class Sketches:
    """What a batch of rows(token, i, j, own, node, part, n, parity, low, high) tells of pairs."""

    def __init__(self, batch: pa.RecordBatch, percent: int):
        self.percent, self.starts = percent, group_starts(batch)
        self.i, self.j, self.own, self.node, part, n = (batch.column(k).to_numpy() for k in range(1, 7))
        self.n = n.astype(np.int64)
        self.parity, self.low, self.high = (_bytes(batch.column(k)) for k in (7, 8, 9))
        self.part = np.where(part >= 0, part, -2 - np.arange(len(part)))

    def passes(self, x: np.ndarray, y: np.ndarray, share: float = 1.0) -> np.ndarray:
        """Whether pairs of rows pass all filters, with at most this share of the symmetric difference that is allowed."""
        n, out = self.n, np.zeros(len(x), bool)
        ok = (np.minimum(n[x], n[y]) * 100 >= self.percent * np.maximum(n[x], n[y])) & (self.node[x] != self.node[y]) & (self.part[x] != self.part[y])
        ok &= (self.own[x] != self.own[y]) | (self.i[x] == self.j[x])  # rows of one block meet elsewhere
        at = np.flatnonzero(ok)
        at = at[(self.low[x[at]] & self.low[y[at]]).any(1) & (self.high[x[at]] & self.high[y[at]]).any(1)]
        for k in range(0, len(at), 4096):
            p = at[k : k + 4096]
            total = n[x[p]] + n[y[p]]
            apart = np.bitwise_count(self.parity[x[p]] ^ self.parity[y[p]]).sum(1, dtype=np.int64)
            out[p] = apart <= (total + 2 * (-self.percent * total // (100 + self.percent))) * share
        return out


def forest(rows: np.ndarray, n: np.ndarray, part: np.ndarray, percent: int, passing) -> Iterator[tuple[int, np.ndarray]]:
    """For a group's rows: pairs that pass and span what passing pairs connect; rows of one part are joined from the start."""
    rows = rows[np.argsort(n[rows], kind="stable")]
    sets, sizes = part[rows], n[rows]
    stop = np.searchsorted(sizes, sizes * 100 // percent, side="right")
    for k in range(len(rows) - 1):
        y = k + 1 + np.flatnonzero(sets[k + 1 : stop[k]] != sets[k])
        if not len(y):
            continue
        y = y[passing(rows[k], rows[y])]
        if len(y):
            y = y[np.unique(sets[y], return_index=True)[1]]
            sets[np.isin(sets, sets[y])] = sets[k]
            yield int(rows[k]), rows[y]
    part[rows] = sets


def group_candidates(s: Sketches, small: int = 8, sure: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of rows: all within groups up to the small size, a spanning forest within larger ones, surest pairs first."""
    sizes = np.diff(s.starts)
    group = np.repeat(np.arange(len(sizes)), sizes)
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    few = sizes[group] <= small
    for lag in range(1, min(int(sizes.max(initial=0)), small)):
        x = np.flatnonzero((group[lag:] == group[:-lag]) & few[lag:])
        x = x[s.passes(x, x + lag)]
        xs.append(x), ys.append(x + lag)
    for g in np.flatnonzero(sizes > small):
        rows = np.arange(s.starts[g], s.starts[g + 1])
        for share in (sure, 1.0):
            for x, y in forest(rows, s.n, s.part, s.percent, lambda x, y, share=share: s.passes(np.full(len(y), x), y, share)):
                xs.append(np.full(len(y), x)), ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


def candidates(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """rows(token, i, j, own, node, part) to distinct candidate pairs (a, b)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            s = Sketches(batch, percent)
            x, y = group_candidates(s)
            yield pa.record_batch([pa.array(np.minimum(s.node[x], s.node[y])), pa.array(np.maximum(s.node[x], s.node[y]))], names=["a", "b"])

    full = rows.join(nodes.select("node", "n", "parity", "low", "high"), "node").select("token", "i", "j", "own", "node", "part", "n", "parity", "low", "high")
    return full.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(work, "a long, b long").distinct()


def whole_sets(need: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, broadcast_rows: int) -> DataFrame:
    """The set of each node of need(node), made anew from a text: (node, tokens)."""
    need = written(need.join(nodes.select("node", "key", F.col("doc_id").alias("_id")), "node"), "needed")
    if need.count() <= broadcast_rows:
        need = F.broadcast(need)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(need, F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "key", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in slices(texts):
                t, starts = shingle_sets(texts[a:b], width)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(t + np.uint64(s)))]) for s in (0x51ED27, 0xA5A5F1)]
                key = np.stack([s[starts[1:]] - s[starts[:-1]] for s in sums], 1)
                own = pa.array([key[k].tobytes() == x for k, x in enumerate(batch.column(1).slice(a, b - a).to_pylist())])
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(t.view(np.int64)))
                yield pa.record_batch([batch.column(0).slice(a, b - a), lists, own], names=["node", "tokens", "own"])

    sets = found.mapInArrow(work, "node long, tokens array<long>, own boolean").filter("own").select("node", "tokens")
    return written(sets.dropDuplicates(["node"]), "sets")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) with ``linked``: whether the whole sets are similar enough."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("_ta")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("_tb")), "b")
    common = F.size(F.array_intersect("_ta", "_tb")).cast("long")
    union = F.size("_ta") + F.size("_tb") - common
    return both.select("a", "b", (common * 100 >= union * percent).alias("linked"))


def block_links(batch: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows(family, i, j, own, node, part, tokens) of one group that join parts, from the whole sets: (x, y)."""
    starts = group_starts(batch)
    i, j, own, node, given = (batch.column(k).to_numpy() for k in range(1, 6))
    lists = batch.column(6)
    at = lists.offsets.to_numpy().astype(np.int64)
    tokens, n = lists.values.to_numpy(), np.diff(at)
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    part = given.copy()
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        _, ids = np.unique(tokens[at[a] : at[b]], return_inverse=True)
        flag = np.zeros(int(ids.max(initial=0)) + 1, bool)

        def linked(x: int, y: np.ndarray) -> np.ndarray:
            out = (own[y] != own[x]) if i[x] != j[x] else np.ones(len(y), bool)
            y = y[out]
            if len(y):
                flag[ids[at[x] - at[a] : at[x + 1] - at[a]]] = True
                first = np.cumsum(n[y]) - n[y]
                places = np.repeat(at[y] - at[a] - first, n[y]) + np.arange(n[y].sum())
                common = np.add.reduceat(flag[ids[places]], first, dtype=np.int64)
                flag[ids[at[x] - at[a] : at[x + 1] - at[a]]] = False
                out[out] = common * 100 >= percent * (n[x] + n[y] - common)
            return out

        for x, y in forest(np.arange(a, b), n, part, percent, linked):
            xs.append(np.full(len(y), x)), ys.append(y)
    x, y = np.concatenate(xs), np.concatenate(ys)
    return node[x], node[y]


def family_links(pairs: DataFrame, sets: DataFrame, percent: int, block: int, tokens: int) -> DataFrame:
    """Further links (a, b) of the families in which some of pairs(a, b, linked) failed."""
    family = components(pairs.select("a", "b"), "families").withColumnRenamed("root", "family")
    open_ones = pairs.filter("not linked").join(family, F.col("a") == F.col("node")).select("family").distinct()
    members = written(family.join(open_ones, "family", "left_semi"), "members")
    links = pairs.filter("linked").join(members.select(F.col("node").alias("a")), "a", "left_semi").select("a", "b")
    parts = components(links, "parts").withColumnRenamed("root", "part")
    rows = members.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")).join(sets.select("node", F.size("tokens").alias("n")), "node")
    rows = dealt(written(rows, "open"), "family", percent, block, tokens)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            a, b = block_links(batch, percent)
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    full = rows.join(sets, "node").select("family", "i", "j", "own", "node", "part", "tokens")
    return full.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, block: int = 1024, tokens: int = 1 << 19, broadcast_rows: int = 500_000) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_shingles and component_id: the smallest doc_id that links of similarity >= percent / 100 reach."""
    sets = written(document_sets(docs, width, percent), "shingle-sets")
    payload = F.struct("n", "u", "tokens", "parity", "low", "high")
    nodes = sets.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first(payload).alias("s"))
    nodes = written(nodes.select("key", "doc_id", "s.*").withColumn("node", F.monotonically_increasing_id()), "nodes")
    shared = written(prefixes(nodes, percent), "prefixes")

    place = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / block)).cast("int")
    once = shared.select("token", place.alias("i"), place.alias("j"), place.alias("own"), "node", F.lit(-1).cast("long").alias("part"))
    found = written(candidates(once, nodes, percent), "candidates")
    whole = whole_sets(ends(found), nodes, docs, width, broadcast_rows)
    pairs = written(verified(found, whole, percent), "verified")
    wide = shared.filter(F.col("members") > block).select("token", "node")
    if not wide.isEmpty():  # blocks of one token
        parts = components(pairs.filter("linked").select("a", "b"), "parts").withColumnRenamed("root", "part")
        rows = wide.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")).join(nodes.select("node", "n"), "node")
        rows = dealt(written(rows, "wide"), "token", percent, block, 1 << 62)  # sketches are of one size
        more = written(candidates(rows, nodes, percent).join(pairs, ["a", "b"], "left_anti"), "candidates")
        whole = whole.unionByName(whole_sets(ends(more).join(whole, "node", "left_anti"), nodes, docs, width, broadcast_rows))
        pairs = written(pairs.unionByName(verified(more, whole, percent)), "verified")
    links = pairs.filter("linked").select("a", "b")
    if not pairs.filter("not linked").isEmpty():
        links = links.unionByName(written(family_links(pairs, whole, percent, block, tokens), "links"))
    roots = components(links)
    named = nodes.select("key", "doc_id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_key = named.join(least, "root").select("key", "component_id")
    return sets.select("doc_id", "n", "key").join(of_key, "key", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
