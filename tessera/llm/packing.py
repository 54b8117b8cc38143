"""Best-fit packing by bin completion.

Only the lengths matter to a packing, so the corpus is first counted by length: at most ``capacity`` numbers, whatever its size. Over those counts bin
completion works on whole groups of like bins: it takes the largest length left, looks for fillings of the room beside it, and repeats the chosen one.
Best-fit completion gives the incumbent; two searches by branch and bound, pruned by the waste that a better packing could still afford, improve on it.
The first tries a few likely fillings, each while the counts last. The second tries every undominated filling, and each any number of times; its only cut
is the node limit, so a search that ends within it has proven its packing optimal. The chosen patterns become ranges of ranks within each length, and
every piece finds its sequence from its own rank, so no task sees more than its share of pieces.

Defined results: null text is empty (its one piece is the closing id); pieces of full capacity are sequences of their own; repeated rows are packed
again; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .textvec import slices
from .word_tokens import WordEncoder

COMPARED = 64  # a filling is compared with so many fuller ones; one that is not compared is kept
TRIPLES = 48  # how many largest lengths the first guess tries triples of; the search over every filling has no such limit
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """docs(doc_id, text) to one row per piece of at most capacity ids; a document's ids end with end_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = WordEncoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, end in slices(texts, 1_000_000):
                part, out = batch.slice(at, end - at), []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(texts[at:end]), strict=True):
                    ids += last
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        data = ids[a : a + 4 * capacity]
                        out.append((doc, k, a // 4, len(data) // 4, zlib.crc32(data)))
                cols = list(zip(*out, strict=True))
                yield pa.record_batch([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols)], names=[x.split()[0] for x in PIECES.split(", ")])

    return rows.mapInArrow(work, PIECES)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs (Martello and Toth's second bound)."""
    size = np.arange(len(counts))
    best = -(-int((size * counts).sum()) // capacity)
    for k in range(capacity // 2 + 1):
        big, middle = size > capacity - k, (size <= capacity - k) & (2 * size > capacity)
        small = (2 * size <= capacity) & (size >= k)
        n = int(counts[middle].sum())
        room = n * capacity - int((size * counts)[middle].sum())
        best = max(best, int(counts[big].sum()) + n + max(0, -(-(int((size * counts)[small].sum()) - room) // capacity)))
    return best


def _pair(v: np.ndarray, counts: np.ndarray, room: int) -> tuple[int, tuple[int, ...]]:
    """The fullest filling by two of the sorted lengths v."""
    a = v[v < room]
    if not len(a):
        return 0, ()
    at = np.searchsorted(v, room - a, side="right") - 1
    at = np.where((at >= 0) & (v[at] == a) & (counts[a] < 2), at - 1, at)
    total = np.where(at >= 0, a + v[at], 0)
    i = len(total) - 1 - int(np.argmax(total[::-1]))
    return (int(total[i]), (int(a[i]), int(v[at[i]]))) if total[i] else (0, ())


def likely(counts: np.ndarray, room: int, width: int) -> list[tuple[int, ...]]:
    """A few full fillings of the room, fullest first, for best-fit completion and a first search: before the last three items the largest that fit are
    taken, then the largest length, the fullest pair or some triples that are fuller follow."""
    v = np.nonzero(counts[: room + 1])[0]
    if not len(v):
        return [()]
    head: list[int] = []
    left = counts.copy()
    while len(v) and room > 3 * int(v[-1]):
        take = min(int(left[v[-1]]), max(1, (room - 3 * int(v[-1])) // int(v[-1])))
        head += [int(v[-1])] * take
        left[v[-1]] -= take
        room -= take * int(v[-1])
        v = np.nonzero(left[: room + 1])[0]
    if not len(v):
        return [tuple(head)]
    found = [(int(v[-1]), (int(v[-1]),))]
    if found[0][0] < room:
        two = _pair(v, left, room)
        if two[0] > found[0][0]:
            found.append(two)
        if two[0] < room:
            best = max(x[0] for x in found)
            for a in v[::-1][:TRIPLES].tolist():
                left[a] -= 1
                w = v[v <= a] if left[a] else v[v < a]
                three = _pair(w, left, room - a) if room > a else (0, ())
                left[a] += 1
                if three[0] and a + three[0] > best:
                    best = a + three[0]
                    found.append((best, (a, *three[1])))
                if best == room:
                    break
    found.sort(key=lambda x: (-x[0], len(x[1])))
    return [tuple(head) + x[1] for x in found[:width]]


def _dominates(one: tuple[int, ...], other: tuple[int, ...], steps: int = 200) -> bool:
    """Whether other (both in falling order) parts into sets that each fit an item of its own of one. Where the steps run out the answer is no, which
    keeps a filling that could be dropped."""
    room, tries = list(one), [steps]

    def place(k: int) -> bool:
        if k == len(other):
            return True
        seen = set()
        for i, free in enumerate(room):
            if free >= other[k] and free not in seen:
                seen.add(free)
                tries[0] -= 1
                if tries[0] < 0:
                    return False
                room[i] -= other[k]
                if place(k + 1):
                    return True
                room[i] += other[k]
        return False

    return len(other) <= steps and one[:1] >= other[:1] and place(0)


def fillings(counts: np.ndarray, room: int) -> Iterator[tuple[int, ...] | None]:
    """Every undominated filling of the room, found one by one, fullest first; None stands for one that another dominates, so that the caller can count
    it. Of like fullness the lexicographically largest comes first: what dominates a filling comes before it."""
    kinds = np.nonzero(counts[: room + 1])[0].tolist()
    sums, mask = [1], (1 << (room + 1)) - 1  # sums[i]: bit s is set where the i smallest lengths can make up s
    for k in kinds:
        bits, n, step = sums[-1], min(int(counts[k]), room // k), 1
        while n:
            step = min(step, n)
            bits |= bits << (step * k) & mask
            n -= step
            step *= 2
        sums.append(bits)

    def of_sum(total: int) -> Iterator[tuple[int, ...]]:
        stack = [(len(kinds), total, ())]
        while stack:
            i, rest, items = stack.pop()
            if not rest:
                yield items
                continue
            more = []
            for j in range(i - 1, -1, -1):  # the next smaller length, as often as possible first
                k = kinds[j]
                if not sums[j + 1] >> rest & 1:
                    break
                for m in range(min(int(counts[k]), rest // k), 0, -1):
                    if sums[j] >> (rest - m * k) & 1:
                        more.append((j, rest - m * k, items + (k,) * m))
            stack += reversed(more)

    kept: list[tuple[int, ...]] = []
    for total in range(room, -1, -1):
        if not sums[-1] >> total & 1:
            continue
        for items in of_sum(total):
            if any(_dominates(x, items) for x in kept[:COMPARED]):
                yield None
                continue
            kept.append(items)
            yield items
            if len(items) <= 1:  # one length dominates all that are no fuller
                return


def _complete(counts: np.ndarray, capacity: int, choose) -> list[tuple[tuple[int, ...], int]]:
    """Pack all counts, each time around the largest length left."""
    left, out = counts.copy(), []
    top = len(left) - 1
    while True:
        while top > 0 and not left[top]:
            top -= 1
        if top <= 0:
            return out
        left[top] -= 1
        items = (top, *choose(left, capacity - top))
        left[top] += 1
        kinds, need = np.unique(items, return_counts=True)
        times = int((left[kinds] // need).min())
        left[kinds] -= need * times
        out.append((items, times))


def plan(counts: np.ndarray, capacity: int, nodes: int = 3000, width: int = 4) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence) and how often each is used. counts[k]: pieces of length k, for k up to capacity."""
    counts = np.asarray(counts, np.int64)
    best = _complete(counts, capacity, lambda left, room: likely(left, room, 1)[0] if room else ())
    used = sum(n for _, n in best)
    least, total = lower_bound(counts, capacity), int((np.arange(len(counts)) * counts).sum())
    budget = [nodes]

    def some(left: np.ndarray, room: int) -> list[tuple[int, ...]]:
        return likely(left, room, width) if room else [()]

    def every(left: np.ndarray, room: int) -> Iterator[tuple[int, ...] | None]:
        yield next(fillings(left, room))  # most nodes need no other; what the second takes is not held until then
        again = fillings(left, room)
        next(again)
        yield from again

    def search(left: np.ndarray, done: list, bins: int, waste: int, options, repeats: bool) -> None:
        nonlocal best, used
        top = int(np.max(np.nonzero(left)[0], initial=0))
        if not top:
            if bins < used:
                best, used = list(done), bins
            return
        others = left.copy()
        others[top] -= 1

        def follow(items: tuple[int, ...], times: int) -> None:
            budget[0] -= 1
            kinds, need = np.unique(items, return_counts=True)
            rest = left.copy()
            rest[kinds] -= need * times
            lost = waste + times * (capacity - sum(items))
            if lost <= (used - 1) * capacity - total and bins + times + lower_bound_fast(rest, capacity) < used:
                search(rest, [*done, (items, times)], bins + times, lost, options, repeats)

        fewer = []
        for fill in options(others, capacity - top):
            if budget[0] <= 0 or used <= least:
                return
            if fill is None:
                budget[0] -= 1
                continue
            items = (top, *fill)
            if waste + capacity - sum(items) > (used - 1) * capacity - total:  # more waste than a better packing has; all that follow waste no less
                break
            kinds, need = np.unique(items, return_counts=True)
            most = int((left[kinds] // need).min())
            if repeats and most > 1:
                fewer.append((items, most))
            follow(items, most)
        for items, most in fewer:
            for times in range(most - 1, 0, -1):
                if budget[0] <= 0 or used <= least:
                    return
                follow(items, times)

    if used > least:
        import sys

        sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * capacity + 1000))
        for options in (some, every):  # within its nodes the narrow search gets further up; the second leaves nothing out
            budget[0] = nodes
            search(counts.copy(), [], 0, 0, options, options is every)
    return best


def lower_bound_fast(counts: np.ndarray, capacity: int) -> int:
    size = np.arange(len(counts))
    return max(-(-int((size * counts).sum()) // capacity), int(counts[capacity // 2 + 1 :].sum()))


def pack(rows: DataFrame, capacity: int = 2048, nodes: int = 3000, rows_per_salt: int = 500_000) -> DataFrame:
    """rows(doc_id, piece, length, ...) with sequence_id and offset. rows is read three times, so it should be a written table."""
    by_length = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    counts = np.zeros(capacity + 1, np.int64)
    for k, n in by_length.items():
        counts[k] = n
    # Slots: of a pattern used n times, a length that it holds m times takes the next m * n ranks of that length.
    at, slots, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for items, times in plan(counts, capacity, nodes):
        offset = 0
        for k, m in sorted({k: items.count(k) for k in items}.items(), reverse=True):
            slots.append((k, int(at[k]), m, sequence, offset))
            at[k] += m * times
            offset += m * k
        sequence += times
    slots.sort()
    slot = np.array(slots, np.int64).reshape(-1, 5)
    starts = slot[:, 0] * (1 << 44) + slot[:, 1]

    salts = max(16, int(counts.sum()) // rows_per_salt)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sums = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("_row", F.row_number().over(within)).join(base, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_row") - 1)
    names = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            i = np.searchsorted(starts, length * (1 << 44) + rank, side="right") - 1
            _, first, m, sequence, offset = slot[i].T
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.record_batch([*cols, pa.array(sequence + (rank - first) // m), pa.array(offset + (rank - first) % m * length)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {k}" for n, k in rows.dtypes) + ", sequence_id bigint, offset bigint"
    return ranked.select(*names, "_rank").mapInArrow(work, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    return pack(written(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
