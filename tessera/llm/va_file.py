"""Exact top-k inner-product search with vector-approximation files.

Vectors are integers, kept in blocks of one length. A block's equal vectors are one entry. Its approximation file, written once, holds for each component
of an entry the number of one of 2^bits equal cells between the block's least and largest value; exact vectors lie in a column of their own, which the
scan doesn't read. Blocks of queries meet blocks of cells, one pair in a task: cells give every entry's score a lower and an upper bound (both are one
product with the cells' lower ends, moved by what the query alone decides), and entries that can't reach the block's kth lower bound leave. The kth lower
bound over all blocks drops more. Exact vectors are then read by entry, in the order of their bounds: first each query's 2k most promising, then those
whose upper bound still reaches the kth exact score, after which the result is certain.

Defined results: vectors that are null or hold a null or non-finite component take no part; a row with null id takes no part; a query meets only vectors
of its own length (without components every score is 0) and no row of its own id; repeated rows are candidates and queries of their own, and queries of
one id share a ranking; ties go to the smaller id; scaled components and scores beyond 64 bits are taken as the nearest 64-bit number; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEAST, MOST = -(1 << 63), (1 << 63) - 1
EXACT = float(1 << 52)  # whole numbers up to here are exact as doubles
WIDE = 1 << 20  # a vector with a larger component goes to blocks apart, so that it doesn't coarsen the cells of others
ROW = 20  # bits of a row's place within its block
BLOCK = "dim int, place long, sole binary, alone binary, vectors binary, low binary, step binary, cells binary, ids array<array<long>>"
CANDIDATE = "query long, entry long, lower double, upper double"


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def pack_cells(cells: np.ndarray, bits: int) -> bytes:
    return np.packbits(np.unpackbits(cells.reshape(-1, 1), axis=1)[:, 8 - bits :]).tobytes()


def unpack_cells(data: bytes, bits: int, shape: tuple[int, int]) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(data, np.uint8))[: shape[0] * shape[1] * bits].reshape(-1, bits)
    out = np.zeros(len(flat), np.uint8)
    for k in range(bits):
        out = out << 1 | flat[:, k]
    return out.reshape(shape)


def entries(ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, list[list[int]]]:
    """Distinct vectors, and of each the ids that can reach a result: the smallest 2k, no id more than k times, so k are left whatever id is left out."""
    if not vectors.shape[1]:
        order, new = np.argsort(ids, kind="stable"), np.arange(len(ids)) == 0
    else:
        order = np.lexsort((ids, *vectors.T[::-1]))
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[order[1:]] != vectors[order[:-1]]).any(1)
    ids, firsts = ids[order], np.flatnonzero(new)
    same = np.zeros(len(ids), bool)
    same[1:] = (ids[1:] == ids[:-1]) & ~new[1:]
    begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(ids))))
    keep = np.arange(len(ids)) - begin < k
    lists = [ids[a:b][keep[a:b]][: 2 * k].tolist() for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(ids)])]
    return vectors[order[firsts]], lists


def cells_of(vectors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower ends, steps, cells): component i of a vector in cell c lies in [low + c step, low + (c + 1) step - 1]."""
    v = vectors.astype(np.float64)
    low, high = (v.min(0), v.max(0)) if len(v) else (v.sum(0), v.sum(0))
    step = np.maximum(np.ceil((high - low + 1) / (1 << bits)), 1)
    return low, step, np.clip((v - low) // step, 0, (1 << bits) - 1).astype(np.uint8)


def whole_numbers(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), beyond 64 bits the nearest 64-bit number."""
    with np.errstate(over="ignore"):
        found = np.clip(np.floor(x * scale), -(2.0**64), 2.0**64)
    large = np.abs(found) >= 2.0**62
    out = np.where(large, 0, found).astype(np.int64)
    out[large] = [min(MOST, max(LEAST, int(v))) for v in found[large]]
    return out


def blocks(rows: DataFrame, key: str, vector: str, scale: float, size: int, k: int, bits: int) -> DataFrame:
    """Blocks of at most ``size`` vectors of one length: ids, floor(scale * component) as 64-bit integers, and the approximation file. With bits = 0 rows
    stay as they are, without cells."""
    good = rows.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        place = 0

        def close(kind: tuple) -> pa.RecordBatch:
            nonlocal place
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(kind), strict=True))
            lists, low, step, cells = [[i] for i in ids.tolist()], np.zeros(0), np.zeros(0), b""
            if bits:
                vectors, lists = entries(ids, vectors, k)
                low, step, numbers = cells_of(vectors, bits)
                cells = pack_cells(numbers, bits)
            sole = np.array([x[0] if x[0] == x[-1] else MOST for x in lists], np.int64)  # an entry of one id, which no query of that id meets
            alone = np.array([x[0] == x[-1] for x in lists], bool)
            place += 1
            one = lambda x: pa.array([x], pa.binary())
            cols = [pa.array([kind[0]], pa.int32()), pa.array([place - 1]), one(sole.tobytes()), one(alone.tobytes()), one(vectors.tobytes()), one(low.tobytes()), one(step.tobytes()), one(cells)]
            return pa.record_batch([*cols, pa.array([lists], pa.list_(pa.list_(pa.int64())))], names=[x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            ends = lists.offsets.to_numpy()
            values = whole_numbers(lists.values.to_numpy(), scale)
            sizes = np.diff(ends)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                found = values[ends[at][:, None] + np.arange(dim)].reshape(len(at), dim)
                wide = (np.abs(found.astype(np.float64)) > WIDE).any(1)
                for kind in (False, True):
                    mine = np.flatnonzero(wide == kind)
                    for a in range(0, len(mine), size):
                        part = mine[a : a + size]
                        have = sum(len(x) for x, _ in held.get((dim, kind), []))
                        if have and have + len(part) > size:
                            yield close((dim, kind))
                        held.setdefault((dim, kind), []).append((ids[at[part]], found[part]))
        for kind in list(held):
            yield close(kind)

    return good.mapInArrow(work, BLOCK).withColumn("part", F.spark_partition_id())


def numbered(made: DataFrame) -> DataFrame:
    """Blocks with numbers from 0: their place in a partition behind the blocks of partitions before it (a row per partition is ordered)."""
    counts = made.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return made.join(counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "part").withColumn("number", F.col("base") + F.col("place")).drop("base", "part", "place")


def scan(own: np.ndarray, queries: np.ndarray, cells: np.ndarray, low: np.ndarray, step: np.ndarray, sole: np.ndarray, alone: np.ndarray, k: int, tile: int = 128) -> Iterator[tuple]:
    """(query, entry, lower, upper) of the entries that can be among the best k of a block, by their cells alone."""
    ends = np.ascontiguousarray((low + cells * step).T)
    order = np.flatnonzero(alone)[np.argsort(sole[alone], kind="stable")]
    for a in range(0, len(own), tile):
        q = queries[a : a + tile].astype(np.float64)
        base = q @ ends
        up, down = np.maximum(q, 0) @ (step - 1), np.minimum(q, 0) @ (step - 1)
        size = np.abs(q) @ np.maximum(np.abs(low), np.abs(low + step * 256)) if len(step) else np.zeros(len(q))
        slack = np.where(size < EXACT, 0.0, size * (len(step) + 4) * 2.0**-50)  # what rounding may add
        first, last = (np.searchsorted(sole[order], own[a : a + tile], side) for side in ("left", "right"))
        for i in np.flatnonzero(first < last):
            base[i, order[first[i] : last[i]]] = -np.inf
        n = base.shape[1]
        least = np.partition(base, n - k, axis=1)[:, n - k] - (up - down) - 2 * slack if n > k else np.full(len(q), -np.inf)
        x, y = np.nonzero((base >= least[:, None]) & (base > -np.inf))
        yield a + x, y, base[x, y] + (down - slack)[x], base[x, y] + (up + slack)[x]


def candidates(queries: DataFrame, cells: DataFrame, k: int, bits: int) -> DataFrame:
    """Blocks of queries against blocks of cells: query and entry are a block's number and a place in it."""
    n_queries, n_cells = queries.count(), cells.count()
    numbers = lambda n: F.explode(F.filter(F.sequence(F.lit(-1).cast("long"), F.lit(n - 1).cast("long")), lambda x: x >= 0))
    nothing = [F.lit(b"").alias(c) for c in ("low", "step", "cells")]
    left = queries.select(F.col("number").alias("q"), numbers(n_cells).alias("c"), F.lit(0).alias("kind"), "dim", "sole", "alone", "vectors", *nothing)
    right = cells.select(numbers(n_queries).alias("q"), F.col("number").alias("c"), F.lit(1).alias("kind"), "dim", "sole", "alone", F.lit(b"").alias("vectors"), "low", "step", "cells")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for batch in batches:
            for row in (x for k in range(batch.num_rows) for x in batch.slice(k, 1).to_pylist()):
                if not row["kind"]:
                    mine = row
                elif row["dim"] == mine["dim"]:
                    dim = row["dim"]
                    ids = np.frombuffer(mine["sole"], np.int64)
                    sole, alone = np.frombuffer(row["sole"], np.int64), np.frombuffer(row["alone"], bool)
                    q = np.frombuffer(mine["vectors"], np.int64).reshape(len(ids), dim)
                    low, step = np.frombuffer(row["low"]), np.frombuffer(row["step"])
                    for x, y, lower, upper in scan(ids, q, unpack_cells(row["cells"], bits, (len(sole), dim)), low, step, sole, alone, k):
                        yield pa.record_batch([pa.array((row["q"] << ROW) + x), pa.array((row["c"] << ROW) + y), pa.array(lower), pa.array(upper)], names=["query", "entry", "lower", "upper"])

    pairs = left.unionByName(right).repartition(min(max(1, 2 * n_queries * n_cells), 10_000), "q", "c").sortWithinPartitions("q", "c", "kind")
    return pairs.mapInArrow(work, CANDIDATE)


def exact_rows(made: DataFrame, name: str) -> DataFrame:
    """Each vector of the blocks beside its number and ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                number, dim, data, ids = (batch.column(c).slice(r, 1) for c in range(4))
                n, dim = len(ids.flatten()), dim[0].as_py()
                values = pa.array(np.frombuffer(data[0].as_py(), np.int64))
                for a in range(0, n, 4096):
                    b = min(a + 4096, n)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * dim), values.slice(a * dim, (b - a) * dim))
                    yield pa.record_batch([pa.array((number[0].as_py() << ROW) + np.arange(a, b)), lists, ids.flatten().slice(a, b - a)], names=[name, f"{name}_vector", f"{name}_ids"])

    return made.select("number", "dim", "vectors", "ids").mapInArrow(work, f"{name} long, {name}_vector array<long>, {name}_ids array<long>")


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices, beyond 64 bits the nearest 64-bit number."""
    most = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    if most(q) * most(v) * q.shape[1] < 2.0**62:
        return np.einsum("ij,ij->i", q, v)
    return np.array([min(MOST, max(LEAST, sum(a * b for a, b in zip(x, y)))) for x, y in zip(q.tolist(), v.tolist())], np.int64)


def read_exact(asked: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """asked(query, entry) with the query's id and each id of the entry and its exact score; rows of the query's own id are left out."""
    full = asked.select("query", "entry").join(queries, "query").join(vectors, "entry")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            sizes, out = np.diff(left.offsets.to_numpy()), np.zeros(batch.num_rows, np.int64)
            a, b = left.flatten().to_numpy(), right.flatten().to_numpy()
            ends = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                places = ends[at][:, None] + np.arange(dim)
                out[at] = products(a[places].reshape(len(at), dim), b[places].reshape(len(at), dim))
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(4), pa.array(out)], names=["query", "query_id", "ids", "score"])

    scored = full.select("query", F.col("query_ids")[0].alias("query_id"), "query_vector", "entry_vector", F.col("entry_ids").alias("ids"))
    scored = scored.mapInArrow(work, "query long, query_id long, ids array<long>, score long")
    return scored.select("query", "query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")


def kth(rows: DataFrame, by: str, k: int, name: str) -> DataFrame:
    """The kth largest value of each query, where it has so many."""
    order = Window.partitionBy("query").orderBy(F.desc(by))
    return rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == k).select("query", F.col(by).alias(name))


def search(queries: DataFrame, vectors: DataFrame, k: int, key: str, vector: str, scale: float, bits: int, block: int, query_block: int) -> tuple[DataFrame, DataFrame]:
    """(exact scores of all rows read, candidates left after the scan): the best k of each query are among the former."""
    if not 1 <= bits <= 8:
        raise ValueError("bits: 1 to 8")
    if max(block, query_block) > 1 << ROW:
        raise ValueError(f"blocks hold at most {1 << ROW} vectors")
    file = numbered(written(blocks(vectors, key, vector, scale, block, k, bits), "va-file"))
    asked = numbered(written(blocks(queries, key, vector, scale, query_block, k, 0), "va-queries"))
    left = written(candidates(asked, file, k, bits), "va-candidates")
    bound = kth(left, "lower", k, "bound")
    most = Window.partitionBy("query").orderBy(F.desc("upper"), "entry")
    left = left.join(bound, "query", "left").filter("bound IS NULL OR upper >= bound").withColumn("turn", F.row_number().over(most))
    left = written(left.select("query", "entry", "upper", "turn"), "va-turns")
    q, v = exact_rows(asked, "query"), exact_rows(file, "entry")
    first = written(read_exact(left.filter(F.col("turn") <= 2 * k), q, v), "va-exact")
    later = left.filter(F.col("turn") > 2 * k).join(kth(first, "score", k, "least"), "query", "left")
    reach = F.col("least").isNull() | (F.col("upper") >= F.col("least").cast("double") - F.abs(F.col("least").cast("double")) * 2.0**-50)
    return first.unionByName(read_exact(later.filter(reach), q, v)), left


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, bits: int = 6, block: int = 16_384, query_block: int = 1024) -> DataFrame:
    """The k vectors of highest integer inner product for each query: query_id, rank, vec_id, score."""
    found, _ = search(queries, vectors, k, key, vector, scale, bits, block, query_block)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
