import math
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm.queries_op2 import op2_exact_top_k
from tessera.llm.va_file import cells_of, entries, pack_cells, scan, search, top_k, unpack_cells


def brute(rows, k, modulus=20):
    """From the rows alone, as the SQL has it: every row is a candidate, and queries of one id share a ranking."""
    clip = lambda x: min((1 << 63) - 1, max(-(1 << 63), x))
    whole = lambda x: clip(math.floor(64 * float(x)) if abs(64 * float(x)) < math.inf else int(math.copysign(1 << 70, x)))
    good = [(i, tuple(whole(x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = defaultdict(list)
    for q, qv in good:
        if q % modulus == 0:
            out[q] += [(-clip(sum(a * b for a, b in zip(qv, v))), i) for i, v in good if i != q and len(v) == len(qv)]
    return sorted((q, r + 1, i, -n) for q, s in out.items() for r, (n, i) in enumerate(sorted(s)[:k]))


def got(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 5) for i in range(1000, 1300)] + [(20020, [1.0, 2.0])] + [(7001, [3.0, 1.0]), (7002, [3.0, 1.0])]
    rows += [(40, None), (60, [None, 1.0, 1.0, 1.0, 1.0]), (80, [float("nan")] * 5), (2000, [float("inf")] * 5), (2001, []), (2020, []), (2002, []), (None, [1.0] * 5), (-20, [-0.0] * 5), (301, [1000.0] * 5), (301, [1000.0] * 5), (320, [2e6] * 5), (321, [2e6, -3.0, 1.0, 2.0, 0.0]), (340, [1.0] * 5), (340, [1.0] * 5), (340, [0.5, 1.0, -1.0, 0.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, dim int")
    for size, bits in ((16_384, 4), (37, 2), (64, 1)):
        assert got(top_k(df.filter("vec_id % 20 = 0"), df, k=20, block=size, query_block=11, bits=bits)) == brute(rows, 20)
    assert got(top_k(df.filter("vec_id % 20 = 0"), df, k=1000)) == brute(rows, 1000)
    assert top_k(df.limit(0), df).collect() == [] and top_k(df, df.limit(0)).collect() == []


@pytest.mark.parametrize("size", [1, 50, 1 << 22, 1 << 61])
def test_bounds_never_lose_a_result(size):
    rng = np.random.default_rng(size)
    for n in (1, 5, 400):
        v = rng.integers(-size, size + 1, (n, 6))
        ids = rng.permutation(n)
        q, own, k = rng.integers(-size, size + 1, (9, 6)), np.arange(9), 3
        found, lists = entries(ids, v, k)
        low, step, cells = cells_of(found, 3)
        assert (unpack_cells(pack_cells(cells, 3), 3, cells.shape) == cells).all()
        sole, alone = np.array([x[0] for x in lists]), np.array([x[0] == x[-1] for x in lists])
        kept = {(int(own[x]), i): (a, b) for xs, ys, lo, up in scan(own, q, cells, low, step, sole, alone, k) for x, y, a, b in zip(xs, ys, lo, up) for i in lists[y]}
        for o, x in zip(own.tolist(), q.tolist()):
            scores = sorted((-sum(a * b for a, b in zip(x, v[j].tolist())), int(ids[j])) for j in range(n) if ids[j] != o)
            for s, i in scores[:k]:
                assert kept[o, i][0] <= -s <= kept[o, i][1]


def test_hot_vector_and_repeats():
    ids = np.array([7] * 50 + list(range(100, 160)) + [3])
    v = np.array([[1, 2]] * 110 + [[5, 5]])
    found, lists = entries(ids, v, 20)
    assert found.tolist() == [[1, 2], [5, 5]]
    assert lists == [[7] * 20 + list(range(100, 120)), [3]]


@pytest.mark.parametrize("value", [3e15, 1e300])
def test_beyond_64_bits(spark, value):
    rows = [(i, [float(i), value if i % 3 else -value, 0.25 * i]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(top_k(df.filter("vec_id % 20 = 0"), df, k=5)) == brute(rows, 5)


def test_exact_vectors_are_read_for_few_entries(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    _, left = search(df.filter("vec_id % 20 = 0"), df, 20, "vec_id", "embedding", 64.0, 5, 16_384, 1024)
    read = [r["count"] for r in left.groupBy("query").count().collect()]
    assert 20 <= min(read) and sum(read) / len(read) < 0.5 * df.count()


def test_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(op2_exact_top_k(spark, sf_dir)) == brute(rows, 20)
