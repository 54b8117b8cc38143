import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.components import components, star_edges
from tessera.llm.jaccard_join import Sketches, block_links, near_duplicates, summaries
from tessera.llm.queries_op1 import op1_ngram_jaccard_join
from tessera.llm.shingles import shingle_sets

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(zip(*(words[k:] for k in range(width)))) if len(words) >= width else frozenset([tuple(words)])


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            index[x].append(k)
    for k, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for o in index[x]:
                common[o] += 1
        for o, c in common.items():
            if o < k and 100 * c >= percent * (len(s) + len(sets[o]) - c):
                parent[find(k)] = find(o)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_sets():
    texts = ["", None, " \t\n", "a", "A a", "a b c", "a b c a b c a b c", "É é x\x0by z", "w" * 500, "w" * 501, "x " * 9, "q" * 70 + " r", "b a c", "ab c d", "a bc d"]
    for width in (1, 2, 3, 5):
        t, starts = shingle_sets(texts, width)
        want = [shingles(x, width) for x in texts]
        assert np.diff(starts).tolist() == [len(s) for s in want]
        names = {}
        for k, s in enumerate(want):
            mine = set(t[starts[k] : starts[k + 1]].tolist())
            for o in range(k):
                assert len(mine & names[o]) == len(s & want[o])
            names[k] = mine


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width,percent,block", [(3, 90, 1024), (3, 90, 7), (5, 80, 16)])
def test_against_brute_force(spark, width, percent, block):
    rng = random.Random(width * 100 + block)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    texts = ["", None, "  ", "a", "A", "a b", "a b", "one two three", "One two  three"]
    for size, n, edits in ((30, 20, 2), (60, 40, 4), (160, 60, 5), (400, 15, 20), (12, 25, 1)):
        texts += family(rng, [word() for _ in range(size)], n, edits)
    passage = [word() for _ in range(60)]
    texts += [" ".join([*(word() for _ in range(20)), *passage, *(word() for _ in range(rng.randint(0, 6)))]) for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, "null id here now"), (None, texts[20]), (20, texts[20]), (500, texts[20]), (500, texts[40])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, "x", 0) for i, t in rows], "doc_id long, text string, n int, key string, node int")
    assert got(near_duplicates(df, width, percent, block=block)) == brute(rows, width, percent)


def test_chain_and_empty(spark):
    base = [f"w{k}" for k in range(200)]
    chain = [" ".join(base[:k] + [f"x{m}" for m in range(k)] + base[k:]) for k in range(0, 40)]
    rows = list(enumerate(chain))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_duplicates(df, 3, 90, broadcast_rows=0)) == brute(rows, 3, 90)
    assert near_duplicates(df.limit(0), 3, 90).collect() == []


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (5, 5), (200, 150), (150, 160), (160, 200)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(61)} | {100: 100, 101: 100} | {k: 150 for k in (150, 160, 200)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_chains_over_many_parts(spark):
    """A long chain whose edges lie scattered over many tasks, with numbers that neither rise nor fall along it."""
    names = list(range(700))
    random.Random(1).shuffle(names)
    edges = list(zip(names, names[1:])) + [(k, k + 1000) for k in range(1000, 1005)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(13)
    found = {r.node: r.root for r in components(df).collect()}
    assert found == {k: 0 for k in range(700)} | {k: min(k, k - 1000 if k >= 2000 else k) for e in edges[699:] for k in e}


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(op1_ngram_jaccard_join(spark, sf_dir)) == brute(rows, 3, 90)


def near_threshold(m, seed=5):
    """Sets of 490 tokens around a similarity of 0.9 to one another, and the rows of one group that holds them."""
    rng = np.random.default_rng(seed)
    base = rng.choice(1 << 62, 490, replace=False)
    sets = []
    for _ in range(m):
        s = base.copy()
        at = rng.choice(490, int(rng.integers(11, 16)), replace=False)
        s[at] = rng.choice(1 << 62, len(at))
        sets.append(np.unique(s))
    return sets


def test_rows_of_a_group_stay_below_its_members():
    for m in (100, 400, 800):
        sets = near_threshold(m)
        one = pa.array(np.zeros(m, np.int64))
        lists = pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))
        batch = pa.record_batch([one, one, one, one, pa.array(np.arange(m)), pa.array(np.arange(m)), lists], names=["family", "i", "j", "own", "node", "part", "tokens"])
        a, b = block_links(batch, 90)
        incidence = {t: k for k, t in enumerate(np.unique(np.concatenate(sets)))}
        matrix = np.zeros((m, len(incidence)), np.float32)
        for k, s in enumerate(sets):
            matrix[k, [incidence[t] for t in s]] = 1
        common, n = matrix @ matrix.T, np.array([len(s) for s in sets])
        links = 100 * common >= 90 * (n[:, None] + n - common)
        joined, _ = star_edges(*np.nonzero(np.triu(links, 1)))
        assert len(a) == len(joined) <= m - 1  # a spanning forest of the links, no pair more
        assert all(links[x, y] for x, y in zip(a, b))


def test_sketches_never_hide_a_link():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(4000)]
    texts = []
    for n in (3, 8, 40, 500, 1500):
        base = list(rng.choice(words, n))
        for _ in range(30):
            w = list(base)
            for _ in range(rng.integers(0, max(2, n // 40))):
                w[rng.integers(n)] = f"e{rng.integers(10**6)}"
            texts.append(" ".join(w))
    n, u, key, tokens, ends, parity, low, high = summaries(texts, 3, 90)
    sets = [shingles(t, 3) for t in texts]
    fixed = lambda r: pa.array([x.tobytes() for x in r], pa.binary())
    m = len(texts)
    zero = pa.array(np.zeros(m, np.int64))
    batch = pa.record_batch([zero, zero, zero, zero, pa.array(np.arange(m)), pa.array(np.full(m, -1)), pa.array(n), fixed(parity), fixed(low), fixed(high)], names=list("abcdefghij"))
    x, y = np.triu_indices(m, 1)
    passed = Sketches(batch, 90).passes(x, y)
    linked = np.array([100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) for a, b in zip(x, y)])
    assert linked.sum() > 100 and passed[linked].all() and passed[~linked].mean() < 0.02


def test_blocks_of_one_token(spark):
    """Thousands of variants of one text, dealt to many blocks, some of which only a member of another block links."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(300):
        w = list(base)
        for _ in range(rng.choice((1, 1, 1, 3, 4))):
            w[rng.randrange(len(w))] = f"e{k}x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_duplicates(df, 3, 90, block=16, tokens=3000)) == brute(rows, 3, 90)
