import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm.bloom_lookup import fingerprints, peel_sql, retried_sql, subtract_sql, successors, table_sql
from tessera.llm.queries_op6 import op6_document_fingerprints


def pieces(text, run=256):
    return set(re.findall(rf"[^\n]{{1,{run}}}", text))


def like(a, b, run=256):
    a, b = pieces(a, run), pieces(b, run)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(docs, run=256):
    """From {id: text} alone."""
    ids = sorted(docs, key=lambda i: (i is not None, i or 0), reverse=True)
    out = {}
    for k, i in enumerate(ids):
        text, following = docs[i], docs[ids[(k + 1) % len(ids)]]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), like(text, edited, run), like(text, following, run), edited)
    return out


def check(rows, docs, run=256):
    want = expected(docs, run)
    assert len(rows) == len(docs)
    by_text = {}
    for r in rows:
        n, sha, near_edited, near_next, edited = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert abs(r.near_edited - near_edited) < 1e-12 and abs(r.near_next - near_next) < 1e-12, r.doc_id
        for text, mark in ((docs[r.doc_id], r.fingerprint), (edited, r.edited_fingerprint)):
            assert by_text.setdefault(frozenset(pieces(text, run)), mark) == mark
    assert len(set(by_text.values())) == len(by_text)


def test_odd_rows(spark):
    rng = random.Random(1)
    line = lambda: "".join(rng.choice("abc é😀") for _ in range(rng.randint(1, 30)))
    docs = {0: "", 5: "\n\n", 7: "a", -3: "ab\nab\nab", 10**15: "😀é" * 700, 11: "x" * 100_000, 12: "\n".join(line() for _ in range(3000)), None: "no id\nat all"}
    docs |= {100 + k: "\n".join(line() for _ in range(rng.randint(0, 60))) for k in range(60)}
    docs |= {300 + k: docs[100] for k in range(5)}
    df = spark.createDataFrame([(i, None if i == 0 else t, 1, "t") for i, t in docs.items()], "doc_id long, text string, n long, tab string")
    check(fingerprints(df).collect(), docs)
    check(fingerprints(df.filter("doc_id between 100 and 140"), run=20, cells=12).collect(), {i: t for i, t in docs.items() if i and 100 <= i <= 140}, 20)
    assert fingerprints(df.limit(0)).collect() == []
    alone = fingerprints(df.filter("doc_id = 7")).collect()
    check(alone, {7: "a"})
    assert alone[0].near_next == 1.0


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\ny"), (2, "x\nz")], "doc_id long, text string")
    rows = fingerprints(df).collect()
    assert len(rows) == 4 and len({r.edited_sha256 for r in rows if r.doc_id == 1}) == 1 and len({r.fingerprint for r in rows if r.doc_id == 2}) == 2


def test_peeling_and_retry(spark):
    rng = random.Random(2)
    rows = []
    for d in (0, 1, 3, 8, 12, 20, 40, 200):
        common = [rng.getrandbits(63) for _ in range(50)]
        a, b = [rng.getrandbits(63) for _ in range(d)], [-rng.getrandbits(63) for _ in range(d // 2)]
        rows.append((d, common + a, common + b))
    df = spark.createDataFrame(rows, "d int, a array<long>, b array<long>")
    one = peel_sql(subtract_sql(table_sql("a", 24), table_sql("b", 24)), 24)
    for r in df.select("d", F.expr(one).alias("one"), F.expr(retried_sql("a", "b", 24)).alias("more")).collect():
        assert (r.more.p, r.more.m) == (r.d, r.d // 2)
        assert r.one.ok or r.d >= 8
        if r.one.ok:
            assert (r.one.p, r.one.m) == (r.d, r.d // 2)
        assert not (r.one.ok and r.d >= 40)


def test_successors(spark):
    ids = [5, -7, 100, 101, 10**17, 3, 3, -(2**63)]
    df = spark.createDataFrame([(i, 1) for i in ids], "oid long, n long")
    order = sorted(set(ids), reverse=True)
    for per in (1, 2, 100):
        assert {r.oid: r.next_oid for r in successors(df, per).collect()} == dict(zip(order, order[1:] + order[:1]))


def test_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(op6_document_fingerprints(spark, sf_dir).collect(), docs)
