"""Streaming forms against their batch forms."""

import pytest
from pyspark.sql import functions as F

from tessera.plans.fixtures import Inputs
from tessera.streaming import events as E


def staged(spark, sf_dir, tmp_path, rows=None):
    """Messages as a stream of two files, in time order."""
    m = (rows if rows is not None else Inputs(spark, sf_dir).messages).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    for k in range(2):
        m.filter(F.col("msg_offset") % 1000 < 500 if k == 0 else F.col("msg_offset") % 1000 >= 500).coalesce(1).write.mode("append").parquet(folder)
    return m, spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, tmp_path, name, mode="append"):
    spark = df.sparkSession
    out = str(tmp_path / name)
    query = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@pytest.mark.parametrize("window_s", [3600, 5 * 86_400, 3650 * 86_400])
def test_dedup(spark, sf_dir, tmp_path, window_s):
    """Stream and batch call the same events unique, with windows shorter and longer than the data's span."""
    rows = Inputs(spark, sf_dir).messages.withColumn("idempotency_id", F.expr("cast(msg_offset % 20 as string)"))
    rows = rows.withColumn("msg_offset", F.expr("row_number() OVER (ORDER BY ts, msg_offset) - 1").cast("long"))
    folder = str(tmp_path / "in")
    half = rows.count() // 2
    m = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    for k, part in enumerate((m.filter(F.col("msg_offset") < half), m.filter(F.col("msg_offset") >= half))):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    kept = run(E.dedup_events(stream, window_s, late="3650 days"), tmp_path, "dedup")
    first = E.dedup_events_batch(m, window_s).filter("state = 'unique'")
    got, want = (sorted(r.msg_offset for r in x.collect()) for x in (kept, first))
    assert got == want and 20 <= len(want) and kept.columns == m.columns
    assert window_s > 86_400 or len(want) > 20


def test_check_keys(spark):
    events = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "idempotency_id string")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "idempotency_id string")
    assert sorted(tuple(r) for r in E.check_keys(events, wanted).collect()) == [("a", "unique"), ("b", "duplicate"), ("c", "not_found")]


def test_validation_codes(spark):
    rows = [('{"u": "ab", "n": 1}', None), ('{"u": "a", "n": 1}', "MINLENGTH_U"), ('{"u": 5, "n": 1}', "TYPE_U"), ('{"u": "ab", "n": "x"}', "TYPE_N"), ('{"u": "ab", "n": -1}', "MINIMUM_N"), ('{"n": 1}', "MISSING_U"), ("{", "INVALID_JSON"), (None, "INVALID_JSON")]
    df = spark.createDataFrame([(v, "view") for v, _ in rows], "value string, event_type string")
    got = E.validate_events(df, {"u": "string", "n": "number"}, {"n": 0}, ["view"], {"u": 2}).collect()
    assert [r.error_code for r in got] == [c for _, c in rows]


def test_replayed_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "X"), (3, None)], "k int, error_code string")
    ok, dlq = str(tmp_path / "ok"), str(tmp_path / "dlq")
    for batch_id in (0, 1, 1):
        E.write_batch(df, batch_id, ok, dlq)
    assert spark.read.parquet(ok).count() == 4 and spark.read.parquet(dlq).count() == 2


def test_order_violations(spark, sf_dir, tmp_path):
    rows = Inputs(spark, sf_dir).messages.withColumn("ts", F.expr("CASE WHEN msg_offset % 8 = 0 THEN ts - INTERVAL 1 DAY ELSE ts END"))
    batch, stream = staged(spark, sf_dir, tmp_path, rows)
    found = run(E.order_violations_stream(stream), tmp_path, "order")
    want = E.order_violations(batch).select("idempotency_id", "msg_offset")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() > 0


def test_state_of_silent_keys_falls(spark, tmp_path):
    """Once other keys' events have moved the watermark past a key's latest time, nothing is kept of it."""
    kind, folder, out = "idempotency_id string, msg_offset long, ts timestamp", str(tmp_path / "in"), str(tmp_path / "out")

    def put(rows):
        spark.createDataFrame(rows, "idempotency_id string, msg_offset long, ts string").selectExpr("idempotency_id", "msg_offset", "CAST(ts AS TIMESTAMP) AS ts").coalesce(1).write.mode("append").parquet(folder)
        found = E.order_violations_stream(spark.readStream.schema(kind).parquet(folder), late="1 day")
        query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start()
        query.awaitTermination()
        return query.recentProgress[-1].stateOperators[0].numRowsTotal

    assert put([("a", 1, "2024-01-02 00:00:00"), ("b", 2, "2024-01-02 00:00:00"), ("c", 3, "2024-01-02 00:00:00")]) == 3
    assert put([("a", 4, "2024-01-01 23:00:00")]) == 3
    assert put([("d", 5, "2024-02-01 00:00:00")]) == 1
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [("a", 4)]


def test_validate_and_route(spark, sf_dir, tmp_path):
    batch, stream = staged(spark, sf_dir, tmp_path)
    check = lambda df: E.validate_events(df, {"k": "number"}, {"k": 50})
    query = E.write_checked(check(stream), str(tmp_path / "ok"), str(tmp_path / "dlq"), str(tmp_path / "cp"))
    query.awaitTermination()
    want = check(batch)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == want.filter("error_code IS NULL").count() > 0
    assert spark.read.parquet(str(tmp_path / "dlq")).count() == want.filter("error_code IS NOT NULL").count() > 0


def test_dlq_depth(spark, sf_dir, tmp_path):
    batch, stream = staged(spark, sf_dir, tmp_path)
    got = run(E.dlq_depth(stream, 5, late="3650 days"), tmp_path, "depth").collect()
    assert got == []  # no window closes before the watermark passes it
    early = run(E.dlq_depth(stream, 5, late="0 seconds"), tmp_path, "depth2").collect()
    full = {(r.topic, r.start): r.depth for r in E.dlq_depth(batch, 5).collect()}
    assert early and all(full[r.topic, r.start] >= r.depth for r in early)


def test_incremental_consume(spark, sf_dir, tmp_path):
    m, _ = staged(spark, sf_dir, tmp_path)
    args = (spark, str(tmp_path / "in"), m.schema, str(tmp_path / "sink"), str(tmp_path / "sink-cp"))
    assert E.incremental_consume(*args) == m.count()
    assert E.incremental_consume(*args) == 0
    m.limit(7).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert E.incremental_consume(*args) == 7
    assert spark.read.parquet(str(tmp_path / "sink")).count() == m.count() + 7
