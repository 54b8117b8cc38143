"""Queries of event checks, in batch form; the streaming forms are tested against these."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as E
from .registry import register
from .shared import fresh_path


def mixed(t):
    """Messages, some of them broken."""
    return t.messages.withColumn("value", F.expr("CASE msg_offset % 10 WHEN 0 THEN '{bad' WHEN 1 THEN '{\"x\": 1}' WHEN 2 THEN '{\"k\": \"word\"}' ELSE value END"))


register("ev1_match_events", lambda t: E.match_events(t.messages, "p*", {"k": "7"}), "messages", "SELECT count(*) FILTER (WHERE event_type LIKE 'p%' AND value = '{\"k\": 7}') AS matched, count(*) AS total, count(*) FILTER (WHERE event_type LIKE 'p%' AND value = '{\"k\": 7}') >= 1 AS passed FROM messages")
register("ev2_dedup_events", lambda t: E.dedup_events_batch(t.messages, 3600).select("idempotency_id", "msg_offset", "state"), "messages", """
SELECT idempotency_id, msg_offset, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY idempotency_id ORDER BY ts, msg_offset) <= 3600000000 THEN 'duplicate' ELSE 'unique' END AS state FROM messages""")
register("ev2_check_keys", lambda t: E.check_keys(t.messages, t.customer.select(F.expr("concat(c_custkey, CASE c_custkey % 2 WHEN 0 THEN ':view' ELSE ':click' END)").alias("idempotency_id"))), "messages", """
, w AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) || CASE c_custkey % 2 WHEN 0 THEN ':view' ELSE ':click' END AS idempotency_id FROM customer), n AS (SELECT idempotency_id, count(*) AS n FROM messages GROUP BY 1)
SELECT w.idempotency_id, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'duplicate' ELSE 'unique' END AS state FROM w LEFT JOIN n ON w.idempotency_id = n.idempotency_id""")
register("ev3_lengths_and_types", lambda t: E.validate_events(t.messages.withColumn("value", F.expr("concat('{\"u\": ', CASE msg_offset % 4 WHEN 0 THEN '7' ELSE concat('\"', idempotency_id, '\"') END, '}')")), {"u": "string"}, min_length={"u": 7}).select("msg_offset", "error_code"), "messages", """
SELECT msg_offset, CASE WHEN msg_offset % 4 = 0 THEN 'TYPE_U' WHEN length(idempotency_id) < 7 THEN 'MINLENGTH_U' END AS error_code FROM messages""")
CODE = """CASE msg_offset % 10 WHEN 0 THEN 'INVALID_JSON' WHEN 1 THEN 'MISSING_K' WHEN 2 THEN 'TYPE_K' ELSE CASE WHEN CAST(regexp_extract(value, '([0-9]+)', 1) AS INT) < 20 THEN 'MINIMUM_K' WHEN event_type = 'error' THEN 'UNKNOWN_TYPE' END END"""


def checked(t):
    return E.validate_events(mixed(t), {"k": "number"}, {"k": 20}, ["view", "click", "purchase", "signup"])


register("ev3_validate_events", lambda t: checked(t).select("msg_offset", "error_code"), "messages", f"SELECT msg_offset, {CODE} AS error_code FROM messages")
register("ev3_route_events", lambda t: E.route_events(checked(t).withColumn("error_code", F.expr("CASE WHEN msg_offset % 10 = 3 THEN 'TIMEOUT' ELSE error_code END")), F.expr("msg_offset % 7")).groupBy("route").agg(F.count("*").alias("n")), "messages", f"""
SELECT CASE WHEN e IS NULL THEN 'ok' WHEN e = 'TIMEOUT' AND msg_offset % 7 < 3 THEN 'retry' ELSE 'dlq' END AS route, count(*) AS n FROM (SELECT msg_offset, CASE WHEN msg_offset % 10 = 3 THEN 'TIMEOUT' ELSE {CODE} END AS e FROM messages) GROUP BY 1""")
register("ev4_dlq_depth", lambda t: E.dlq_depth(checked(t).filter("error_code IS NOT NULL"), 5).withColumn("start", F.col("start").cast("string")), "messages", f"SELECT topic, CAST(date_trunc('hour', ts) AS VARCHAR) AS start, count(*) AS depth, count(*) > 5 AS alert FROM messages WHERE {CODE} IS NOT NULL GROUP BY 1, 2")
register("ev5_order_violations", lambda t: E.order_violations(t.messages.withColumn("ts", F.expr("CASE WHEN msg_offset % 8 = 0 THEN ts - INTERVAL 1 DAY ELSE ts END"))).select("idempotency_id", "msg_offset"), "messages", """
, m AS (SELECT idempotency_id, msg_offset, CASE WHEN msg_offset % 8 = 0 THEN ts - INTERVAL 1 DAY ELSE ts END AS ts FROM messages) SELECT idempotency_id, msg_offset FROM (SELECT *, max(ts) OVER (PARTITION BY idempotency_id ORDER BY msg_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM m) WHERE ts < l""")
register("ev6_partition_skew", lambda t: E.partition_skew(t.messages, "1 day", 10).withColumn("start", F.col("start").cast("string")), "messages", "SELECT topic, start, CAST(sum(n) AS BIGINT) AS n, max(n) - min(n) AS spread, max(n) - min(n) > 10 AS skewed FROM (SELECT topic, CAST(date_trunc('day', ts) + INTERVAL 0 SECOND AS VARCHAR) AS start, part_no, count(*) AS n FROM messages GROUP BY 1, 2, 3) GROUP BY 1, 2")
register("ev6_consumer_lag", lambda t: E.consumer_lag(t.messages, t.messages.filter("msg_offset % 5 = 0 AND part_no < 3").groupBy("topic", "part_no").agg(F.min_by("msg_offset", F.expr("abs(msg_offset - 300)")).alias("committed"))), "messages", """
, c AS (SELECT topic, part_no, arg_min(msg_offset, abs(msg_offset - 300)) AS committed FROM messages WHERE msg_offset % 5 = 0 AND part_no < 3 GROUP BY 1, 2), h AS (SELECT topic, part_no, max(msg_offset) + 1 AS high, min(msg_offset) AS low FROM messages GROUP BY 1, 2)
SELECT h.topic, h.part_no, high - coalesce(committed, low) AS lag, high - coalesce(committed, low) > 0.5 * (high - low) AS alert FROM h LEFT JOIN c ON h.topic = c.topic AND h.part_no = c.part_no""")


def consumed(t):
    """Two runs over a folder that grows between them: each takes only what is new."""
    source, sink, log = (fresh_path(t.spark, n) for n in ("events", "sink", "offsets"))
    first, second = t.messages.filter("msg_offset % 3 > 0"), t.messages.filter("msg_offset % 3 = 0")
    first.write.parquet(source)
    E.incremental_consume(t.spark, source, first.schema, sink, log)
    second.write.mode("append").parquet(source)
    E.incremental_consume(t.spark, source, first.schema, sink, log)
    return t.spark.read.schema(first.schema).parquet(sink).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("msg_offset").alias("offsets"))


register("ev7_incremental_consume", consumed, "messages", "SELECT event_type, count(*) AS n, count(DISTINCT msg_offset) AS offsets FROM messages GROUP BY 1")
