"""Queries of decision records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as K
from .registry import register

DAY = "1999-06-01"
ST = "CASE o_orderkey % 6 WHEN 0 THEN 'pattern' WHEN 1 THEN 'resolved' WHEN 2 THEN 'open' WHEN 3 THEN 'experimental' WHEN 4 THEN 'archived' ELSE 'other' END"


def ranked(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.expr(ST).alias("status"), F.expr("concat('P', o_custkey % 4)").alias("product"), F.to_date("o_orderdate").alias("created"))
    return K.rank_decisions(rows, "P1", DAY)


RANK = f""", d AS (SELECT o_orderkey AS id, {ST} AS status, 'P' || CAST(o_custkey % 4 AS VARCHAR) AS product, CAST(o_orderdate AS DATE) AS created, date_diff('day', CAST(o_orderdate AS DATE), DATE '{DAY}') AS days FROM orders),
b AS (SELECT *, CASE status WHEN 'pattern' THEN 50 WHEN 'resolved' THEN 30 WHEN 'open' THEN 10 WHEN 'experimental' THEN 5 ELSE 0 END + CASE WHEN product = 'P1' THEN 45 ELSE 0 END + CASE WHEN days < 30 THEN 20 WHEN days < 90 THEN 15 WHEN days < 365 THEN 10 ELSE 0 END AS base FROM d),
r AS (SELECT id, status, product, created, CAST(CASE WHEN days > 730 AND status <> 'pattern' THEN base // 2 ELSE base END - CASE WHEN status = 'archived' THEN 100 ELSE 0 END AS BIGINT) AS score FROM b)"""
register("tk3_rank_decisions", ranked, "", RANK + "SELECT * FROM r")
register("tk6_paginate", lambda t: K.paginate(ranked(t), [F.desc("score"), F.desc("created"), F.col("id")], 25, 3), "", RANK + "SELECT * FROM r ORDER BY score DESC, created DESC, id LIMIT 25 OFFSET 50")


def tagged(t):
    return t.decisions.withColumn("tags", F.array("tag", F.expr("concat('q', quarter(created))"), "product")).withColumn("domain", F.expr("concat('D', id % 3)"))


register("tk4_tag_filter", lambda t: K.tag_filter(tagged(t), every=["q1"], some=["1-URGENT", "2-HIGH"], none=["P2"]).select("id"), "decisions", "SELECT id FROM decisions WHERE quarter(created) = 1 AND tag IN ('1-URGENT', '2-HIGH') AND product <> 'P2'")
register("tk5_dedup_results", lambda t: K.dedup_results(t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))), "", "SELECT min(doc_id) AS id, coalesce(array_to_string(list_sort(list(doc_id))[2:], ','), '') AS also_in FROM documents GROUP BY array_to_string(string_split(text, chr(10))[1:10], chr(10))")
register("tk5_primary_results", lambda t: K.primary_results(t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))), "", "SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY array_to_string(string_split(text, chr(10))[1:10], chr(10))) AS primary_id FROM documents")
register("ag12_tag_index", lambda t: K.tag_index(tagged(t)), "decisions", """
, x AS (SELECT id, product, 'D' || CAST(id % 3 AS VARCHAR) AS domain, unnest([tag, 'q' || CAST(quarter(created) AS VARCHAR), product]) AS tag FROM decisions)
SELECT tag, count(DISTINCT id) AS n, string_agg(DISTINCT product, ',' ORDER BY product) AS products, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains FROM x GROUP BY tag""")
register("ag12_decision_counts", lambda t: K.decision_counts(t.decisions), "decisions", """
, x AS (SELECT tag, product, status, CAST(year(created) AS VARCHAR) || 'Q' || CAST(quarter(created) AS VARCHAR) AS quarter FROM decisions) SELECT tag, product, status, quarter, count(*) AS n FROM x GROUP BY GROUPING SETS ((tag), (product), (status), (quarter))""")
register("ag13_lifecycle_dashboard", lambda t: K.lifecycle_dashboard(t.decisions, t.links, DAY), "decisions links", f"""
, p AS (SELECT src, count(*) AS c FROM links GROUP BY src)
SELECT status, count(*) AS n, avg(date_diff('day', created, DATE '{DAY}')) AS mean_days, count(*) FILTER (WHERE c IS NULL) AS no_dependents, count(*) FILTER (WHERE created < DATE '{DAY}' - INTERVAL 18 MONTH) AS stale, count(*) FILTER (WHERE c >= 100) AS red_flags FROM decisions LEFT JOIN p ON id = src GROUP BY status""")
register("lc1_demote", lambda t: K.demote(t.decisions.withColumnRenamed("created", "since"), DAY), "decisions", f"""
, n AS (SELECT *, CASE WHEN status = 'Active' AND created + INTERVAL 6 MONTH < DATE '{DAY}' THEN 'Warm' WHEN status = 'Warm' AND created + INTERVAL 3 MONTH < DATE '{DAY}' THEN 'Cold' WHEN status = 'Cold' AND created + INTERVAL 12 MONTH < DATE '{DAY}' AND NOT evergreen THEN 'Archived' END AS new FROM decisions)
SELECT id, coalesce(new, status) AS status, CASE WHEN new IS NULL THEN created ELSE DATE '{DAY}' END AS since, CASE WHEN new IS NOT NULL THEN 'age' END AS reason, CASE new WHEN 'Warm' THEN 'team: informational' WHEN 'Cold' THEN 'team: review' WHEN 'Archived' THEN 'audit: archived' END AS notice FROM n""")
register("lc2_archive_candidates", lambda t: K.archive_candidates(t.decisions, t.links, DAY), "decisions links", f"""
, p AS (SELECT src, count(*) AS c, max(dst) AS m FROM links GROUP BY src)
SELECT id, date_diff('day', created, DATE '{DAY}') AS age_days, coalesce(c, 0) AS dependents, m AS last_reference FROM decisions LEFT JOIN p ON id = src WHERE status = 'Cold' AND NOT evergreen AND created + INTERVAL 12 MONTH <= DATE '{DAY}'""")
register("ag16_promote_patterns", lambda t: K.promote_patterns(t.lineitem.select(F.expr("concat('pt', l_partkey, '-', l_linenumber)").alias("pattern"), F.expr("concat('P', l_orderkey % 3)").alias("product"))), "", """
SELECT pattern, n, products, CASE WHEN products >= 3 THEN 'skill_candidate' WHEN n >= 2 THEN 'active' ELSE 'warm' END AS state FROM (SELECT 'pt' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS pattern, count(*) AS n, count(DISTINCT l_orderkey % 3) AS products FROM lineitem GROUP BY 1)""")
