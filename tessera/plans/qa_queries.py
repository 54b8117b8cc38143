"""Queries of test evidence and table checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import qa as A
from ..operators.graph import skip_propagation
from ..operators.ordered import first_row_match, numbered, ordered_match, row_differences
from .registry import register
from .shared import checkpoint_dir

SURF = ["web-cdp", "rest", "db", "cache", "bus"]


def steps(t):
    return t.steps.withColumn("depends_on", F.filter(F.split("depends_on", ","), lambda x: x != ""))


register("jn12_missing_dependencies", lambda t: A.missing_dependencies(steps(t)), "steps", "SELECT task_id, id, depends_on AS dependency FROM steps s WHERE depends_on <> '' AND NOT EXISTS (SELECT 1 FROM steps p WHERE p.task_id = s.task_id AND p.id = s.depends_on)")
register("qa1_validate_steps", lambda t: A.validate_steps(steps(t).unionByName(steps(t).filter("row_no % 50 = 7")), SURF), "steps", """
, s2 AS (SELECT * FROM steps UNION ALL SELECT * FROM steps WHERE row_no % 50 = 7)
SELECT task_id, id, 'unknown surface' AS error FROM s2 WHERE lower(surface) = 'fax' UNION ALL SELECT task_id, id, 'duplicate id' FROM s2 WHERE row_no % 50 = 7
UNION ALL SELECT task_id, id, 'unknown dependency' FROM s2 s WHERE depends_on <> '' AND NOT EXISTS (SELECT 1 FROM steps p WHERE p.task_id = s.task_id AND p.id = s.depends_on)""")


def circular(t):
    """Steps of which the first of every fifth task waits for one that waits for it; tasks of every seventh file have no ids."""
    late = t.steps.withColumn("depends_on", F.expr("CASE WHEN id = 's0' AND task_id % 5 = 0 THEN 's9' ELSE depends_on END")).withColumn("id", F.expr("CASE WHEN task_id % 7 = 3 THEN NULL ELSE id END"))
    return late.withColumn("depends_on", F.expr("filter(split(CASE WHEN id IS NULL THEN '' ELSE depends_on END, ','), x -> x <> '')"))


register("qa1_step_file_errors", lambda t: A.validate_steps(circular(t), [*SURF, "fax"]), "steps", """
, s2 AS (SELECT task_id, CASE WHEN task_id % 7 = 3 THEN NULL ELSE id END AS id, CASE WHEN task_id % 7 = 3 THEN '' WHEN id = 's0' AND task_id % 5 = 0 THEN 's9' ELSE depends_on END AS dep FROM steps),
e AS (SELECT s.task_id, s.dep AS src, s.id AS dst FROM s2 s WHERE EXISTS (SELECT 1 FROM s2 p WHERE p.task_id = s.task_id AND p.id = s.dep)),
r(task_id, a, b) AS (SELECT task_id, src, dst FROM e UNION SELECT r.task_id, r.a, e.dst FROM r JOIN e ON e.task_id = r.task_id AND e.src = r.b)
SELECT task_id, a AS id, 'dependency cycle' AS error FROM r WHERE a = b UNION ALL SELECT task_id, NULL, 'no steps' FROM s2 GROUP BY task_id HAVING count(id) = 0
UNION ALL SELECT task_id, id, 'unknown dependency' FROM s2 s WHERE dep <> '' AND NOT EXISTS (SELECT 1 FROM s2 p WHERE p.task_id = s.task_id AND p.id = s.dep)""")
register("qa2_eval_manifest", lambda t: A.eval_manifest(t.results), "results", "SELECT run_id, count(*) AS step_count, CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'red' ELSE 'green' END AS outcome FROM results GROUP BY run_id")


def scenarios(t):
    step = "named_struct('id', CASE WHEN l_linenumber = 7 THEN 'Bad Id' ELSE concat('s', l_linenumber) END, 'driver', CASE WHEN l_linenumber % 2 = 0 THEN 'api' ELSE 'db' END, 'action', CASE WHEN l_linenumber % 3 = 0 THEN 'get' ELSE 'query' END, 'expected', CASE WHEN l_linenumber = 5 THEN map() ELSE map('status', l_returnflag) END)"
    made = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.expr(step)).alias("steps"))
    return t.orders.select(F.col("o_orderkey").alias("k"), "o_orderpriority").join(made, "k", "left").select(F.concat(F.lit("L"), F.col("k")).alias("label"), F.expr("CASE WHEN o_orderpriority = '1-URGENT' THEN ' ' ELSE o_orderpriority END").alias("scenario"), "steps")


register("qa3_validate_scenarios", lambda t: A.validate_scenarios(scenarios(t), [("api", "get"), ("db", "query")]), "", """
WITH s AS (SELECT 'L' || CAST(l_orderkey AS VARCHAR) AS label, l_linenumber AS n, CASE WHEN l_linenumber = 7 THEN 'Bad Id' ELSE 's' || CAST(l_linenumber AS VARCHAR) END AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 'L' || CAST(o_orderkey AS VARCHAR) AS label, '' AS id, 'missing scenario' AS error FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'L' || CAST(o_orderkey AS VARCHAR), '', 'no steps' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT label, id, 'bad step id' FROM s WHERE n = 7 UNION ALL SELECT label, id, 'empty expected' FROM s WHERE n = 5
UNION ALL SELECT label, id, 'driver and action do not pair' FROM s WHERE NOT ((n % 2 = 0 AND n % 3 = 0) OR (n % 2 = 1 AND n % 3 <> 0))
UNION ALL SELECT label, id, 'duplicate step id' FROM (SELECT *, count(*) OVER (PARTITION BY label, id) AS c FROM s) WHERE c > 1""")
CLASS = "CASE WHEN status = 'PASS' THEN 'STEP_PASS' WHEN status = 'FAIL' AND critical THEN 'STEP_FAIL_CRITICAL' WHEN status = 'FAIL' THEN 'STEP_FAIL_NON_CRITICAL' WHEN status = 'SKIP' THEN 'STEP_SKIPPED' ELSE 'STEP_ERROR' END"
register("qa4_classify_steps", lambda t: A.classify_steps(t.results), "results", f"SELECT *, {CLASS} AS classification FROM results")
register("wn6_halt_on_stop", lambda t: A.halt_on_stop(t.results), "results", """
SELECT run_id, scenario, step, CASE WHEN coalesce(max(CASE WHEN status = 'FAIL' AND failure_mode = 'stop' THEN 1 END) OVER (PARTITION BY run_id, scenario ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'SKIP' ELSE status END AS status, failure_mode, critical, duration_ms FROM results""")


def retried(t):
    history = F.expr("CASE WHEN step % 4 = 0 THEN array('FAIL', 'PASS', 'FAIL') ELSE array('PASS') END")
    error = "CASE step % 6 WHEN 0 THEN 'HTTP 503 returned' WHEN 1 THEN 'expected 4 got 5' WHEN 2 THEN 'connection refused' WHEN 3 THEN 'TypeError: x; timeout' WHEN 4 THEN 'got 404' ELSE '' END"
    return t.results.withColumn("status", F.expr("CASE WHEN run_id % 3 = 0 AND status = 'FAIL' THEN 'PASS' ELSE status END")).withColumn("retry_count", F.expr("int(CASE WHEN step % 4 = 0 THEN 3 ELSE 0 END)")).withColumn("retry_history", history).withColumn("error", F.expr(error)).withColumn("sla_ms", F.expr("CASE WHEN step % 5 = 0 THEN 10.0D END"))


RETRIED = """, r AS (SELECT * REPLACE (CASE WHEN run_id % 3 = 0 AND status = 'FAIL' THEN 'PASS' ELSE status END AS status), CASE WHEN step % 4 = 0 THEN 3 ELSE 0 END AS retry_count, CASE WHEN step % 5 = 0 THEN CAST(10.0 AS DOUBLE) END AS sla_ms,
 CASE step % 6 WHEN 0 THEN 'HTTP 503 returned' WHEN 1 THEN 'expected 4 got 5' WHEN 2 THEN 'connection refused' WHEN 3 THEN 'TypeError: x; timeout' WHEN 4 THEN 'got 404' ELSE '' END AS error FROM results)"""
register("qa5_verdict", lambda t: A.verdict(retried(t)), "results", RETRIED + f""", c AS (SELECT *, {CLASS} AS k FROM r),
g AS (SELECT run_id, count(*) AS step_count, count(*) FILTER (WHERE k = 'STEP_PASS') AS passed, count(*) FILTER (WHERE k = 'STEP_SKIPPED') AS skipped, count(*) FILTER (WHERE k = 'STEP_FAIL_CRITICAL') AS crit, count(*) FILTER (WHERE retry_count >= 3) AS flaky, count(*) FILTER (WHERE k = 'STEP_FAIL_NON_CRITICAL') AS minor FROM c GROUP BY run_id)
SELECT run_id, CASE WHEN crit > 0 THEN 'FAIL_CRITICAL' WHEN flaky > 0 THEN 'FAIL_FLAKY' WHEN minor > 0 THEN 'PARTIAL_PASS_NON_CRITICAL' WHEN skipped = step_count THEN 'NO_EXECUTION' ELSE 'ALL_PASS' END AS reason,
 CASE WHEN crit > 0 OR flaky > 0 THEN 'RED' WHEN minor > 0 THEN 'YELLOW' WHEN skipped = step_count THEN 'RED' ELSE 'GREEN' END AS verdict, step_count, passed, skipped FROM g""")
register("qa6_confidence", lambda t: A.confidence(retried(t)).select("run_id", "scenario", "step", "confidence", "signal_only"), "results", RETRIED + """
SELECT run_id, scenario, step, confidence, confidence = 'LOW' AS signal_only FROM (SELECT *, CASE WHEN step % 6 IN (0, 1, 4) THEN 'HIGH' WHEN sla_ms < duration_ms THEN 'HIGH' WHEN step % 6 IN (2, 3) THEN 'MODERATE' WHEN retry_count > 0 THEN 'MODERATE' ELSE 'LOW' END AS confidence FROM r WHERE status = 'FAIL')""")
register("qa7_sla_breaches", lambda t: A.sla_breaches(retried(t)).select("run_id", "scenario", "step", "duration_ms", "sla_ms"), "results", RETRIED + "SELECT run_id, scenario, step, duration_ms, sla_ms FROM r WHERE duration_ms > sla_ms")
register("qa7_timing_report", lambda t: A.timing_report(t.results), "results", "SELECT scenario, count(*) AS n, sum(duration_ms) AS total_ms, quantile_cont(duration_ms, 0.95) AS p95_ms FROM results GROUP BY scenario")
register("qa8_triage", lambda t: A.triage(retried(t).select(F.concat_ws("/", "run_id", "step").alias("id"), F.col("error").alias("message"))), "results", RETRIED + """
SELECT CAST(run_id AS VARCHAR) || '/' || CAST(step AS VARCHAR) AS id, CASE step % 6 WHEN 2 THEN 'environment' WHEN 3 THEN 'flaky' ELSE 'uncertain' END AS kind, CASE step % 6 WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE 'low' END AS confidence FROM r""")
register("qa9_locate_fault", lambda t: A.locate_fault(retried(t)), "results", RETRIED + """
SELECT run_id, scenario, step, CASE step % 6 WHEN 0 THEN 'gateway' WHEN 4 THEN 'routing' ELSE 'unknown' END AS service FROM (SELECT *, row_number() OVER (PARTITION BY run_id, scenario ORDER BY step) AS n FROM r WHERE status = 'FAIL') WHERE n = 1""")
FIRST = """, f AS (SELECT task_id, min(CASE WHEN text LIKE '[P4.1-DISPATCH]%' THEN line_no END) AS d, min(CASE WHEN text LIKE '[P4.0-EVAL-YAML]%' THEN line_no END) AS e, min(CASE WHEN text LIKE '[P4.0-QA-CSV] approved=yes%' THEN line_no END) AS q, min(CASE WHEN text LIKE '[P4.0-TDD-RED]%' THEN line_no END) AS t FROM log GROUP BY task_id)"""
register("wn3_marker_order", lambda t: A.marker_order(t.log), "log", FIRST + """
SELECT task_id, 'dispatch before evidence' AS violation FROM f WHERE d IS NOT NULL AND (e IS NULL OR d < e) UNION ALL SELECT task_id, 'evidence before QA approval' FROM f WHERE e IS NOT NULL AND (q IS NULL OR e < q)
UNION ALL SELECT task_id, 'dispatch before TDD' FROM f WHERE d IS NOT NULL AND (t IS NULL OR d < t)""")
register("wn3_untimed_markers", lambda t: A.untimed_markers(t.log), "log", "SELECT task_id, count(*) FILTER (WHERE text LIKE '[P%') AS untimed FROM log GROUP BY task_id")
register("wn5_latest_state", lambda t: A.latest_state(t.log), "log", "SELECT task_id, arg_max(replace(regexp_extract(text, 'open_doubts=(.*)', 1), '\"', ''), line_no) AS value FROM log WHERE text LIKE '[TERMINOLOGY]%' GROUP BY task_id")
def partly_silent(t):
    """The log, later lines of every second task turned into notes."""
    return t.log.withColumn("text", F.expr("CASE WHEN task_id % 2 = 0 OR line_no < 4 THEN text ELSE concat('note: ', text) END"))


register("st6_missing_gates", lambda t: A.missing_gates(partly_silent(t)), "log", """
, l AS (SELECT * REPLACE (CASE WHEN task_id % 2 = 0 OR line_no < 4 THEN text ELSE 'note: ' || text END AS text) FROM log), g AS (SELECT task_id, bool_or(text LIKE '[P4.0-EVAL%') AS e, bool_or(text LIKE '[P4.0-QA-CSV] approved=yes%') AS q, bool_or(text LIKE '[P4.0-TDD%') AS t, bool_or(text LIKE '[P4.1%') AS d FROM l GROUP BY task_id)
SELECT task_id, CASE WHEN NOT e THEN 'eval' WHEN NOT q THEN 'qa' WHEN NOT t THEN 'tdd' WHEN NOT d THEN 'dispatch' END AS next_gate, CAST(CAST(NOT e AS INT) + CAST(NOT q AS INT) + CAST(NOT t AS INT) + CAST(NOT d AS INT) AS BIGINT) AS missing FROM g""")
register("st7_gate_ledger_errors", lambda t: A.gate_ledger_errors(partly_silent(t)), "log", """
, l AS (SELECT * REPLACE (CASE WHEN task_id % 2 = 0 OR line_no < 4 THEN text ELSE 'note: ' || text END AS text) FROM log), g AS (SELECT task_id, bool_or(text LIKE '[P4.0-EVAL%') AS e, bool_or(text LIKE '[P4.0-QA-CSV] approved=yes%') AS q, bool_or(text LIKE '[P4.0-TDD%') AS t, bool_or(text LIKE '[P4.1%') AS d FROM l GROUP BY task_id)
SELECT task_id, 'dispatch without evidence' AS error FROM g WHERE d AND NOT e UNION ALL SELECT task_id, 'evidence without QA' FROM g WHERE e AND NOT q UNION ALL SELECT task_id, 'dispatch without TDD' FROM g WHERE d AND NOT t""")


def ledger(t):
    rel = "CASE WHEN doc_id % 9 = 0 THEN concat('../', doc_id) ELSE concat('out/', doc_id, '.md') END"
    art = f"named_struct('relpath', {rel}, 'sha256', CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE sha2(text, 256) END)"
    return t.documents.select(F.expr("doc_id % 50").alias("task_id"), F.concat(F.lit("P"), F.col("doc_id")).alias("marker"), F.expr(f"CASE WHEN doc_id % 11 = 0 THEN NULL ELSE array({art}) END").alias("artifacts")), t.documents.filter("doc_id % 5 <> 0").select(F.expr("doc_id % 50").alias("task_id"), F.expr("concat('out/', doc_id, '.md')").alias("relpath"), F.col("text").alias("content"))


register("jn14_ledger_verify", lambda t: A.ledger_verify(*ledger(t)), "", """
SELECT doc_id % 50 AS task_id, 'P' || CAST(doc_id AS VARCHAR) AS marker, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 9 = 0 THEN '../' || CAST(doc_id AS VARCHAR) ELSE 'out/' || CAST(doc_id AS VARCHAR) || '.md' END AS relpath,
 CASE WHEN doc_id % 11 = 0 THEN 'no artifacts' WHEN doc_id % 9 = 0 THEN 'unsafe path' WHEN doc_id % 5 = 0 THEN 'missing file' ELSE 'hash mismatch' END AS error FROM documents WHERE doc_id % 11 = 0 OR doc_id % 9 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0""")


def drift(t):
    prd = t.orders.select(F.col("o_orderkey").alias("task_id"), F.expr("concat('# PRD\n## Success Criteria\n- Priority is ', o_orderpriority, '\n* short\n- Customer ', o_custkey, ' is served\n## Other\n- not a criterion here')").alias("content"))
    return prd, t.orders.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("task_id"), F.expr("concat('checked: PRIORITY IS ', o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN concat(' customer ', o_custkey, ' is served') ELSE '' END)").alias("text"))


register("jn15_drift_check", lambda t: A.drift_check(*drift(t)), "", """
SELECT o_orderkey AS task_id, 'Priority is ' || o_orderpriority AS criterion FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, 'Customer ' || CAST(o_custkey AS VARCHAR) || ' is served' FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 2 <> 0""")


def propagate(t):
    checkpoint_dir(t.spark)
    deps = steps(t).select("task_id", "id", F.explode("depends_on").alias("dependency")).filter("dependency <> 'missing' AND dependency <> id")
    status = steps(t).select("task_id", "id", F.expr("CASE WHEN row_no % 7 = 0 THEN 'FAIL' ELSE 'PASS' END").alias("status"))
    return skip_propagation(status, deps)


register("gr5_skip_propagation", propagate, "steps", """
, d AS (SELECT task_id, id, depends_on AS dep FROM steps WHERE depends_on NOT IN ('', 'missing') AND depends_on <> id), s AS (SELECT task_id, id, CASE WHEN row_no % 7 = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM steps),
bad(task_id, id) AS (SELECT task_id, id FROM s WHERE status <> 'PASS' UNION SELECT d.task_id, d.id FROM bad b JOIN d ON d.task_id = b.task_id AND d.dep = b.id),
sk AS (SELECT DISTINCT d.task_id, d.id FROM d JOIN bad b ON d.task_id = b.task_id AND d.dep = b.id)
SELECT s.task_id, s.id, CASE WHEN sk.id IS NOT NULL THEN 'SKIPPED' ELSE status END AS status FROM s LEFT JOIN sk ON s.task_id = sk.task_id AND s.id = sk.id""")

register("dq1_assert_table", lambda t: A.assert_table(t.orders, min_count=10, constant={"o_orderstatus": "O"}), "", "SELECT count(*) >= 10 AND count(*) FILTER (WHERE o_orderstatus IS DISTINCT FROM 'O') = 0 AS passed, count(*) AS actual_count FROM orders")


def _expected_orders(t):
    """Orders by date and key with their numbers; some prices are wrong, and the last rows are missing."""
    rows = numbered(t.orders.select("o_orderkey", "o_orderdate", "o_totalprice"), ["o_orderdate", "o_orderkey"])
    return rows.withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 97 = 5 THEN -1D ELSE o_totalprice END")).filter("o_orderkey % 1000 <> 999 OR row_no < 10").drop("o_orderdate")


ORDERED = ", n AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_no FROM orders), d AS (SELECT * FROM n WHERE o_orderkey % 97 = 5 OR (o_orderkey % 1000 = 999 AND row_no >= 10))"
register("dq1_row_differences", lambda t: row_differences(t.orders, _expected_orders(t), ["o_orderdate", "o_orderkey"]).select("row_no", "column"), "", ORDERED + """
SELECT row_no, 'o_totalprice' AS "column" FROM d UNION ALL SELECT row_no, 'o_orderkey' FROM d WHERE o_orderkey % 1000 = 999 AND row_no >= 10""")
register("dq1_ordered_match", lambda t: ordered_match(t.orders, _expected_orders(t), ["o_orderdate", "o_orderkey"]), "", ORDERED + "SELECT count(*) = 0 AS passed, min(row_no) AS first_difference, count(*) AS rows_differ FROM d")
register("dq1_first_row", lambda t: first_row_match(t.lineitem, ["l_orderkey", "l_linenumber"], {"l_linenumber": 1, "l_returnflag": "R"}), "", "SELECT (SELECT l_linenumber = 1 AND l_returnflag = 'R' FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1) AS passed, count(*) AS actual_count FROM lineitem")
register("dq2_orphan_rows", lambda t: A.orphan_rows(t.lineitem, t.orders.filter("o_orderkey % 3 <> 0"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_partkey", "l_linenumber"), "", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)")
register("dq3_total_mismatch", lambda t: A.total_mismatch(t.orders, t.lineitem, "o_orderkey", "l_orderkey", "o_totalprice", F.expr("l_extendedprice * (1 - l_discount) * (1 + l_tax)")).select("o_orderkey", "o_totalprice", F.round("lines_total", 1).alias("lines_total")), "", """
WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS s FROM lineitem GROUP BY 1) SELECT o_orderkey, o_totalprice, round(coalesce(s, 0), 1) AS lines_total FROM orders LEFT JOIN l ON o_orderkey = l_orderkey WHERE abs(o_totalprice - coalesce(s, 0)) > 0.005""")
register("dq4_duplicate_keys", lambda t: A.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"]), "", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
register("dq4_null_violations", lambda t: A.null_violations(t.orders.withColumn("o_custkey", F.expr("nullif(o_custkey % 5, 0)")), ["o_orderkey", "o_custkey"]), "", "SELECT 'o_orderkey' AS \"column\", count(*) FILTER (WHERE o_orderkey IS NULL) AS nulls FROM orders UNION ALL SELECT 'o_custkey', count(*) FILTER (WHERE o_custkey % 5 = 0) FROM orders")
register("dq4_check_violations", lambda t: A.check_violations(t.lineitem, "l_discount <= 0.08 AND l_quantity > 1").select("l_orderkey", "l_linenumber", "l_partkey"), "", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT (l_discount <= 0.08 AND l_quantity > 1)")
register("dq5_compare_snapshots", lambda t: A.compare_snapshots(t.orders, t.orders.filter("o_orderkey % 10 <> 3"), "o_custkey", "o_orderdate").select("what", "same"), "", """
WITH a AS (SELECT count(*) AS r, count(DISTINCT o_custkey) AS k, min(o_orderdate) AS f, max(o_orderdate) AS l FROM orders), b AS (SELECT count(*) AS r, count(DISTINCT o_custkey) AS k, min(o_orderdate) AS f, max(o_orderdate) AS l FROM orders WHERE o_orderkey % 10 <> 3)
SELECT 'rows' AS what, a.r = b.r AS same FROM a, b UNION ALL SELECT 'keys', a.k = b.k FROM a, b UNION ALL SELECT 'first', a.f = b.f FROM a, b UNION ALL SELECT 'last', a.l = b.l FROM a, b""")


def fields(t):
    old = t.part.filter("p_partkey % 4 <> 0").select(F.concat(F.lit("f"), F.col("p_partkey")).alias("field"), F.col("p_type").alias("type"), F.expr("p_partkey % 3 = 0").alias("required"))
    return old, t.part.filter("p_partkey % 5 <> 0").select(F.concat(F.lit("f"), F.col("p_partkey")).alias("field"), F.expr("CASE WHEN p_partkey % 6 = 1 THEN 'other' ELSE p_type END").alias("type"), F.expr("p_partkey % 2 = 0").alias("required"))


register("dq6_schema_compat", lambda t: A.schema_compat(*fields(t)), "", """
SELECT 'f' || CAST(p_partkey AS VARCHAR) AS field, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 2 = 0 THEN 'major: required field added' WHEN p_partkey % 5 = 0 THEN 'major: field removed' WHEN p_partkey % 6 = 1 THEN 'major: type changed'
 WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 0 THEN 'major: became required' WHEN p_partkey % 3 = 0 AND p_partkey % 2 <> 0 THEN 'minor: became optional' ELSE 'compatible' END AS change FROM part WHERE NOT (p_partkey % 4 = 0 AND p_partkey % 5 = 0)""")
register("dq7_assert_search", lambda t: A.assert_search(t.events.select(F.col("event_id").alias("id"), F.col("value").alias("score")), 10, 5, 1e6, 1), "", "SELECT 'score' AS failed, count(*) AS n FROM events")


def kv(t):
    values = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("key"), F.expr("CASE WHEN c_custkey % 8 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN string(c_nationkey) ELSE c_mktsegment END END").alias("value"), F.expr("double(c_custkey % 100)").alias("ttl"))
    rules = t.customer.select(F.concat(F.lit("c"), F.expr("c_custkey + c_custkey % 2 * 0")).alias("key"), F.expr("element_at(array('exists', 'equals', 'contains', 'regex', 'number', 'ttl', 'max_size'), int(c_custkey % 7) + 1)").alias("rule"), F.expr("element_at(array('', 'BUILDING', 'UILD', '^[A-Z]+$', '', '50', '8'), int(c_custkey % 7) + 1)").alias("arg"))
    return values, rules


register("dq8_assert_kv", lambda t: A.assert_kv(*kv(t)), "", """
WITH v AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 8 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE c_mktsegment END END AS value, c_custkey % 100 AS ttl, CAST(c_custkey % 7 AS INT) AS k FROM customer)
SELECT key, (['exists', 'equals', 'contains', 'regex', 'number', 'ttl', 'max_size'])[k + 1] AS rule, (['', 'BUILDING', 'UILD', '^[A-Z]+$', '', '50', '8'])[k + 1] AS arg,
 coalesce(CASE k WHEN 0 THEN value IS NOT NULL WHEN 1 THEN value IS NOT DISTINCT FROM 'BUILDING' WHEN 2 THEN contains(value, 'UILD') WHEN 3 THEN regexp_matches(value, '^[A-Z]+$') WHEN 4 THEN regexp_matches(value, '^-?[0-9]+$') WHEN 5 THEN abs(ttl - 50) <= 1 ELSE length(value) <= 8 END, false) AS passed FROM v""")
