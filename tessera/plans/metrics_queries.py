"""Queries of metrics and change detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from .registry import register

register("jn13_baseline_asof", lambda t: M.baseline_asof(t.events.filter("event_type <> 'view'").select(F.col("user_id").alias("subject"), "ts", "event_id", "value"), t.events.filter("event_type = 'view'").select(F.col("user_id").alias("subject"), "ts", "value")).select("subject", "event_id", "value", "baseline"), "", """
SELECT c.user_id AS subject, c.event_id, c.value, b.value AS baseline FROM (SELECT * FROM events WHERE event_type <> 'view') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON c.user_id = b.user_id AND c.ts >= b.ts""")
register("wn1_work_sessions", lambda t: M.work_sessions(t.commits).select("author", "session", "commits", F.round("minutes", 6).alias("minutes")), "commits", """
, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY author ORDER BY ts, sha) <= 2700000000 THEN 0 ELSE 1 END AS new FROM commits),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY author ORDER BY ts, sha ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)
SELECT author, session, count(*) AS commits, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 60000000.0, 6) AS minutes FROM s GROUP BY 1, 2""")
register("wn2_period_over_period", lambda t: M.period_over_period(t.commits, "2024-01-02 00:00:00", 1), "commits", """
, a AS (SELECT author, (epoch_us(TIMESTAMP '2024-01-02 00:00:00') - epoch_us(ts)) / 86400000000.0 AS age FROM commits), c AS (SELECT author, count(*) FILTER (WHERE age >= 0 AND age < 1) AS now, count(*) FILTER (WHERE age >= 1 AND age < 2) AS before FROM a GROUP BY author)
SELECT author, now, before, now - before AS delta, CASE WHEN now > before THEN 'up' WHEN now < before THEN 'down' ELSE 'flat' END AS arrow FROM c""")
register("ag14_commit_stats", lambda t: M.commit_stats(t.commits), "commits", "SELECT author, count(*) AS n, count(*) FILTER (WHERE message LIKE 'feat%') AS feat, count(*) FILTER (WHERE message LIKE 'fix%') AS fix, count(*) FILTER (WHERE message LIKE 'chore%') AS other FROM commits GROUP BY author")
TOUCHED = "CASE event_id % 4 WHEN 0 THEN 'src/test/a.py' WHEN 1 THEN 'lib/test_b.py' WHEN 2 THEN 'src/contest.py' ELSE 'pkg/c_test.go' END"
register("ag14_commit_totals", lambda t: M.commit_totals(t.commits.withColumn("paths", F.array(F.lit("README.md"), F.expr(TOUCHED.replace("event_id", "sha"))))), "commits", """
SELECT coalesce(CAST(author AS VARCHAR), '(all)') AS author, count(*) AS n, count(*) FILTER (WHERE message LIKE 'feat%') AS feat, count(*) FILTER (WHERE message LIKE 'fix%') AS fix, count(*) FILTER (WHERE sha % 4 <> 2) AS with_tests, count(*) FILTER (WHERE message LIKE 'chore%') AS other FROM commits GROUP BY ROLLUP (author)""")
CHECK = "CASE l_linenumber % 6 WHEN 0 THEN 'type' WHEN 1 THEN 'lint' WHEN 2 THEN 'tests' WHEN 3 THEN 'dead_code' WHEN 4 THEN 'shell' ELSE 'unknown' END"
register("ag15_quality_score", lambda t: M.quality_score(t.lineitem.select(F.col("l_orderkey").alias("subject"), F.expr(CHECK).alias("check"), F.expr("CASE WHEN l_suppkey % 5 > 0 THEN l_partkey % 25 END").alias("errors"), F.expr("l_quantity").alias("passed"), F.lit(50).alias("total"))).withColumn("score", F.round("score", 6)), "", f"""
WITH c AS (SELECT l_orderkey AS subject, {CHECK} AS k, CASE WHEN l_suppkey % 5 > 0 THEN l_partkey % 25 END AS e, l_quantity AS p FROM lineitem),
r AS (SELECT subject, CASE WHEN k = 'tests' THEN p * 10.0 / 50 WHEN e IS NULL THEN NULL WHEN e = 0 THEN 10 WHEN e <= 2 THEN 8 WHEN e <= 5 THEN 6 WHEN e <= 10 THEN 4 WHEN e <= 20 THEN 2 ELSE 0 END AS raw, CASE k WHEN 'type' THEN 25 WHEN 'lint' THEN 20 WHEN 'tests' THEN 30 WHEN 'dead_code' THEN 15 WHEN 'shell' THEN 10 END AS w FROM c),
s AS (SELECT subject, sum(raw * w) / sum(w) AS score FROM r WHERE raw IS NOT NULL AND w IS NOT NULL GROUP BY subject) SELECT subject, round(CAST(score AS DOUBLE), 6) AS score, CASE WHEN score >= 8 THEN 'GREEN' WHEN score >= 6 THEN 'YELLOW' ELSE 'RED' END AS tier FROM s""")
register("wn7_trend_last_n", lambda t: M.trend_last_n(t.events.select(F.col("user_id").alias("subject"), "ts", F.col("event_id").alias("id"), F.col("value").alias("score"))).withColumn("change", F.round("change", 6)), "", """
SELECT subject, back, score, round(change, 6) AS change FROM (SELECT user_id AS subject, value AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS back, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS change FROM events) WHERE back <= 5""")
register("wn10_canary_verdict", lambda t: M.canary_verdict(t.events.select(F.col("user_id").alias("subject"), F.col("event_id").alias("seq"), F.expr("CASE WHEN event_type = 'error' THEN 500 ELSE 200 END").alias("code"), F.lit(200).alias("base_code"), F.col("value").alias("ms"), F.lit(10.0).alias("base_ms"))), "", """
SELECT subject, seq, anomalies, CASE WHEN anomalies >= 2 THEN 'ALERT' WHEN anomalies = 1 THEN 'WARNING' ELSE 'STABLE' END AS verdict FROM (SELECT user_id AS subject, event_id AS seq, CAST(sum(CASE WHEN event_type = 'error' OR value > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS anomalies FROM events)""")
register("wn11_attempt_cap", lambda t: M.attempt_cap(t.events.select(F.col("user_id").alias("failure"), F.col("event_id").alias("seq"), F.expr("concat('fix', event_id % 9)").alias("fix"), F.expr("event_type = 'signup'").alias("ok"))), "", """
, e AS (SELECT user_id AS failure, event_id AS seq, 'fix' || CAST(event_id % 9 AS VARCHAR) AS fix, event_type = 'signup' AS ok FROM events)
SELECT failure, seq, CAST(row_number() OVER w AS INTEGER) AS attempt, row_number() OVER (PARTITION BY failure, fix ORDER BY seq) > 1 AS repeated_fix, CASE WHEN sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (w ROWS UNBOUNDED PRECEDING) >= 3 THEN 'BLOCKED' WHEN ok THEN 'RESOLVED' ELSE 'RETRY' END AS state FROM e WINDOW w AS (PARTITION BY failure ORDER BY seq)""")
register("qa10_regression_check", lambda t: M.regression_check(t.lineitem.select(F.expr("concat(l_orderkey, '/', l_linenumber, '/', l_partkey)").alias("id"), F.col("l_tax").alias("ttfb"), F.lit(0.04).alias("base_ttfb"), F.expr("l_discount * 30").alias("total"), F.expr("l_quantity / 25").alias("base_total"), F.col("l_extendedprice").alias("size"), F.expr("(l_linenumber % 3) * 9000.0").alias("base_size"))), "", """
, c AS (SELECT CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) || '/' || CAST(l_partkey AS VARCHAR) AS id, l_tax > 1.5 * 0.04 OR l_tax > 0.5 AS a, l_discount * 30 > 1.5 * (l_quantity / 25) OR l_discount * 30 > 2 AS b, l_linenumber % 3 > 0 AND l_extendedprice > 1.25 * ((l_linenumber % 3) * 9000.0) AS s, (l_discount * 30 - l_quantity / 25) / (l_quantity / 25) * 100 AS total_pct, (l_tax - 0.04) / 0.04 * 100 AS ttfb_pct, CASE WHEN l_linenumber % 3 > 0 THEN (l_extendedprice - (l_linenumber % 3) * 9000.0) / ((l_linenumber % 3) * 9000.0) * 100 END AS size_pct FROM lineitem)
SELECT id, concat_ws(',', CASE WHEN a THEN 'ttfb' END, CASE WHEN b THEN 'total' END, CASE WHEN s THEN 'size' END) AS regressions, CASE WHEN a OR b OR s THEN 'FAIL' ELSE 'PASS' END AS verdict, total_pct, ttfb_pct, size_pct FROM c""")
register("ag11_coverage_matrix", lambda t: M.coverage_matrix(t.part.select(F.col("p_brand").alias("area"), F.col("p_type").alias("type"))), "", """
, s AS (SELECT coalesce(p_brand, '(all)') AS area, coalesce(p_type, '(all)') AS type, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_type)) SELECT a.area, b.type, coalesce(n, 0) AS n FROM (SELECT DISTINCT area FROM s) a CROSS JOIN (SELECT DISTINCT type FROM s) b LEFT JOIN s ON s.area = a.area AND s.type = b.type""")
register("ag18_test_case_audit", lambda t: M.test_case_audit(t.lineitem.select(F.expr("CASE WHEN l_linenumber = 3 THEN concat('tc', l_orderkey) ELSE concat('TC-', lpad(l_orderkey % 900, 3, '0'), l_linenumber) END").alias("id"), F.expr("concat('P', l_suppkey % 4)").alias("priority"), F.col("l_returnflag").alias("source"), F.expr("CASE WHEN l_partkey % 10 = 0 THEN ' ' ELSE 'do' END").alias("steps"))), "", """
, c AS (SELECT CASE WHEN l_linenumber = 3 THEN 'tc' || CAST(l_orderkey AS VARCHAR) ELSE 'TC-' || lpad(CAST(l_orderkey % 900 AS VARCHAR), 3, '0') || CAST(l_linenumber AS VARCHAR) END AS id, l_suppkey % 4 AS p, l_returnflag AS source, l_partkey % 10 AS k FROM lineitem),
x AS (SELECT source, 'duplicate id' AS problem FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM c) WHERE n > 1 UNION ALL SELECT source, 'id pattern' FROM c WHERE id LIKE 'tc%' UNION ALL SELECT source, 'priority value' FROM c WHERE p = 3 UNION ALL SELECT source, 'missing steps' FROM c WHERE k = 0)
SELECT source, problem, count(*) AS n FROM x GROUP BY 1, 2""")
register("ag19_phase_timings", lambda t: M.phase_timings(t.orders.select(F.col("o_orderkey").alias("run_id"), F.expr("map('scan', o_totalprice, 'join', double(o_custkey + 1))").alias("timings"))), "", """
SELECT o_orderkey AS run_id, 'scan' AS phase, o_totalprice AS ms, round(o_totalprice / (o_totalprice + o_custkey + 1), 6) AS share FROM orders UNION ALL SELECT o_orderkey, 'join', CAST(o_custkey + 1 AS DOUBLE), round((o_custkey + 1) / (o_totalprice + o_custkey + 1), 6) FROM orders""")
register("ag19_bench_gates", lambda t: M.bench_gates(t.lineitem.select(F.col("l_orderkey").alias("suite"), F.expr("element_at(array('full', 'nochange', 'small'), int(l_linenumber % 3) + 1)").alias("mode"), F.col("l_quantity").alias("ms"), F.expr("l_tax < 0.08").alias("ok"))), "", """
, m AS (SELECT l_orderkey AS suite, bool_and(l_tax < 0.08) AS all_ok, max(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity END) AS f, max(CASE WHEN l_linenumber % 3 = 1 THEN l_quantity END) AS n, max(CASE WHEN l_linenumber % 3 = 2 THEN l_quantity END) AS s FROM lineitem GROUP BY 1)
SELECT suite, all_ok, n < f AS nochange_faster, s < f AS small_faster, n <= s AS nochange_least FROM m""")
DIFF = ", d AS (SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.rel, o.rel) AS rel, CASE WHEN o.sha IS NULL THEN 'added' WHEN n.sha IS NULL THEN 'deleted' WHEN n.sha <> o.sha THEN 'modified' END AS change FROM snapshot_new n FULL JOIN snapshot_old o ON n.repo = o.repo AND n.rel = o.rel), diff AS (SELECT * FROM d WHERE change IS NOT NULL)"


def diff(t):
    return M.snapshot_diff(t.snapshot_old, t.snapshot_new)


register("st1_snapshot_diff", diff, "snapshot_old snapshot_new", DIFF + "SELECT * FROM diff")
register("st1_scan_modes", lambda t: M.scan_modes(t.snapshot_old.filter("repo <> 'src3'"), t.snapshot_new.filter("repo <> 'src4'").unionByName(t.snapshot_old.filter("repo = 'src4'"))), "snapshot_old snapshot_new", DIFF + "SELECT DISTINCT repo, CASE WHEN repo = 'src3' THEN 'full_fallback' WHEN repo = 'src4' OR repo NOT IN (SELECT repo FROM diff) THEN 'skip_no_changes' ELSE 'incremental' END AS mode FROM snapshot_new")
register("st2_change_manifest", lambda t: M.change_manifest(diff(t)), "snapshot_old snapshot_new", DIFF + "SELECT repo, max(c) AS changed, string_agg(rel, ',' ORDER BY rel) AS first FROM (SELECT *, count(*) OVER (PARTITION BY repo) AS c, row_number() OVER (PARTITION BY repo ORDER BY rel) AS n FROM diff) WHERE n <= 50 GROUP BY repo")
register("ag9_change_profile", lambda t: M.change_profile(t.code.select("repo", "rel")), "code", r"""
SELECT repo, count(*) AS changed_files, bool_or(regexp_matches(lower(rel), '\.(ts|tsx|js|jsx|py|go|java|kt|dart)$|route|controller|api')) AS phase5_inputs, false AS openapi, bool_or(rel LIKE '%.html') AS ui, bool_or(rel LIKE '%.ts') AS types, true AS phase5_required FROM code GROUP BY repo""")
register("st3_scan_diff", lambda t: M.scan_diff(t.snapshot_old, t.snapshot_new, ["repo", "rel"]), "snapshot_old snapshot_new", """
SELECT repo, rel, 'new' AS change FROM (SELECT repo, rel FROM snapshot_new EXCEPT SELECT repo, rel FROM snapshot_old) UNION ALL SELECT repo, rel, 'vanished' FROM (SELECT repo, rel FROM snapshot_old EXCEPT SELECT repo, rel FROM snapshot_new)""")
register("st4_stale_nodes", lambda t: M.stale_nodes(t.part.select(F.col("p_partkey").alias("id"), F.expr("p_size % 2 = 0").alias("generated")), t.lineitem.filter("l_quantity < 2").select(F.col("l_partkey").alias("id"))), "", "SELECT p_partkey AS id FROM part WHERE p_size % 2 = 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 2)")
