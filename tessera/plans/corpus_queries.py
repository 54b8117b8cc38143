"""Queries of sources and corpus operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import corpus as C
from ..sources import readers as R
from ..operators.multipattern import matching
from .registry import register
from .shared import fresh_path

q = lambda s: "'" + s.replace("'", "''") + "'"

register("io2_to_lines", lambda t: R.to_lines(t.files.select("repo", "rel", "content")), "files", """
SELECT repo, rel, lineno, list_extract(parts, lineno) AS content FROM (
  SELECT repo, rel, parts, unnest(range(1, len(parts) + 1)) AS lineno FROM (
    SELECT repo, rel, string_split(regexp_replace(content, chr(10) || '$', ''), chr(10)) AS parts FROM files WHERE length(content) > 0))""")

register("io3_parse_tagged", lambda t: R.parse_tagged(t.code.select(F.expr("CASE WHEN lineno % 9 = 0 THEN content ELSE concat(repo, '\t', rel, ':', lineno, ':', content) END").alias("raw")))[0], "code",
         "SELECT repo, rel, lineno, content FROM code WHERE lineno % 9 <> 0")

register("io3_rejects", lambda t: R.parse_tagged(t.code.select(F.expr("CASE WHEN lineno % 9 = 0 THEN content ELSE concat(repo, '\t', rel, ':', lineno, ':', content) END").alias("raw")))[1], "code",
         "SELECT 'malformed' AS reason, content AS raw FROM code WHERE lineno % 9 = 0")

register("io5_read_steps", lambda t: R.read_steps(t.steps.withColumnsRenamed({"id": "ID", "surface": "Sur-face", "depends_on": "Depends On"}))[0].withColumn("depends_on", F.array_join("depends_on", ",")), "steps", f"""
, alias AS (SELECT * FROM (VALUES {', '.join(f"({q(k)}, {q(v)})" for k, v in R.SURFACES.items())}) a(given, surface))
SELECT s.task_id, s.id, a.surface, s.intent, s.depends_on, s.row_no FROM steps s JOIN alias a ON lower(s.surface) = a.given WHERE s.intent <> ''""")

register("io5_step_errors", lambda t: R.read_steps(t.steps)[1], "steps", "SELECT task_id, row_no, 'unknown surface' AS reason FROM steps WHERE lower(surface) = 'fax'")


def _specs(t):
    """A spec per part: its paths and schemas follow from its columns."""
    body = """concat('{"paths":{"/v1/', p_brand, '/{id}":{"get":{},"x-note":{}},"/', p_type, '":{"post":{},"delete":{}},"bad":{"get":{}}},"components":{"schemas":{"', p_type, '":{"properties":{"id":{"type":"integer"},"owner":{"$ref":"#/s/Owner"}}}}}}')"""
    return t.part.select(F.expr("concat('svc', p_partkey % 20)").alias("repo"), F.expr("concat('api/', lpad(p_partkey, 8, '0'), '.json')").alias("rel"), F.expr(body).alias("content"))


register("io7_openapi_operations", lambda t: R.openapi_operations(_specs(t)), "", """
WITH s AS (SELECT *, 'svc' || CAST(p_partkey % 20 AS VARCHAR) AS repo, 'api/' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.json' AS rel FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY rel) AS n FROM s)
SELECT repo, rel, '/v1/' || p_brand || '/{id}' AS path, 'GET' AS method FROM k WHERE n <= 40
UNION ALL SELECT repo, rel, '/' || p_type, 'POST' FROM k WHERE n <= 40 UNION ALL SELECT repo, rel, '/' || p_type, 'DELETE' FROM k WHERE n <= 40""")

register("io9_schema_digest", lambda t: R.schema_digest(_specs(t)), "", """
WITH s AS (SELECT *, 'svc' || CAST(p_partkey % 20 AS VARCHAR) AS repo, 'api/' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.json' AS rel FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY rel) AS n FROM s)
SELECT repo, rel, p_type AS schema, 'id' AS prop, 'integer' AS type FROM k WHERE n <= 15 UNION ALL SELECT repo, rel, p_type, 'owner', 'Owner' FROM k WHERE n <= 15""")


def _notes(t):
    inline = "concat('---\nstatus: ', o_orderstatus, '\nproduct: P', o_custkey % 4, '\ntags: [', o_orderpriority, ', hot]\n---\n# body')"
    block = "concat('---\nstatus: ', o_orderstatus, '\ntags:\n  - ', o_orderpriority, '\n  - cold\n---\ntext')"
    return t.orders.select(F.col("o_orderkey").alias("doc_id"), F.expr(f"CASE o_orderkey % 3 WHEN 0 THEN {inline} WHEN 1 THEN {block} ELSE 'status: none' END").alias("content"))


register("io10_front_matter", lambda t: R.front_matter(_notes(t)).select("doc_id", F.col("fields")["status"].alias("status"), F.col("fields")["product"].alias("product"), F.array_join("tags", "|").alias("tags")), "", """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 < 2 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'P' || CAST(o_custkey % 4 AS VARCHAR) END AS product,
  CASE o_orderkey % 3 WHEN 0 THEN replace(o_orderpriority, ' ', '') || '|hot' WHEN 1 THEN o_orderpriority || '|cold' ELSE '' END AS tags FROM orders""")


def _topology(t):
    """A document per customer group: a topology section with a role per nation, then another section."""
    line = "CASE c_custkey % 5 WHEN 0 THEN concat('### role', c_nationkey) WHEN 1 THEN concat('- calls: svc', c_nationkey, ', svcx') WHEN 2 THEN concat('- publishes: t', c_nationkey) WHEN 3 THEN '- owner: nobody' ELSE '- subscribes: t1' END"
    rows = t.customer.select(F.expr("c_custkey div 50").alias("doc"), F.expr("c_custkey * 2 + 2").alias("lineno"), F.expr(line).alias("content"))
    head = t.customer.filter("c_custkey % 50 = 0").select(F.expr("c_custkey div 50").alias("doc"), F.expr("c_custkey * 2").alias("lineno"), F.lit("## Service Topology").alias("content"))
    end = t.customer.filter("c_custkey % 50 = 40").select(F.expr("c_custkey div 50").alias("doc"), F.expr("c_custkey * 2 + 1").alias("lineno"), F.lit("## Other").alias("content"))
    return rows.unionByName(head).unionByName(end)


register("io11_topology_edges", lambda t: R.topology_edges(_topology(t)), "", """
WITH c AS (SELECT *, c_custkey // 50 AS doc, max(CASE WHEN c_custkey % 5 = 0 THEN c_custkey END) OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) AS head FROM customer),
h AS (SELECT c.*, r.c_nationkey AS role_no FROM c JOIN customer r ON r.c_custkey = c.head WHERE c.c_custkey % 50 < 40),
k AS (SELECT *, max(head) OVER (PARTITION BY doc, role_no) AS last_head FROM h)
SELECT doc, 'role' || CAST(role_no AS VARCHAR) AS role, 'call' AS kind, unnest(['svc' || CAST(c_nationkey AS VARCHAR), 'svcx']) AS value FROM k WHERE head = last_head AND c_custkey % 5 = 1
UNION ALL SELECT doc, 'role' || CAST(role_no AS VARCHAR), 'pub', 't' || CAST(c_nationkey AS VARCHAR) FROM k WHERE head = last_head AND c_custkey % 5 = 2
UNION ALL SELECT doc, 'role' || CAST(role_no AS VARCHAR), 'sub', 't1' FROM k WHERE head = last_head AND c_custkey % 5 = 4""")


def _store(t):
    nodes = t.part.select(F.expr("CASE WHEN p_partkey % 31 = 0 THEN '' ELSE p_brand END").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("path"), F.col("p_partkey").alias("seq"))
    edges = t.links.select(F.expr("CASE WHEN dst % 37 = 0 THEN '' ELSE string(src) END").alias("source"), F.expr("string(dst)").alias("target"), F.col("type").alias("kind"))
    return R.edge_store(nodes, edges)


register("io12_nodes", lambda t: _store(t)[0], "", "SELECT p_brand AS id, arg_max(p_type, p_partkey) AS type, arg_max(p_name, p_partkey) AS path FROM part WHERE p_partkey % 31 <> 0 GROUP BY p_brand")
register("io12_edges", lambda t: _store(t)[1], "links", """
SELECT CAST(src AS VARCHAR) AS source, CAST(dst AS VARCHAR) AS target, type AS kind, '{"kind":"' || type || '","source":"' || CAST(src AS VARCHAR) || '","target":"' || CAST(dst AS VARCHAR) || '"}' AS payload_json FROM links WHERE dst % 37 <> 0""")

NAME = "lower(regexp_extract(rel, '([^/]*)$', 1))"
SOURCE = rf"(regexp_matches({NAME}, '\.({'|'.join(C.SOURCE_SUFFIXES)})$') AND NOT regexp_matches({NAME}, '\.generated\.|\.min\.|\.spec\.|\.test\.'))"
TEST = rf"(regexp_matches({NAME}, '\.spec\.|\.test\.|_test\.|^test_.*\.py$'))"
register("fl1_classify_files", lambda t: C.classify_files(t.files).select("repo", "rel", "is_source", "is_test"), "files", f"SELECT repo, rel, {SOURCE} AS is_source, {TEST} AS is_test FROM files")
LANG = "CASE lower(regexp_extract(rel, '(\\.[^./]*)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.LANGUAGES.items()) + " ELSE 'Unknown' END"
register("fl2_detect_language", lambda t: t.code.groupBy(C.detect_language(F.col("rel")).alias("language")).agg(F.count("*").alias("n")), "code", f"SELECT {LANG} AS language, count(*) AS n FROM code GROUP BY 1")
SIGNAL = rf"NOT regexp_matches(rel, '{C.TEST_PATH}') AND NOT regexp_matches(rel, '{C.LOW_SIGNAL_PATH}') AND NOT regexp_matches(rel, '{C.LOW_SIGNAL_FILE}')"
register("fl3_path_signal", lambda t: t.code.filter(C.signal_path(F.col("rel"))).select("repo", "rel", "lineno"), "code", f"SELECT repo, rel, lineno FROM code WHERE {SIGNAL}")
SYMBOLS = " UNION ALL ".join(f"SELECT repo, rel, lineno, '{lang}' AS lang, '{kind}' AS kind, content FROM code WHERE regexp_matches(rel, '\\.({ext})$') AND regexp_matches(content, {q(p)}) AND NOT regexp_matches('/' || rel || ':' || CAST(lineno AS VARCHAR) || ':' || content, {q(x)})" for lang, kind, ext, p, x in C.SYMBOL_RULES)
register("fl6_extract_symbols", lambda t: C.extract_symbols(t.code), "code", SYMBOLS)
FUNC = "coalesce(" + ", ".join(f"nullif(regexp_extract(content, {q(p)}, 1), '')" for p in C.FUNCTION_NAMES) + ")"
register("fl7_name_symbols", lambda t: C.name_symbols(t.code), "code", f"""
SELECT * FROM (SELECT repo, rel, lineno, CASE WHEN regexp_matches(content, {q(C.TYPE_NAME)}) THEN regexp_extract(content, {q(C.TYPE_NAME)}, 1) || ' ' || regexp_extract(content, {q(C.TYPE_NAME)}, 2)
  WHEN length({FUNC}) > 1 AND NOT regexp_matches({FUNC}, '^(get|set|is|has|to|of|by|on|do)$') THEN 'function ' || {FUNC} END AS symbol FROM code WHERE NOT regexp_matches(rel, {q(C.GENERATED)})) WHERE symbol IS NOT NULL""")
UI = r"(regexp_matches(lower(rel), '\.(html|htm|vue|svelte|tsx|jsx)$') OR regexp_matches(rel, '(^|/)app/.*\.(ts|js)$'))"
register("fl8_ui_files", lambda t: C.ui_files(t.code), "code", f"SELECT DISTINCT repo, rel FROM code WHERE {UI}")
register("fl8_ui_markup", lambda t: C.ui_markup(t.code), "code", r"SELECT * FROM code WHERE regexp_matches(rel, '\.(html|htm|vue|svelte|tsx|jsx)$') AND regexp_matches(content, '<form|\bid=|data-')")
register("fl9_classify_pages", lambda t: C.classify_pages(C.ui_files(t.code)), "code", rf"""
SELECT repo, rel, CASE WHEN rel LIKE '%.html' THEN 'HTML' WHEN rel LIKE '%.ts' THEN 'TypeScript' ELSE 'JavaScript' END AS format,
  CASE WHEN regexp_matches(rel, '(partials?|fragments?)/') THEN 'partial' WHEN regexp_matches(rel, '(dialogs?|modals?)/') THEN 'dialog' WHEN regexp_matches(rel, 'layouts?/') THEN 'layout' WHEN regexp_matches(rel, '(pages?|screens?|views?)/') THEN 'page' ELSE 'component' END AS kind,
  CASE WHEN regexp_matches(rel, '(pages|app|routes)/') THEN '/' || regexp_replace(regexp_extract(rel, '(?:pages|app|routes)/(.*)$', 1), '\.[^.]+$', '') ELSE 'unknown' END AS route
FROM (SELECT DISTINCT repo, rel FROM code WHERE {UI})""")
register("fl10_import_lines", lambda t: C.import_lines(t.import_lines), "import_lines", f"SELECT * FROM import_lines WHERE lineno <= 50 AND regexp_matches(content, {q(C.IMPORT)})")
register("fl11_test_names", lambda t: C.test_names(t.code), "code", f"""
SELECT repo, rel, lineno, content, regexp_matches(content, '{C.EDGE_CASE}') AS edge_case FROM (SELECT *, row_number() OVER (PARTITION BY repo, rel ORDER BY lineno) AS n FROM code WHERE regexp_matches(content, {q(C.TEST_NAME)})) WHERE n <= 30""")
register("fl12_visible_methods", lambda t: C.visible_methods(C.extract_symbols(t.code).filter("kind = 'method'").drop("lang", "kind"), t.code.filter("rel LIKE 'lib/%'")), "code", rf"""
, m AS ({SYMBOLS}) SELECT repo, rel, lineno, content, (rel LIKE 'lib/%' OR regexp_matches(content, '\b(public|export|pub|open)\b|^func [A-Z]|^func \(.*\) [A-Z]')) AS kept FROM m WHERE kind = 'method'""")
MANY = "'(widget|order|item|service|handle|s)' || CAST(s_suppkey AS STRING) || '[^0-9]'"


def _many(t):
    """As many rules as suppliers."""
    rules = t.supplier.select(F.col("s_suppkey").alias("rule"), F.expr(f"'(?i)' || {MANY}").alias("pattern"))
    return matching(t.code, rules).groupBy("rule", "repo").agg(F.count("*").alias("n"), F.min("lineno").alias("first_line"))


register("fl13_many_patterns", _many, "code", f"SELECT s_suppkey AS rule, repo, count(*) AS n, min(lineno) AS first_line FROM code JOIN supplier ON regexp_matches(lower(content), {MANY.replace('STRING', 'VARCHAR')}) GROUP BY ALL")
PATTERNS = [r"process\.env", "/api/v1", "nothing here"]
register("fl13_pattern_hits", lambda t: C.pattern_hits(t.code, PATTERNS), "code", ", h AS (" + " UNION ALL ".join(f"SELECT *, {q(p)} AS pattern FROM code WHERE regexp_matches(content, {q(p)})" for p in PATTERNS) + """)
SELECT repo, rel, lineno, content, pattern, c > 80 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY repo, pattern ORDER BY rel, lineno) AS n, count(*) OVER (PARTITION BY repo, pattern) AS c FROM h) WHERE n <= 80""")


def _prose(t):
    text = "concat('# TODO list\n', CASE WHEN conv_id % 3 = 0 THEN '```\nTODO in code\n~~~\nTBD\n```\n' WHEN conv_id % 3 = 1 THEN '~~~\nTODO\n```\n' ELSE '' END, 'a todo, here\n', coalesce(replace(text, '\n', ' '), ''), '\nlast TBD')"
    return t.conversations.select(F.expr("conv_id * 1000 + turn").cast("long").alias("doc_id"), F.expr(text).alias("content"))


register("fl14_placeholder_violations", lambda t: C.placeholder_violations(_prose(t)), "", """
SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS doc_id, CAST(CASE WHEN conv_id % 3 = 0 THEN 7 ELSE 2 END AS BIGINT) AS lineno, 'a todo, here' AS line FROM conversations WHERE conv_id % 3 <> 1
UNION ALL SELECT CAST(conv_id * 1000 + turn AS BIGINT), CASE WHEN conv_id % 3 = 0 THEN 9 ELSE 4 END, 'last TBD' FROM conversations WHERE conv_id % 3 <> 1""")
ANCHORS = ["the", "that", "que", "und"]
register("fl15_missing_anchors", lambda t: C.missing_anchors(t.documents.select("doc_id", F.col("text").alias("content")), ANCHORS), "", f"SELECT doc_id, anchor FROM documents, (VALUES {', '.join(f'({q(a)})' for a in ANCHORS)}) a(anchor) WHERE NOT contains(text, anchor)")


def _hubs(t):
    files = t.import_lines.select("repo", "rel").distinct().unionByName(t.import_lines.select("repo", F.expr("regexp_replace(regexp_extract(content, '\"./(.*)\"', 1), '$', '.ts')").alias("rel")).distinct())
    return C.hub_scores(files.distinct(), C.import_lines(t.import_lines))


HUBS = r"""
, files AS (SELECT DISTINCT repo, rel FROM import_lines UNION SELECT DISTINCT repo, regexp_extract(content, '"./(.*)"', 1) || '.ts' FROM import_lines),
lines AS (SELECT repo, line, count(*) AS times FROM (SELECT repo, '=== /' || repo || '/' || rel || ' ===' AS line FROM files UNION ALL SELECT repo, content FROM import_lines) GROUP BY 1, 2),
stems AS (SELECT DISTINCT repo, regexp_extract(rel, '([^/]*)\.[^.]*$', 1) AS stem FROM files),
scores AS (SELECT s.repo, s.stem, CAST(sum((length(line) - length(replace(line, stem, ''))) // length(stem) * times) AS BIGINT) AS score FROM stems s JOIN lines l ON s.repo = l.repo AND contains(line, stem) GROUP BY 1, 2)
"""
register("ag1_hub_scores", _hubs, "import_lines", HUBS + r"""SELECT f.repo, f.rel, score, CASE WHEN score >= 5 THEN 1 WHEN score >= 3 THEN 2 ELSE 0 END AS tier FROM files f JOIN scores s ON f.repo = s.repo AND s.stem = regexp_extract(f.rel, '([^/]*)\.[^.]*$', 1)""")
register("tk6_top_hubs", lambda t: C.top_hubs(_hubs(t), 10), "import_lines", HUBS + r"""SELECT f.repo, f.rel, score, CASE WHEN score >= 5 THEN 1 WHEN score >= 3 THEN 2 ELSE 0 END AS tier FROM files f JOIN scores s ON f.repo = s.repo AND s.stem = regexp_extract(f.rel, '([^/]*)\.[^.]*$', 1) ORDER BY score DESC, f.repo, f.rel LIMIT 10""")
FAM = r"CASE WHEN regexp_matches(rel, '\.tsx?$') THEN 'ts' WHEN regexp_matches(rel, '\.jsx?$') THEN 'js' ELSE regexp_extract(rel, '\.([a-z]+)$', 1) END"
register("ag2_language_breakdown", lambda t: C.language_breakdown(t.code), "code", f"SELECT repo, {', '.join(f'count(*) FILTER (WHERE {FAM} = {q(n)}) AS {n}' for n in ['ts', 'js', 'py', 'go', 'java', 'kt', 'dart', 'rs'])} FROM code WHERE {SOURCE} GROUP BY repo")
register("ag3_scan_totals", lambda t: C.scan_totals(t.code), "code", rf"SELECT coalesce(repo, '(all)') AS repo, count(*) FILTER (WHERE {SOURCE}) AS sources, count(*) FILTER (WHERE {TEST}) AS tests, count(*) FILTER (WHERE regexp_matches(lower(rel), '\.(html|htm|vue|svelte|tsx|jsx)$')) AS ui, count(*) AS files FROM code GROUP BY ROLLUP (repo)")


def _corpus(t):
    """Addresses of the pages written as text files, read back as a source tree."""
    path = fresh_path(t.spark, "corpus")
    t.pages.select("url").write.text(path)
    lines = R.to_lines(R.read_corpus(t.spark, {"site": path}))
    return lines.groupBy("repo").agg(F.count("*").alias("lines"), F.sum(F.length("content")).alias("chars"))


register("io1_read_corpus", _corpus, "", "SELECT 'site' AS repo, count(*) AS lines, CAST(sum(length(url)) AS BIGINT) AS chars FROM pages")


def _tsv(t):
    path = fresh_path(t.spark, "tsv")
    row = "CASE WHEN o_orderkey % 10 = 0 THEN '# comment' WHEN o_orderkey % 10 = 1 THEN 'short' WHEN o_orderkey % 10 = 2 THEN concat(o_orderkey, '\t', o_orderstatus) ELSE concat(o_orderkey, '\t', o_orderstatus, '\t', o_orderpriority) END"
    t.orders.select(F.expr(row).alias("value")).write.text(path)
    return R.read_tsv(t.spark, path, ["key", "status", "priority"], 2)


register("io4_read_tsv", _tsv, "", "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status, CASE WHEN o_orderkey % 10 <> 2 THEN o_orderpriority END AS priority FROM orders WHERE o_orderkey % 10 > 1")


def _jsonl(t):
    path = fresh_path(t.spark, "jsonl")
    t.events.select(F.expr("CASE WHEN event_id % 7 = 0 THEN '{broken' ELSE to_json(named_struct('id', event_id, 'kind', event_type)) END").alias("value")).write.text(path)
    good, bad = R.read_jsonl(t.spark, path, T.StructType([T.StructField("id", T.LongType()), T.StructField("kind", T.StringType())]))
    return good.select(F.col("kind").alias("what"), "id").unionByName(bad.select(F.col("reason").alias("what"), F.lit(None).cast("long").alias("id"))).groupBy("what").agg(F.count("*").alias("n"), F.max("id").alias("last"))


register("io6_read_jsonl", _jsonl, "", "SELECT CASE WHEN event_id % 7 = 0 THEN 'invalid JSON' ELSE event_type END AS what, count(*) AS n, max(CASE WHEN event_id % 7 <> 0 THEN event_id END) AS last FROM events GROUP BY 1")
_COUNTS = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{k}') AS BIGINT) AS {k}s" for k in ("type", "annotation", "method", "function"))
register("ag3_totals_of_symbols_and_tiers", lambda t: C.scan_totals(t.code, C.extract_symbols(t.code), _hubs(t)), "code import_lines", HUBS + rf"""
, h AS (SELECT f.repo, f.rel, CASE WHEN score >= 5 THEN 1 WHEN score >= 3 THEN 2 ELSE 0 END AS tier FROM files f JOIN scores s ON f.repo = s.repo AND s.stem = regexp_extract(f.rel, '([^/]*)\.[^.]*$', 1)),
a AS (SELECT coalesce(repo, '(all)') AS repo, count(*) FILTER (WHERE {SOURCE}) AS sources, count(*) FILTER (WHERE {TEST}) AS tests, count(*) FILTER (WHERE regexp_matches(lower(rel), '\.(html|htm|vue|svelte|tsx|jsx)$')) AS ui, count(*) AS files FROM code GROUP BY ROLLUP (repo)),
b AS (SELECT coalesce(repo, '(all)') AS repo, {_COUNTS} FROM ({SYMBOLS}) GROUP BY ROLLUP (repo)),
c AS (SELECT coalesce(repo, '(all)') AS repo, count(*) FILTER (WHERE tier = 1) AS tier1, count(*) FILTER (WHERE tier = 2) AS tier2, count(*) FILTER (WHERE tier = 0) AS skipped FROM h GROUP BY ROLLUP (repo))
SELECT a.*, b.* EXCLUDE (repo), c.* EXCLUDE (repo) FROM a JOIN b USING (repo) JOIN c USING (repo)""".replace("\\\\", "\\"))
