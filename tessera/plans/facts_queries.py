"""Queries of code facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import facts as X
from ..operators.corpus import LOW_SIGNAL_FILE, LOW_SIGNAL_PATH, TEST_PATH
from .registry import register
from .shared import checkpoint_dir

q = lambda s: "'" + s.replace("'", "''") + "'"
m = lambda col, p: f"regexp_matches({col}, {q(p)})"
ex = lambda col, p, g: f"regexp_extract_all({col}, {q(p)}, {g})"

register("rt1_route_lines", lambda t: X.route_lines(t.code), "code", f"SELECT * FROM code WHERE {m('rel', X.ROUTE_EXT)} AND NOT {m('rel', '(^|/)dist/')} AND NOT {m('rel', TEST_PATH)} AND {m('content', X.ROUTE_LINE)}")


def _sources(t):
    """Whole files, one per event: a class prefix and two routes."""
    js = """concat('app.get("/', event_type, '/', user_id, '/", h)\nrouter.route("v1//', event_type, '").post(h)\napp.use("/m", require("./r"))')"""
    java = """concat('@RequestMapping("/api/', event_type, '")\npublic class C {\n@GetMapping("/x', user_id, '")\n@PostMapping(path = "/")')"""
    nest = """concat('@Controller("', event_type, '")\n@Get("u', user_id, '")\n@Delete("")')"""
    return t.events.select(F.expr("concat('repo', user_id % 5)").alias("repo"), F.expr("concat('src/f', user_id % 30, CASE event_id % 3 WHEN 0 THEN '.js' WHEN 1 THEN '.java' ELSE '.ts' END)").alias("rel"), F.expr(f"CASE event_id % 3 WHEN 0 THEN {js} WHEN 1 THEN {java} ELSE {nest} END").alias("content"))


register("rt2_synthetic_routes", lambda t: X.synthetic_routes(_sources(t)), "", """
WITH e AS (SELECT *, 'repo' || CAST(user_id % 5 AS VARCHAR) AS repo, 'src/f' || CAST(user_id % 30 AS VARCHAR) AS f, CAST(user_id AS VARCHAR) AS u FROM events)
SELECT DISTINCT repo, f || '.js' AS rel, 'GET' AS method, '/' || event_type || '/' || u AS path FROM e WHERE event_id % 3 = 0
UNION SELECT repo, f || '.js', 'POST', '/v1/' || event_type FROM e WHERE event_id % 3 = 0
UNION SELECT repo, f || '.java', 'GET', '/api/' || event_type || '/x' || u FROM e WHERE event_id % 3 = 1
UNION SELECT repo, f || '.java', 'POST', '/api/' || event_type FROM e WHERE event_id % 3 = 1
UNION SELECT repo, f || '.ts', 'GET', '/' || event_type || '/u' || u FROM e WHERE event_id % 3 = 2
UNION SELECT repo, f || '.ts', 'DELETE', '/' || event_type FROM e WHERE event_id % 3 = 2""")


def _mounted(t):
    """A mount tree over the parts: each file is mounted in the file of half its number."""
    checkpoint_dir(t.spark)
    routes = t.part.filter("p_partkey > 0").select(F.lit("svc").alias("repo"), F.expr("concat('f', p_partkey)").alias("rel"), F.lit("GET").alias("method"), F.expr("concat('/', p_type)").alias("path"))
    mounts = t.part.filter("p_partkey > 1").select(F.lit("svc").alias("repo"), F.expr("concat('f', p_partkey div 2)").alias("rel"), F.expr("concat('/m', p_partkey % 3, '/')").alias("prefix"), F.expr("concat('f', p_partkey)").alias("child"))
    return X.mounted_routes(routes, mounts)


register("rt3_mounted_routes", _mounted, "", """
WITH RECURSIVE w AS (
  SELECT p_partkey AS k, '/' || p_type AS path, p_partkey AS at_k, 0 AS depth FROM part WHERE p_partkey > 0
  UNION ALL SELECT k, '/m' || CAST(at_k % 3 AS VARCHAR) || path, at_k // 2, depth + 1 FROM w WHERE at_k > 1
) SELECT DISTINCT 'svc' AS repo, 'f' || CAST(k AS VARCHAR) AS rel, 'GET' AS method, path FROM w WHERE depth > 0""")
register("rt4_normalize_route", lambda t: t.pages.select("page_id", P.normalize_route(F.expr("replace(url, 'http', ' ')")).alias("path"), P.join_route(F.lit("v1/"), F.expr("regexp_extract(url, '://[^/]*(/[^?#]*)', 1)")).alias("joined")), "", r"""
SELECT page_id, regexp_replace(regexp_replace('/' || trim(replace(url, 'http', ' ')), '/{2,}', '/', 'g'), '/$', '') AS path,
  CASE WHEN p IN ('', '/') THEN '/v1' ELSE '/v1' || regexp_replace(p, '/$', '') END AS joined FROM (SELECT *, regexp_replace(regexp_extract(url, '://[^/]*(/[^?#]*)', 1), '/{2,}', '/', 'g') AS p FROM pages)""")
TEMPL = "list_transform(" + " || ".join(ex("content", p, g) for p, g in X.TEMPLATES) + ", lambda x: regexp_extract(x, '^([^?]*)', 1))"
register("rt5_route_templates", lambda t: t.code.select("repo", "rel", "lineno", F.posexplode(X.route_templates(F.col("content"))).alias("k", "template")).select("repo", "rel", "lineno", "template"), "code", f"SELECT DISTINCT repo, rel, lineno, unnest({TEMPL}) AS template FROM code")


def _upper_first(pattern: str, groups: int) -> str:
    return "nullif(upper(" + " || ".join(f"regexp_extract(content, {q(pattern)}, {g})" for g in range(1, groups + 1)) + "), '')"


register("rt6_route_method", lambda t: t.code.groupBy(X.route_method(F.col("content")).alias("method")).agg(F.count("*").alias("n")), "code", f"SELECT {_upper_first(X.ROUTE_METHOD, 3)} AS method, count(*) AS n FROM code GROUP BY 1")
register("rt6_call_method", lambda t: t.callsites.groupBy(X.call_method(F.col("content")).alias("method")).agg(F.count("*").alias("n")), "callsites", f"SELECT {_upper_first(X.CALL_METHOD, 2)} AS method, count(*) AS n FROM callsites GROUP BY 1")
register("rt8_mount_prefixes", lambda t: X.mount_prefixes(t.code), "code", f"SELECT DISTINCT repo, p AS prefix FROM (SELECT repo, unnest({ex('content', X.MOUNT, 1)}) AS p FROM code) WHERE regexp_matches(p || '/', '^/(api/|internal/|v[0-9]+[./])')")
register("rt9_module_routes", lambda t: X.module_routes(t.routes.select(P.module_id(F.col("repo"), F.col("rel")).alias("module"), X.route_method(F.col("content")).alias("method"), F.expr("regexp_extract(content, '\"([^\"]*)\"', 1)").alias("path"))), "routes", """
SELECT repo || '-src-' || split_part(rel, '/', 2) AS module, string_agg(DISTINCT CASE WHEN content LIKE '%get(%' THEN 'GET ' ELSE 'POST ' END || regexp_extract(content, '"([^"]*)"', 1), '; ') AS routes, count(*) AS n FROM routes GROUP BY 1""")
CALLS = "(" + " OR ".join(f"({m('rel', rf'\.({e})$')} AND {m('content', p)}" + (f" AND NOT {m('rel', s)}" if s else "") + (f" AND regexp_matches(rel || ':' || content, {q(c)})" if c else "") + ")" for e, p, s, c in X.CALL_RULES) + f") AND NOT {m('rel', TEST_PATH)} AND NOT {m('rel', LOW_SIGNAL_PATH)} AND NOT {m('rel', LOW_SIGNAL_FILE)}"
register("cs1_call_sites", lambda t: X.call_sites(t.code), "code", f"SELECT * FROM code WHERE {CALLS}")
register("cs2_union_call_sites", lambda t: X.union_call_sites(X.call_sites(t.code), t.code.filter("lineno % 2 = 0")), "code", f"SELECT * FROM code WHERE ({CALLS}) OR lineno % 2 = 0")
LOWV = f"lower(trim(regexp_extract(content, {q(X.ENDPOINT_CONST)}, 2)))"
CONSTS = f"SELECT repo, rel, lineno, regexp_extract(content, {q(X.ENDPOINT_CONST)}, 1) AS symbol, trim(regexp_extract(content, {q(X.ENDPOINT_CONST)}, 2)) AS value FROM code WHERE {m('rel', r'\.(kt|java|ts|tsx|js|jsx)$')} AND NOT {m('rel', TEST_PATH)} AND NOT {m('rel', LOW_SIGNAL_PATH)} AND {m('content', X.ENDPOINT_CONST)} AND CASE WHEN {LOWV} LIKE 'http%' THEN regexp_matches({LOWV}, '/api|/v') ELSE regexp_matches({LOWV}, '^(/|api/|v)') AND regexp_matches({LOWV}, 'api|graphql|internal|^v[0-9]+') END"
register("cs3_endpoint_constants", lambda t: X.endpoint_constants(t.code), "code", CONSTS)
API = r"regexp_matches(u, '^/(api/|internal/|graphql|v[0-9]+([./]|$))') AND length(u) >= 3 AND NOT contains(u, '${') AND NOT (contains(u, '{') AND contains(u, '}'))"
URLS = f"SELECT DISTINCT repo, rel, lineno, u AS url FROM (SELECT repo, rel, lineno, trim(regexp_extract(unnest({' || '.join(ex('content', p, g) for p, g in X.URLS)} || list_transform({ex('content', X.RELATIVE_URL, 1)}, lambda x: '/' || x)), '^([^?#]*)', 1)) AS u FROM code) WHERE {API}"
register("cs4_urls_in_content", lambda t: t.code.select("repo", "rel", "lineno", F.explode(X.urls_in_content(F.col("content"))).alias("url")), "code", URLS)


def _refs(t):
    return t.code.filter("content LIKE '%ApiPaths.%' OR rel LIKE '%.ts'").select("repo", F.col("lineno").alias("call_id"), F.expr("concat('A.', 'API_', regexp_extract(upper(content), '(PURCHASE|SIGNUP|VIEW|CLICK|ERROR)', 1))").alias("symbol"))


register("cs5_resolve_symbols", lambda t: X.resolve_symbols(_refs(t), X.endpoint_constants(t.code)), "code", f"""
, c AS ({CONSTS}), one AS (SELECT repo, symbol AS leaf, min(value) AS value FROM c GROUP BY 1, 2 HAVING count(DISTINCT value) = 1),
refs AS (SELECT repo, lineno AS call_id, 'API_' || regexp_extract(upper(content), '(PURCHASE|SIGNUP|VIEW|CLICK|ERROR)', 1) AS leaf FROM code WHERE content LIKE '%ApiPaths.%' OR rel LIKE '%.ts')
SELECT DISTINCT r.repo, call_id, 'A.' || r.leaf AS symbol, value AS url FROM refs r JOIN one o ON r.repo = o.repo AND r.leaf = o.leaf""")
register("cs6_frontend_urls", lambda t: X.frontend_urls(t.code), "code", f"SELECT DISTINCT repo, unnest({ex('content', r'''['"`]((?:https?:/)?/[^'"`\s]+)['"`]''', 1)}) AS url FROM code")
register("cs6_dynamic_url_lines", lambda t: X.dynamic_url_lines(t.code), "code", "SELECT * FROM code WHERE " + m("content", r"`[^`]*\$\{[^}]*\}[^`]*/|['\"]/[^'\"]*['\"]\s*\+"))
ENVW = rf"{m('rel', r'\.(ts|js|py|go|java|kt)$')} AND NOT contains(lower(rel || content), 'test') AND {m('content', X.ENV)}"
register("cs7_env_usage", lambda t: X.env_usage(t.code), "code", f"SELECT * FROM code WHERE {ENVW}")
register("cs7_env_keys", lambda t: X.env_keys(t.code), "code", f"SELECT DISTINCT unnest({' || '.join(ex('content', p, g) for p, g in X.ENV_KEYS)}) AS key FROM code WHERE {ENVW}")
EVENTS = r"""SELECT repo, rel, lineno, kind, api, CASE WHEN regexp_matches(content, '"[a-z]+[.-][a-z]+"') THEN regexp_extract(content, '"([a-z]+[.-][a-z]+)"', 1) ELSE coalesce(list_extract(list_filter(regexp_extract_all(content, '[''"]([\w.\-/]+)[''"]', 1), lambda x: x = lower(x) AND regexp_matches(x, '[a-z]')), 1), '') END AS topic
FROM (SELECT *, 'pub' AS kind, CASE WHEN contains(content, 'publish(') THEN 'publish(' WHEN contains(content, 'produce(') THEN 'produce(' WHEN contains(content, 'emit(') THEN 'emit(' END AS api FROM code
 UNION ALL SELECT *, 'sub', CASE WHEN contains(content, 'subscribe(') THEN 'subscribe(' WHEN contains(content, '@KafkaListener') THEN '@KafkaListener' END FROM code)
WHERE api IS NOT NULL AND regexp_matches(rel, '\.(ts|py|go|java|kt)$') AND NOT contains(lower(rel || content), 'test')"""
register("cs8_event_endpoints", lambda t: X.event_endpoints(t.code), "code", EVENTS)
register("cs9_import_edges", lambda t: X.import_edges(t.code), "code", r"""
, i AS (SELECT *, regexp_extract(content, '"([^"]+)"', 1) AS spec, regexp_extract(rel, '^(.*)/[^/]*$', 1) AS dir FROM code WHERE regexp_matches(rel, '\.ts$') AND (content LIKE 'import %' OR content LIKE 'const dep%'))
SELECT repo, rel, lineno, CASE WHEN content LIKE 'import%' THEN 'import' ELSE 'require' END AS kind, spec AS target, 'HEURISTIC' AS provenance,
  CASE WHEN spec LIKE '../%' THEN regexp_replace(regexp_replace(dir, '(^|/)[^/]*$', '') || '/' || substr(spec, 4), '^/', '') ELSE dir || '/' || substr(spec, 3) END AS resolved FROM i
UNION ALL SELECT repo, rel, lineno, 'from', regexp_extract(content, 'from (\S+)', 1), 'HEURISTIC', replace(regexp_extract(content, 'from (\S+)', 1), '.', '/') FROM code WHERE rel LIKE '%.py' AND content LIKE 'from %'
UNION ALL SELECT repo, rel, lineno, 'import', x, 'HEURISTIC', replace(x, '.', '/') FROM (SELECT *, unnest(['os', regexp_extract(content, '(app\.m\d+)', 1)]) AS x FROM code WHERE rel LIKE '%.py' AND content LIKE 'import os,%')""")


def _locals(t):
    imports = t.import_lines.select("repo", "rel", F.expr("concat('src/s', regexp_extract(content, '/s([0-9]+)', 1))").alias("resolved")).distinct()
    files = t.supplier.select(F.expr("concat('repo', s_suppkey % 5)").alias("repo"), F.expr("concat('src/s', s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.js' ELSE '.md' END)").alias("rel"))
    return imports, files.unionByName(files.filter("rel LIKE '%.ts'").withColumn("rel", F.expr("replace(rel, '.ts', '.tsx')")))


register("cs10_resolve_local_imports", lambda t: X.resolve_local_imports(*_locals(t)), "", """
SELECT DISTINCT 'repo' || CAST(l_suppkey % 5 AS VARCHAR) AS repo, 'src/p' || CAST(l_partkey AS VARCHAR) || '.ts' AS rel, 'src/s' || CAST(l_suppkey AS VARCHAR) AS resolved,
  'src/s' || CAST(l_suppkey AS VARCHAR) || CASE l_suppkey % 3 WHEN 0 THEN '.tsx' ELSE '/index.js' END AS file FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_suppkey % 3 < 2""")
LINKS = " UNION ".join(f"""SELECT page_id, '{k}' AS kind, unnest(regexp_extract_all(html, '(?i)<{tag}[^>]*\\s{attr}=["'']([^"'']+)["'']', 1)) AS target FROM pages""" for k, tag, attr in (("script", "script", "src"), ("link", "link", "href"), ("anchor", "a", "href")))
register("cs11_html_asset_links", lambda t: X.html_asset_links(t.pages), "", f"SELECT * FROM ({LINKS}) WHERE NOT regexp_matches(target, '^(data|blob|mailto|javascript):|^#')")


def _links(t):
    return X.html_asset_links(t.pages).filter("kind = 'anchor'").select(F.expr("lpad(page_id, 8, '0')").alias("page"), P.without_query(F.col("target")).alias("target"), F.lit("link").alias("via"))


register("cs12_page_link_graph", lambda t: X.page_link_graph(_links(t)), "", f"""
WITH l AS (SELECT DISTINCT lpad(CAST(page_id AS VARCHAR), 8, '0') AS page, trim(regexp_extract(target, '^([^?#]*)', 1)) AS target FROM ({LINKS}) WHERE kind = 'anchor' AND NOT regexp_matches(target, '^(data|blob|mailto|javascript):|^#'))
SELECT target, 'link' AS via, string_agg(page, ',' ORDER BY page) AS pages, count(*) AS n FROM l GROUP BY target""")
register("cs13_slug_ids", lambda t: X.slug_ids(t.code).select("repo", "rel", "lineno", "file_id"), "code", "SELECT repo, rel, lineno, repo || '-' || regexp_replace(regexp_replace(lower(rel), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS file_id FROM code")
register("cs13_posix_cksum", lambda t: t.code.select("repo", "rel", "lineno", X.posix_cksum(F.col("content")).alias("cksum")), "code", """
, bits AS (SELECT b, c FROM (WITH RECURSIVE r AS (SELECT range AS b, range << 24 AS c, 0 AS k FROM range(256) UNION ALL
  SELECT b, xor((c << 1) & 4294967295, CASE WHEN c >> 31 = 1 THEN 79764919 ELSE 0 END), k + 1 FROM r WHERE k < 8) SELECT b, c FROM r WHERE k = 8)),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits), texts AS (SELECT DISTINCT content, encode(content) AS data FROM code),
ints AS (SELECT content, list_concat([('0x' || hex(data)[2 * k - 1:2 * k])::BIGINT FOR k IN range(1, octet_length(data) + 1)], [(octet_length(data) >> (8 * k)) & 255 FOR k IN range(4) IF (octet_length(data) >> (8 * k)) > 0]) AS bytes FROM texts),
sums AS (SELECT content, xor(list_reduce(list_prepend(0::BIGINT, bytes), lambda c, x: xor((c << 8) & 4294967295, t[xor(c >> 24, x) + 1])), 4294967295) AS cksum FROM ints, crc)
SELECT repo, rel, lineno, cksum FROM code JOIN sums USING (content)""")
register("fn_fold_path", lambda t: t.code.select("lineno", P.fold_path(F.concat("repo", F.lit("/./a/../"), "rel", F.lit("/../x"))).alias("folded"), P.safe_relpath(F.expr("CASE WHEN lineno % 3 = 0 THEN concat('../', rel) WHEN lineno % 3 = 1 THEN concat('/', rel) ELSE rel END")).alias("safe"), P.insight_slug(F.col("content")).alias("slug"), P.normalize_header(F.col("content")).alias("header")), "code", """
SELECT lineno, repo || '/' || regexp_extract(rel, '^(.*)/[^/]*$', 1) || '/x' AS folded, lineno % 3 = 2 AS safe, substr(regexp_replace(regexp_replace(lower(content), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 40) AS slug, regexp_replace(lower(content), '[^a-z0-9]', '', 'g') AS header FROM code""")
register("fn_safe_task_id", lambda t: t.documents.select("doc_id", P.safe_task_id(F.expr("concat(CASE doc_id % 5 WHEN 0 THEN 'task-' WHEN 1 THEN '../' WHEN 2 THEN ' T.' WHEN 3 THEN 'a/' ELSE '-x' END, doc_id, CASE WHEN doc_id % 7 = 0 THEN '..' ELSE ' ' END)")).alias("task_id")), "", """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'task-' || CAST(doc_id AS VARCHAR) WHEN doc_id % 5 = 2 THEN 'T.' || CAST(doc_id AS VARCHAR) END AS task_id FROM documents""")
