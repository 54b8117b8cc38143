"""Queries of joins across repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import crossrepo as J
from ..operators import facts as X
from ..operators.corpus import extract_symbols
from .facts_queries import EVENTS
from .corpus_queries import SYMBOLS
from .registry import register
from .shared import written

ROUTES_ALL = """, routes_all AS (SELECT route_idx, repo, rel, lineno, content FROM routes
 UNION ALL SELECT 1000000000 + route_idx, 'svc9', rel, lineno, 'router.get("/' || split_part(rel, '/', 2) || '/' || regexp_extract(rel, '([0-9]+)/routes', 1) || '")' FROM routes WHERE repo = 'svc0'
 UNION ALL SELECT 3000000000, 'svc9', 'src/app.ts', 1, 'app.use("/api/v2", r)' FROM routes WHERE route_idx = 0
 UNION ALL SELECT 2000000000 + route_idx, 'web1', rel, lineno, content FROM routes WHERE repo = 'svc0')"""


def routes_all(t):
    """The route fixture, routes of a router mounted under /api/v2, and copies within a calling repository."""
    r = t.routes
    mounted = r.filter("repo = 'svc0'").select((F.col("route_idx") + 1_000_000_000).alias("route_idx"), F.lit("svc9").alias("repo"), "rel", "lineno", F.expr("concat('router.get(\"/', split_part(rel, '/', 2), '/', regexp_extract(rel, '([0-9]+)/routes', 1), '\")')").alias("content"))
    mount = r.filter("route_idx = 0").select(F.lit(3_000_000_000).cast("long").alias("route_idx"), F.lit("svc9").alias("repo"), F.lit("src/app.ts").alias("rel"), F.lit(1).cast("long").alias("lineno"), F.lit('app.use("/api/v2", r)').alias("content"))
    own = r.filter("repo = 'svc0'").withColumn("route_idx", F.col("route_idx") + 2_000_000_000).withColumn("repo", F.lit("web1"))
    return r.unionByName(mounted).unionByName(mount).unionByName(own)


def calls(t):
    """The URLs of the call sites as a table, worked out once for all joins of a query."""
    if "_calls" not in vars(t):
        t._calls = written(J.call_urls(t.callsites), "calls")
    return t._calls


MATCHED = ROUTES_ALL + r"""
, calls AS (SELECT repo, rel, lineno, unnest([regexp_extract(content, '"([^"]*)"', 1), substr(regexp_extract(content, '"([^"]*)"', 1), 5)]) AS url, upper(regexp_extract(content, 'client\.([a-z]+)', 1)) AS method FROM callsites),
cu AS (SELECT DISTINCT repo, url, method FROM calls),
al AS (SELECT *, unnest([regexp_replace(url, '^/api', ''), '/api' || regexp_replace(url, '^/api', '')]) AS alias FROM cu),
rt AS (SELECT *, repo || chr(9) || rel || ':' || CAST(lineno AS VARCHAR) || ':' || content AS raw, nullif(upper(regexp_extract(content, 'router\.(get|post)', 1)), '') AS r_method, regexp_extract(content, '"(/[^"]*)"', 1) AS template FROM routes_all),
hit AS (
  SELECT a.repo, a.url, a.method, r.route_idx, 0 AS how FROM al a JOIN rt r ON contains(r.raw, a.alias)
  UNION ALL SELECT a.repo, a.url, a.method, r.route_idx, 1 FROM al a JOIN rt r ON regexp_full_match(a.alias, regexp_replace(r.template, '\{[^}]*\}', '[^/]+', 'g'))
  UNION ALL SELECT a.repo, a.url, a.method, r.route_idx, 2 FROM al a JOIN rt r ON r.repo = 'svc9' AND r.r_method IS NOT NULL AND a.alias = '/api/v2' || r.template),
ok AS (SELECT h.repo, h.url, h.method, h.route_idx, min(how) AS how FROM hit h JOIN rt r USING (route_idx) WHERE r.r_method IS NULL OR r.r_method = h.method GROUP BY 1, 2, 3, 4),
best AS (SELECT o.*, r.repo AS be_repo, r.rel AS be_rel, r.lineno AS be_lineno, row_number() OVER (PARTITION BY o.repo, o.url, o.method ORDER BY r.repo = o.repo, o.route_idx) AS n FROM ok o JOIN rt r USING (route_idx)),
matched AS (SELECT c.repo, c.rel, c.lineno, c.url, b.route_idx, b.be_repo, b.be_rel, b.be_lineno, CASE how WHEN 0 THEN 'GREP_SUBSTRING' WHEN 1 THEN 'GREP_TEMPLATE' ELSE 'GREP_MOUNTED' END AS provenance
  FROM calls c JOIN best b ON b.n = 1 AND c.repo = b.repo AND c.url = b.url AND c.method = b.method)
"""


def matched(t):
    return J.match_calls_to_routes(calls(t), routes_all(t))


register("jn1_url_aliases", lambda t: J.call_urls(t.callsites).select("repo", "lineno", F.explode(P.url_aliases(F.col("url"))).alias("alias")), "callsites", """
SELECT repo, lineno, unnest([url, substr(url, 5), url, substr(url, 5)]) AS alias FROM (SELECT *, regexp_extract(content, '"([^"]*)"', 1) AS url FROM callsites)""")
register("jn1_canonical_path", lambda t: t.pages.select("page_id", P.canonical_path(F.expr("concat('/api/v2', regexp_extract(url, '://[^/]*(/.*)$', 1))")).alias("path")), "", r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_extract('/v2' || regexp_extract(url, '://[^/]*(/.*)$', 1), '^([^?#]*)', 1), '/{2,}', '/', 'g'), '/$', '') AS path FROM pages""")


def template_paths(t):
    """URLs without their ``/api``, and the route templates they match."""
    urls = J.call_urls(t.callsites).select("url").distinct().withColumn("alias", F.expr("regexp_replace(url, '^/api', '')"))
    templates = routes_all(t).select(F.explode(X.route_templates(F.col("content"))).alias("template")).distinct()
    return J.with_templates(urls, templates, bare=True).select("url", "template")


register("jn2_path_template_match", template_paths, "callsites routes", ROUTES_ALL + r"""
, t AS (SELECT DISTINCT unnest([regexp_extract(content, '"(/[^"]*)"', 1), regexp_extract(content, '/v[0-9]+[^\s"`?#)]+'), regexp_extract(content, '/api[^\s"`?#)]+')]) AS template FROM routes_all),
u AS (SELECT DISTINCT unnest([regexp_extract(content, '"([^"]*)"', 1), substr(regexp_extract(content, '"([^"]*)"', 1), 5)]) AS url FROM callsites)
SELECT DISTINCT url, template FROM u JOIN t ON template <> '' AND regexp_full_match(regexp_replace(url, '^/api', ''), regexp_replace(template, '\{[^}]*\}', '[^/]+', 'g'))""")
register("jn3_match_calls_to_routes", matched, "callsites routes", MATCHED + "SELECT * FROM matched")
UNMATCHED = MATCHED + ", un AS (SELECT c.* FROM calls c WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.repo = c.repo AND m.url = c.url))"


def unmatched(t):
    return J.unmatched_calls(calls(t), matched(t))


def topology(t):
    return t.nation.select(F.expr("concat('web', n_nationkey % 7)").alias("role"), F.expr("concat('svc', n_regionkey)").alias("callee"))


register("jn4_topology_fallback", lambda t: J.topology_fallback(unmatched(t), topology(t)), "callsites routes", UNMATCHED + """
SELECT DISTINCT u.repo, u.url, 'svc' || CAST(n_regionkey AS VARCHAR) AS backend, 'TOPOLOGY_DECLARED' AS provenance FROM un u JOIN nation ON u.repo = 'web' || CAST(n_nationkey % 7 AS VARCHAR)""")


def roles_of(t):
    """Web, mobile and other callers; backends of which one has no module; and calls with a templated part."""
    number = "int(substr(repo, 4)) % 3"
    calls = unmatched(t).withColumn("url", F.expr("CASE WHEN length(url) % 2 = 0 THEN concat(url, '/{id}') ELSE url END"))
    kinds = t.callsites.select("repo").distinct().select("repo", F.expr(f"CASE {number} WHEN 0 THEN 'web' WHEN 1 THEN 'mobile' ELSE 'tool' END").alias("kind"))
    roles = kinds.unionByName(t.routes.select("repo", F.lit("backend").alias("kind")).distinct())
    return J.role_fallback(calls, roles, t.routes, roles.select("repo").filter("repo NOT IN ('svc4', 'web1')"))


ROLES = UNMATCHED + """, cl AS (SELECT DISTINCT repo, CASE WHEN length(url) % 2 = 0 THEN url || '/{id}' ELSE url END AS url FROM un), u AS (SELECT DISTINCT url, regexp_replace(url, '^/api', '') AS short FROM cl),
r AS (SELECT *, regexp_extract(content, '"(/[^"]*)"', 1) AS template FROM routes), n AS (SELECT repo, count(*) AS n FROM r GROUP BY repo),
s AS (SELECT url, r.repo, n.n, CAST(max(CASE WHEN contains(content, '/' || split_part(url, '/', 2)) THEN 3 ELSE 0 END) + max(CASE WHEN url LIKE '/api%' AND contains(content, '/api') THEN 1 ELSE 0 END)
  + max(CASE WHEN contains(template, '/api' || short) OR contains(template, short) OR regexp_full_match('/api' || short, regexp_replace(template, '\\{[^}]*\\}', '[^/]+', 'g')) OR regexp_full_match(short, regexp_replace(template, '\\{[^}]*\\}', '[^/]+', 'g')) THEN 5 ELSE 0 END) + least(n.n, 50) // 10 AS BIGINT) AS score
  FROM u, r JOIN n ON n.repo = r.repo GROUP BY url, r.repo, n.n),
pb AS (SELECT url, repo AS backend FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, n DESC, repo DESC) AS k FROM s) WHERE k = 1 AND repo <> 'svc4'),
rf AS (SELECT cl.repo, cl.url, backend, CASE WHEN CAST(substr(cl.repo, 4) AS INT) % 3 = 2 THEN CASE WHEN contains(cl.url, '{id}') THEN 'dynamic_or_templated_url' ELSE 'no_route_match' END
  WHEN backend IS NULL OR cl.repo = 'web1' THEN 'heuristic_no_backend_target' ELSE '' END AS reason FROM cl LEFT JOIN pb USING (url))
"""
register("jn4_role_heuristic", lambda t: roles_of(t)[0], "callsites routes", ROLES + "SELECT repo, url, backend, 'ROLE_HEURISTIC' AS provenance FROM rf WHERE reason = ''")
register("jn5_pick_backend", lambda t: J.pick_backend(J.call_urls(t.callsites), t.routes), "callsites routes", r"""
, u AS (SELECT DISTINCT url, regexp_replace(url, '^/api', '') AS short FROM (SELECT unnest([regexp_extract(content, '"([^"]*)"', 1), substr(regexp_extract(content, '"([^"]*)"', 1), 5)]) AS url FROM callsites)),
r AS (SELECT *, regexp_extract(content, '"(/[^"]*)"', 1) AS template FROM routes), n AS (SELECT repo, count(*) AS n FROM r GROUP BY repo),
s AS (SELECT url, r.repo, n.n, CAST(max(CASE WHEN contains(content, '/' || split_part(url, '/', 2)) THEN 3 ELSE 0 END) + max(CASE WHEN url LIKE '/api%' AND contains(content, '/api') THEN 1 ELSE 0 END)
  + max(CASE WHEN contains(template, '/api' || short) OR contains(template, short) OR regexp_full_match('/api' || short, regexp_replace(template, '\{[^}]*\}', '[^/]+', 'g')) OR regexp_full_match(short, regexp_replace(template, '\{[^}]*\}', '[^/]+', 'g')) THEN 5 ELSE 0 END) + least(n.n, 50) // 10 AS BIGINT) AS score
  FROM u, r JOIN n ON n.repo = r.repo GROUP BY url, r.repo, n.n)
SELECT url, repo AS backend, score FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, n DESC, repo DESC) AS k FROM s) WHERE k = 1""")
register("jn6_alias_match", lambda t: J.alias_match(t.part.select(F.col("p_name").alias("name")), t.part.select(F.expr("concat(split_part(p_name, ' ', 2), '-', CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE split_part(p_name, ' ', 1) END)").alias("choice"))), "", r"""
WITH names AS (SELECT DISTINCT p_name AS name FROM part), c AS (SELECT DISTINCT split_part(p_name, ' ', 2) || '-' || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE split_part(p_name, ' ', 1) END AS choice FROM part),
x AS (SELECT name, choice, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS n, regexp_replace(lower(choice), '[^a-z0-9]+', '', 'g') AS k,
  CAST(list_contains(string_split(name, ' '), split_part(choice, '-', 1)) AS INT) + CAST(length(split_part(choice, '-', 2)) > 1 AND list_contains(string_split(name, ' '), split_part(choice, '-', 2)) AS INT) AS overlap FROM names, c),
y AS (SELECT *, CASE WHEN n = k THEN 1 WHEN contains(n, k) OR contains(k, n) THEN 2 WHEN overlap > 0 THEN 3 END AS tier FROM x)
SELECT name, choice, tier FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, CASE WHEN tier < 3 THEN choice ELSE '' END, overlap DESC, length(choice), choice DESC) AS r FROM y WHERE tier IS NOT NULL) WHERE r = 1""")


def types(t):
    return extract_symbols(t.code).filter("kind = 'type'").select("repo", "rel", F.col("content").alias("declaration"))


TYPES = f", sym AS ({SYMBOLS}), types AS (SELECT repo, rel, content AS declaration, repo || '-' || regexp_replace(regexp_replace(lower(regexp_extract(rel, '^(.*)/[^/]*$', 1)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS module FROM sym WHERE kind = 'type')"
register("jn7_shared_types", lambda t: J.shared_types(types(t)), "code", TYPES + """
, m AS (SELECT DISTINCT declaration, module FROM types), k AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY declaration) AS n FROM m) WHERE n >= 2)
SELECT a.declaration, a.module AS source, b.module AS target FROM k a JOIN k b ON a.declaration = b.declaration AND a.module < b.module""")
register("ag4_duplicate_declarations", lambda t: J.duplicate_declarations(types(t)), "code", TYPES + "SELECT declaration, count(*) AS n, count(DISTINCT repo) AS distinct_repos FROM types GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, declaration LIMIT 50")


def endpoints(t):
    return X.event_endpoints(t.code).withColumn("module", P.module_id(F.col("repo"), F.col("rel")))


MODULE = "repo || '-' || regexp_replace(regexp_replace(lower(regexp_extract(rel, '^(.*)/[^/]*$', 1)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
register("jn8_event_edges", lambda t: J.event_edges(endpoints(t), t.region.select(F.lit("view.created").alias("topic"), F.lower(F.col("r_name")).alias("module"))), "code", f"""
, ev AS ({EVENTS}), e AS (SELECT DISTINCT {MODULE} AS module, kind, topic FROM ev WHERE topic <> ''), d AS (SELECT 'view.created' AS topic, lower(r_name) AS module FROM region)
SELECT DISTINCT p.topic, p.module AS pub, s.module AS sub, 'EVENT_BUS' AS provenance FROM e p JOIN e s ON p.kind = 'pub' AND s.kind = 'sub' AND p.topic = s.topic AND p.module <> s.module
UNION ALL SELECT DISTINCT p.topic, p.module, d.module, 'EVENT_BUS_TOPOLOGY' FROM e p JOIN d ON p.kind = 'pub' AND p.topic = d.topic""")


def modules(t):
    return t.routes.filter("route_idx % 4 <> 3").select(P.module_id(F.col("repo"), F.col("rel")).alias("id"), "rel").unionByName(t.callsites.select(P.module_id(F.col("repo"), F.col("rel")).alias("id"), "rel"))


MODS = f", mods AS (SELECT DISTINCT {MODULE} AS id FROM routes WHERE route_idx % 4 <> 3 UNION SELECT DISTINCT {MODULE} FROM callsites), e AS (SELECT *, {MODULE} AS source, {MODULE.replace('repo ||', 'be_repo ||').replace('(rel,', '(be_rel,')} AS target FROM matched)"
register("jn9_resolve_modules", lambda t: J.resolve_modules(matched(t), modules(t))[0].select("source", "target", "url", "lineno"), "callsites routes", MATCHED + MODS + "SELECT source, target, url, lineno FROM e WHERE source IN (SELECT id FROM mods) AND target IN (SELECT id FROM mods) AND source <> target")
register("jn9_missing_modules", lambda t: J.resolve_modules(matched(t), modules(t))[1], "callsites routes", MATCHED + MODS + "SELECT DISTINCT 'module_missing' AS reason, id FROM (SELECT source AS id FROM e UNION SELECT target FROM e) WHERE id NOT IN (SELECT id FROM mods)")
CATALOG = MATCHED + r""", catalog AS (SELECT r.route_idx, r.repo, r.rel, r.lineno, coalesce(r_method, 'UNKNOWN') AS method, template AS templates, count(m.repo) AS usage, count(DISTINCT m.repo) AS callers FROM rt r LEFT JOIN matched m ON m.route_idx = r.route_idx GROUP BY 1, 2, 3, 4, 5, 6)"""
register("ag5_route_catalog", lambda t: J.route_catalog(routes_all(t), matched(t)).select("route_idx", "repo", "rel", "lineno", "method", F.regexp_extract("templates", "^([^,]*)", 1).alias("templates"), "usage", "callers"), "callsites routes", CATALOG + "SELECT * FROM catalog")
register("ag6_api_coverage", lambda t: J.api_coverage(J.route_catalog(routes_all(t), matched(t))), "callsites routes", CATALOG + "SELECT coalesce(repo, '(all)') AS repo, count(*) AS routes, count(*) FILTER (WHERE usage > 0) AS linked, CAST(count(*) FILTER (WHERE usage > 0) * 100.0 / count(*) AS DOUBLE) AS pct FROM catalog GROUP BY ROLLUP (repo)")
register("ag7_unresolved_summary", lambda t: J.unresolved_summary(roles_of(t)[1]), "callsites routes", ROLES + """
SELECT reason, count(*) AS n, count(DISTINCT repo) AS repos FROM rf WHERE reason <> '' GROUP BY reason""")
register("ag7_topology_reasons", lambda t: J.unresolved_summary(J.topology_reasons(unmatched(t), topology(t).filter("role < 'web5'"))), "callsites routes", UNMATCHED + """
SELECT 'topology_no_callee' AS reason, count(DISTINCT repo || url) AS n, count(DISTINCT repo) AS repos FROM un WHERE repo >= 'web5' HAVING count(*) > 0""")


def graph(t):
    cross = J.resolve_modules(matched(t), modules(t))[0].select("source", "target", "provenance")
    imports = t.supplier.select(F.expr("concat('web', s_suppkey % 7, '-src-m', s_suppkey % 13)").alias("source"), F.expr("concat('web', s_suppkey % 7, '-src-m', s_suppkey % 14)").alias("target"), F.expr("int(s_suppkey % 3)").alias("confidence"))
    return J.build_graph(modules(t).withColumnRenamed("rel", "path"), cross, imports)


GRAPH = MATCHED + MODS + f""", nodes AS (SELECT id, min(path) AS path FROM (SELECT {MODULE} AS id, rel AS path FROM routes WHERE route_idx % 4 <> 3 UNION ALL SELECT {MODULE}, rel FROM callsites) GROUP BY id),
i AS (SELECT DISTINCT 'web' || CAST(s_suppkey % 7 AS VARCHAR) || '-src-m' || CAST(s_suppkey % 13 AS VARCHAR) AS source, 'web' || CAST(s_suppkey % 7 AS VARCHAR) || '-src-m' || CAST(s_suppkey % 14 AS VARCHAR) AS target, CASE s_suppkey % 3 WHEN 2 THEN 'AST_STRONG' ELSE 'AST_WEAK' END AS provenance, 'import' AS kind FROM supplier WHERE s_suppkey % 3 > 0),
all_edges AS (SELECT DISTINCT source, target, provenance, 'cross' AS kind FROM e WHERE source IN (SELECT id FROM mods) AND target IN (SELECT id FROM mods) UNION SELECT * FROM i),
edges AS (SELECT * FROM all_edges WHERE source <> target AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes))"""
register("gr1_graph_nodes", lambda t: graph(t)[0], "callsites routes", GRAPH + "SELECT * FROM nodes")
register("gr1_graph_edges", lambda t: graph(t)[1], "callsites routes", GRAPH + "SELECT * FROM edges")
register("gr1_graph_warnings", lambda t: graph(t)[2], "callsites routes", GRAPH + "SELECT DISTINCT 'unknown module ' || id AS warning FROM (SELECT source AS id FROM all_edges WHERE source <> target UNION SELECT target FROM all_edges WHERE source <> target) WHERE id NOT IN (SELECT id FROM nodes)")
register("gr2_graph_summary", lambda t: J.graph_summary(*graph(t)[:2]), "callsites routes", GRAPH + "SELECT 'node' AS what, count(*) AS n FROM nodes UNION ALL SELECT kind, count(*) FROM edges GROUP BY kind")
register("gr2_neighbors", lambda t: J.neighbors(graph(t)[1], "web1-src-m1"), "callsites routes", GRAPH + "SELECT * FROM edges WHERE source = 'web1-src-m1' OR target = 'web1-src-m1' ORDER BY source, target, kind, provenance LIMIT 200")
register("gr2_find_nodes", lambda t: J.find_nodes(graph(t)[0], "VIEW"), "callsites routes", GRAPH + "SELECT * FROM nodes WHERE contains(lower(path), 'view')")
register("ag8_edge_kind_counts", lambda t: J.edge_kind_counts(graph(t)[1]), "callsites routes", GRAPH + "SELECT kind, count(*) AS n FROM edges GROUP BY kind")
