"""Joins across repositories: calls to routes, fallbacks, shared types, events, modules; coverage, catalog and graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import canonical_path, is_api_path, join_route, module_id, substrings, url_aliases
from .facts import call_method, is_mount_only, mount_prefixes, route_method, route_templates, urls_in_content

def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def template_matches(path: Column, template: Column) -> Column:
    """Equal segment by segment, a ``{x}`` segment standing for any."""
    a, b = segments(path), segments(template)
    wild = lambda x: x.startswith("{") & x.endswith("}")
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: wild(y) | (x == y)), lambda ok: ok)


def enrich_routes(routes: DataFrame) -> DataFrame:
    """routes(route_idx, repo, rel, lineno, content) with record text, verb, templates, mount flag and provenance source (``grep`` unless given)."""
    raw = F.concat("repo", F.lit("\t"), "rel", F.lit(":"), F.col("lineno").cast("string"), F.lit(":"), "content")
    out = routes.withColumn("raw", raw).withColumn("method", route_method(F.col("content"))).withColumn("templates", route_templates(F.col("content"))).withColumn("mount_only", is_mount_only(F.col("content")))
    return out if "source" in routes.columns else out.withColumn("source", F.lit("grep"))


def call_urls(calls: DataFrame) -> DataFrame:
    """calls(repo, rel, lineno, content) to a row per URL, with the verb where it shows."""
    return calls.select("repo", "rel", "lineno", F.explode(urls_in_content(F.col("content"))).alias("url"), call_method(F.col("content")).alias("method"))


def with_substrings(rows: DataFrame, text: str, wanted: DataFrame, name: str, start: str = "/") -> DataFrame:
    """rows with a row for each distinct substring of the text that starts at a slash and is as long as one of wanted(name)."""
    lengths = wanted.agg(F.collect_set(F.length(name)).alias("_lengths"))  # one row, with as many numbers as lengths occur
    return rows.crossJoin(F.broadcast(lengths)).withColumn(name, F.explode(substrings(F.col(text), F.col("_lengths"), start))).drop("_lengths", text)


def with_templates(rows: DataFrame, templates: DataFrame, bare: bool = False) -> DataFrame:
    """rows(alias) joined to the templates(template) they match segment by segment. Both sides meet on the whole path with wildcards marked: a row takes a
    key for each set of wildcard places that templates of its number of segments have, which are few. With ``bare``, paths without a segment match too."""
    mark = F.lit("\0")
    wild = F.transform(segments(F.col("template")), lambda x: x.startswith("{") & x.endswith("}"))
    keyed = lambda seg: F.array_join(F.zip_with(seg, F.col("_wild"), lambda x, w: F.when(w, mark).otherwise(x)), "/")
    known = templates.withColumn("_wild", wild).withColumn("_key", keyed(segments(F.col("template")))).filter(F.size("_wild") >= (0 if bare else 1))
    places = known.select("_wild", F.size("_wild").alias("_n")).distinct()
    tried = rows.withColumn("_n", F.size(segments(F.col("alias")))).join(places, "_n").withColumn("_key", keyed(segments(F.col("alias"))))
    return tried.join(known, ["_wild", "_key"]).drop("_wild", "_key", "_n")


def route_matches(wanted: DataFrame, routes: DataFrame) -> DataFrame:
    """wanted(caller, url, method) and enriched routes to every match, with the best way it matched (0 substring, 1 template, 2 mounted).

    What joins is a match: records meet URLs on their substrings that start at a slash and are as long as some URL, templates on whole paths."""
    alias = wanted.withColumn("alias", F.explode(url_aliases(F.col("url"))))
    fits = F.col("method").isNull() | F.col("r_method").isNull() | (F.col("method") == F.col("r_method"))
    records = with_substrings(routes.select("route_idx", "raw", F.col("method").alias("r_method")), "raw", alias, "alias")
    by_text = alias.join(records, "alias").filter(fits).select("caller", "url", "method", "route_idx", F.lit(0).alias("how"))

    plain = routes.select("route_idx", "method", F.explode("templates").alias("template"), F.lit(1).alias("how"))
    merged = routes.filter(~F.col("mount_only")).select("route_idx", "repo", "method", F.explode("templates").alias("t")).join(mount_prefixes(routes), "repo")
    mounted = merged.select("route_idx", "method", join_route(F.col("prefix"), F.col("t")).alias("template"), F.lit(2).alias("how"))
    templates = plain.unionByName(mounted.filter(is_api_path(F.col("template"))))
    templates = templates.select("route_idx", F.col("method").alias("r_method"), "template", "how")
    by_template = with_templates(alias, templates).filter(fits).select("caller", "url", "method", "route_idx", "how")
    return by_text.unionByName(by_template).groupBy("caller", "url", "method", "route_idx").agg(F.min("how").alias("how"))


def match_calls_to_routes(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """calls (with URLs) to the first route in order that another repository declares, else the first of the caller's own, with its provenance.

    Calls are first reduced to distinct (repository, URL, verb), and joined back at the end."""
    known = enrich_routes(routes).checkpoint()
    wanted = calls.select(F.col("repo").alias("caller"), "url", "method").distinct().checkpoint()  # read several times, and far smaller than the calls
    hits = route_matches(wanted, known)
    about = known.select("route_idx", F.col("repo").alias("be_repo"), F.col("rel").alias("be_rel"), F.col("lineno").alias("be_lineno"), "source")
    hits = hits.join(about, "route_idx")
    way = F.when(F.col("source") == "alias", "MANUAL_ALIAS").when(F.col("source") == "openapi", "OPENAPI").when(F.col("how") == 0, "GREP_SUBSTRING").when(F.col("how") == 1, "GREP_TEMPLATE").otherwise("GREP_MOUNTED")
    rank = F.struct((F.col("be_repo") == F.col("caller")).alias("own"), "route_idx", "be_repo", "be_rel", "be_lineno", way.alias("provenance"))
    best = hits.groupBy("caller", "url", "method").agg(F.min(rank).alias("b")).select("caller", "url", "method", "b.route_idx", "b.be_repo", "b.be_rel", "b.be_lineno", "b.provenance")
    same = (F.col("c.repo") == F.col("b.caller")) & (F.col("c.url") == F.col("b.url")) & F.col("c.method").eqNullSafe(F.col("b.method"))
    return calls.alias("c").join(best.alias("b"), same).select("c.repo", "c.rel", "c.lineno", "c.url", "b.route_idx", "b.be_repo", "b.be_rel", "b.be_lineno", "b.provenance")


def unmatched_calls(calls: DataFrame, matched: DataFrame) -> DataFrame:
    return calls.join(matched.select("repo", "url").distinct(), ["repo", "url"], "left_anti")


def topology_fallback(unmatched: DataFrame, topology: DataFrame) -> DataFrame:
    """With a topology(role, callee): every callee that the caller declares."""
    return unmatched.select("repo", "url").distinct().join(topology.select(F.col("role").alias("repo"), "callee").distinct(), "repo").select("repo", "url", F.col("callee").alias("backend"), F.lit("TOPOLOGY_DECLARED").alias("provenance"))


# What makes a URL dynamic or templated.
DYNAMIC_URL = r"\$\{|\{[^}]+\}|:[A-Za-z_][A-Za-z0-9_]*"


def role_fallback(unmatched: DataFrame, roles: DataFrame, routes: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without a topology: calls of web and mobile repositories of roles(repo, kind) go to the backend that fits their URL best, if caller and backend have
    a module in modules(repo). Gives edges (repo, url, backend, provenance ``ROLE_HEURISTIC``), and the other calls with a reason (repo, url, reason)."""
    distinct = unmatched.select("repo", "url").distinct().checkpoint()  # read several times, and far smaller than the calls
    calls = distinct.join(roles.select("repo", "kind").distinct(), "repo", "left")
    client = F.coalesce(F.col("kind").isin("web", "mobile"), F.lit(False))
    backends = routes.join(roles.filter("kind = 'backend'").select("repo").distinct(), "repo", "left_semi")
    known = modules.select("repo").distinct()
    picked = pick_backend(calls.filter(client).select("url").distinct(), backends).select("url", "backend").join(known.withColumnRenamed("repo", "backend"), "backend", "left_semi")
    callers = calls.filter(client).join(picked, "url", "left").join(known.withColumn("_known", F.lit(True)), "repo", "left")
    fits = F.col("backend").isNotNull() & F.coalesce("_known", F.lit(False)) & (F.col("backend") != F.col("repo"))
    edges = callers.filter(fits).select("repo", "url", "backend", F.lit("ROLE_HEURISTIC").alias("provenance"))
    none = callers.filter(~F.coalesce(fits, F.lit(False))).select("repo", "url", F.lit("heuristic_no_backend_target").alias("reason"))
    others = calls.filter(~client).select("repo", "url", F.when(F.col("url").rlike(DYNAMIC_URL), "dynamic_or_templated_url").otherwise("no_route_match").alias("reason"))
    return edges, none.unionByName(others)


def topology_reasons(unmatched: DataFrame, topology: DataFrame) -> DataFrame:
    """With a topology(role, callee): calls whose caller declares no callee, (repo, url, reason)."""
    return unmatched.select("repo", "url").distinct().join(topology.select(F.col("role").alias("repo")).distinct(), "repo", "left_anti").withColumn("reason", F.lit("topology_no_callee"))


def pick_backend(urls: DataFrame, routes: DataFrame) -> DataFrame:
    """urls(url) to the backend that fits best: 3 for its first segment in a record, 1 for ``/api``, 5 for an alias in a template or matching one, one
    for every ten routes up to 50; ties by route count, then name, the larger first.

    What a URL shares with a backend comes from joins on substrings and segments. A backend that shares nothing scores by ``/api`` and size alone, so only
    the best of those can win: it is one row for URLs under ``/api``, one for others."""
    known = enrich_routes(routes).checkpoint()
    wanted = urls.select("url").distinct().withColumn("head", F.concat(F.lit("/"), F.get(segments(F.col("url")), 0))).checkpoint()
    templates = known.select("repo", F.explode("templates").alias("template")).distinct()
    size = F.floor(F.least(F.col("n"), F.lit(50)) / 10).cast("long")
    per = known.groupBy("repo").agg(F.count("*").alias("n"), F.max(F.contains("raw", F.lit("/api"))).alias("api")).withColumn("size", size)

    heads = with_substrings(known.select("repo", "raw").distinct(), "raw", wanted, "head").distinct()
    by_head = wanted.select("url", "head").join(heads, "head").select("url", "repo", F.lit(3).alias("points"))
    alias = wanted.select("url", F.explode(url_aliases(F.col("url"))).alias("alias"))
    held = with_substrings(templates, "template", alias, "alias").distinct()
    by_text = alias.join(held, "alias").select("url", "repo")
    by_template = with_templates(alias, templates).select("url", "repo")
    fits = by_text.unionByName(by_template).distinct().withColumn("points", F.lit(5))

    shared = by_head.unionByName(fits).groupBy("url", "repo").agg(F.sum("points").alias("points")).join(per, "repo")
    under = F.col("url").startswith("/api")
    shared = shared.select("url", F.struct((F.col("points") + F.col("size") + (under & F.col("api")).cast("int")).cast("long").alias("score"), "n", "repo").alias("b"))
    plain = per.agg(F.max(F.struct(F.col("size").alias("score"), "n", "repo")).alias("other"), F.max(F.struct((F.col("size") + F.col("api").cast("int")).alias("score"), "n", "repo")).alias("api"))
    alone = wanted.crossJoin(F.broadcast(plain)).select("url", F.when(under, F.col("api")).otherwise(F.col("other")).alias("b")).filter("b IS NOT NULL")  # one row
    best = shared.unionByName(alone).groupBy("url").agg(F.max("b").alias("b"))
    return best.select("url", F.col("b.repo").alias("backend"), F.col("b.score").alias("score"))


def alias_match(names: DataFrame, choices: DataFrame) -> DataFrame:
    """names(name) to choices(choice): equal without punctuation, else one within the other, else most shared words (shorter, then larger wins). Names and
    choices meet on equal substrings, and names that found none on equal words."""
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), "[^a-z0-9]+")), lambda w: F.length(w) > 1)
    a = names.select("name").distinct().withColumn("n", norm(F.col("name")))
    b = choices.select("choice").distinct().withColumn("c", norm(F.col("choice")))
    full_a, full_b = a.filter("n <> ''"), b.filter("c <> ''")
    within = with_substrings(full_a.select("name", "n", F.col("n").alias("text")), "text", full_b, "c", "").join(full_b, "c")
    around = with_substrings(full_b.select("choice", "c", F.col("c").alias("text")), "text", full_a, "n", "").join(full_a, "n")
    tier = F.when(F.col("n") == F.col("c"), 1).otherwise(2)
    near = within.select("name", "choice", tier.alias("tier")).unionByName(around.select("name", "choice", tier.alias("tier")))
    first = near.groupBy("name").agg(F.min(F.struct("tier", "choice")).alias("b")).select("name", "b.choice", "b.tier")
    rest = a.join(first, "name", "left_anti")
    pairs = rest.select("name", F.explode(words(F.col("name"))).alias("word")).join(b.select("choice", F.explode(words(F.col("choice"))).alias("word")), "word")
    overlap = pairs.groupBy("name", "choice").agg(F.count("*").alias("overlap"))
    best = overlap.groupBy("name").agg(F.max(F.struct("overlap", (-F.length("choice")).alias("short"), "choice")).alias("b"))
    return first.unionByName(best.select("name", "b.choice", F.lit(3).alias("tier"))).select("name", "choice", F.col("tier").cast("int").alias("tier"))


def shared_types(types: DataFrame, block: int = 1000) -> DataFrame:
    """types(repo, rel, declaration): modules that hold one declaration, each pair once. Locations are first reduced to (declaration, module); the
    sources of a declaration are dealt out by blocks, so that one of very many modules is not paired in one task."""
    mods = types.select("declaration", module_id(F.col("repo"), F.col("rel")).alias("module")).distinct()
    parts = mods.groupBy("declaration").agg(F.count("*").alias("_n")).filter("_n > 1").select("declaration", F.ceil(F.col("_n") / block).cast("int").alias("_parts"))
    kept = mods.join(parts, "declaration")
    sources = kept.select("declaration", F.col("module").alias("source"), F.pmod(F.xxhash64("module"), F.col("_parts")).cast("int").alias("_part"))
    targets = kept.select("declaration", F.col("module").alias("target"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    return sources.join(targets, ["declaration", "_part"]).filter("source < target").select("declaration", "source", "target")


def duplicate_declarations(types: DataFrame, k: int = 50) -> DataFrame:
    """Declarations seen more than once, the k most frequent."""
    out = types.groupBy("declaration").agg(F.count("*").alias("n"), F.countDistinct("repo").alias("distinct_repos")).filter("n > 1")
    return out.orderBy(F.desc("n"), "declaration").limit(k)


def event_edges(endpoints: DataFrame, declared: DataFrame, block: int = 1000) -> DataFrame:
    """endpoints(module, kind, topic) and declared(topic, module): publisher to subscriber edges over a topic, and declared subscribers not among
    them. Both sides are reduced to (topic, module) first; a topic's publishers are dealt out by blocks, which its subscribers all meet, so that one topic of
    very many modules is not paired in one task."""
    side = lambda kind: endpoints.filter((F.col("kind") == kind) & (F.col("topic") != "")).select("topic", F.col("module").alias(kind)).distinct()
    subs = side("sub").withColumn("known", F.lit(True)).unionByName(declared.select("topic", F.col("module").alias("sub")).distinct().withColumn("known", F.lit(False)))
    subs = subs.groupBy("topic", "sub").agg(F.max("known").alias("known"))  # a subscriber that shows is no declared one
    parts = side("pub").groupBy("topic").agg(F.ceil(F.count("*") / block).cast("int").alias("_parts"))
    pubs = side("pub").join(parts, "topic").select("topic", "pub", F.pmod(F.xxhash64("pub"), F.col("_parts")).cast("int").alias("_part"))
    subs = subs.join(parts, "topic").select("topic", "sub", "known", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    found = pubs.join(subs, ["topic", "_part"]).filter("pub <> sub")
    return found.select("topic", "pub", "sub", F.when(F.col("known"), "EVENT_BUS").otherwise("EVENT_BUS_TOPOLOGY").alias("provenance"))


def resolve_modules(edges: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges(repo, rel, be_repo, be_rel, ...) to edges between known modules, and the ends without one; edges within a module are dropped."""
    both = edges.withColumn("source", module_id(F.col("repo"), F.col("rel"))).withColumn("target", module_id(F.col("be_repo"), F.col("be_rel")))
    known = modules.select("id").distinct()
    missing = both.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(known, "id", "left_anti").select(F.lit("module_missing").alias("reason"), "id")
    ok = both.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    return ok.filter("source <> target"), missing


def route_catalog(routes: DataFrame, matched: DataFrame) -> DataFrame:
    """A row per route: verb, templates, how often and by how many repositories it is called."""
    use = matched.groupBy("route_idx").agg(F.count("*").alias("usage"), F.countDistinct("repo").alias("callers"))
    out = enrich_routes(routes).join(use, "route_idx", "left")
    canonical = F.array_join(F.array_sort(F.array_distinct(F.transform("templates", canonical_path))), ",")
    return out.select("route_idx", "repo", "rel", "lineno", F.coalesce("method", F.lit("UNKNOWN")).alias("method"), F.array_join("templates", ",").alias("templates"), canonical.alias("canonical"), F.coalesce("usage", F.lit(0)).cast("long").alias("usage"), F.coalesce("callers", F.lit(0)).cast("long").alias("callers"))


def api_coverage(catalog: DataFrame) -> DataFrame:
    """Routes and linked routes per repository and of all, and the share linked in percent."""
    out = catalog.rollup("repo").agg(F.count("*").alias("routes"), F.count_if(F.col("usage") > 0).alias("linked"))
    return out.select(F.coalesce("repo", F.lit("(all)")).alias("repo"), "routes", "linked", (F.col("linked") * 100.0 / F.col("routes")).cast("double").alias("pct"))


def unresolved_summary(reasons: DataFrame) -> DataFrame:
    """Distinct unresolved calls (repo, url, reason), of ``role_fallback`` or ``topology_reasons``, by reason."""
    return reasons.select("repo", "url", "reason").distinct().groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("repo").alias("repos"))


def build_graph(modules: DataFrame, cross: DataFrame, imports: DataFrame, min_confidence: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (of each id the least path), edges from the cross-repository join and from imports of at least a confidence, and warnings for unknown ends.

    modules(id, path), cross(source, target, provenance), imports(source, target, confidence)."""
    nodes = modules.groupBy("id").agg(F.min("path").alias("path"))
    graded = imports.filter(F.col("confidence") >= min_confidence).select("source", "target", F.when(F.col("confidence") >= 2, "AST_STRONG").otherwise("AST_WEAK").alias("provenance"), F.lit("import").alias("kind"))
    edges = cross.select("source", "target", "provenance", F.lit("cross").alias("kind")).unionByName(graded).filter("source <> target").distinct()
    ids = nodes.select("id")
    warnings = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(ids, "id", "left_anti").select(F.concat(F.lit("unknown module "), "id").alias("warning"))
    ok = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes, ok, warnings


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes and of edges by kind."""
    n = nodes.agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "n")
    return n.unionByName(edges.groupBy(F.col("kind").alias("what")).agg(F.count("*").alias("n")))


def neighbors(edges: DataFrame, node: str, limit: int = 200) -> DataFrame:
    """Edges that touch a node either way."""
    return edges.filter((F.col("source") == node) | (F.col("target") == node)).orderBy("source", "target", "kind", "provenance").limit(limit)


def find_nodes(nodes: DataFrame, text: str, ignore_case: bool = True) -> DataFrame:
    path = F.lower("path") if ignore_case else F.col("path")
    return nodes.filter(F.contains(path, F.lit(text.lower() if ignore_case else text)))


def edge_kind_counts(edges: DataFrame, sql: str = "SELECT kind, count(*) AS n FROM edges GROUP BY kind ORDER BY n DESC, kind", limit: int = 1000) -> DataFrame:
    """Any SQL over a view of the edges; by default edges by kind."""
    return edges.sparkSession.sql(sql.replace("FROM edges", "FROM {edges}"), edges=edges).limit(limit)
