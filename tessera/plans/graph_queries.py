"""Queries of iterative graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from .registry import register
from .shared import checkpoint_dir


def looped(query):
    """A query that checkpoints its rounds."""

    def run(t):
        checkpoint_dir(t.spark)
        return query(t)

    return run


def deps(t):
    """Per task of 16 parts a dependency tree; every 37th part also closes a cycle."""
    nodes = t.part.select(F.expr("p_partkey div 16").alias("task_id"), F.col("p_partkey").alias("node"))
    tree = t.part.filter("p_partkey % 16 > 0").select(F.expr("p_partkey div 16").alias("task_id"), F.expr("p_partkey div 16 * 16 + p_partkey % 16 div 2").alias("src"), F.col("p_partkey").alias("dst")).filter("src <> dst")
    back = tree.filter("dst % 37 = 0").select("task_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return nodes, tree.unionByName(back)


LEVELS = """
, e AS (SELECT p_partkey // 16 AS task_id, p_partkey // 16 * 16 + (p_partkey % 16) // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey % 16 > 0), bad0 AS (SELECT task_id, src, dst FROM e WHERE dst % 37 = 0 AND src <> dst),
bad(node) AS (SELECT src FROM bad0 UNION SELECT e.dst FROM bad b JOIN e ON e.src = b.node WHERE e.src <> e.dst),
lv(node, level) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey % 16 = 0 UNION ALL SELECT e.dst, level + 1 FROM lv JOIN e ON e.src = lv.node WHERE e.src <> e.dst)
"""
register("gr3_topological_levels", looped(lambda t: G.topological_levels(*deps(t), ["task_id"])), "", LEVELS + "SELECT node // 16 AS task_id, node, CAST(CASE WHEN node IN (SELECT node FROM bad) THEN -1 ELSE level END AS INTEGER) AS level FROM lv")


def projects(t):
    layer = "element_at(array('schema', 'backend', 'web', 'mobile', 'other'), int(p_partkey % 5) + 1)"
    rows = t.part.filter("p_partkey > 0").select(F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("project"), F.expr(layer).alias("layer"))
    dep = t.part.filter("p_partkey > 1").select(F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("project"), F.expr("CASE WHEN p_partkey % 41 = 0 THEN concat('gone', p_partkey) ELSE concat('p', lpad(p_partkey div 2, 8, '0')) END").alias("dep"))
    return rows, dep


PLAN = """
, e AS (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey > 1 AND p_partkey % 41 <> 0), lv(k, level) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey > 0 AND (p_partkey = 1 OR p_partkey % 41 = 0) UNION ALL SELECT dst, level + 1 FROM lv JOIN e ON src = k)
"""
register("gr4_merge_plan", looped(lambda t: G.merge_plan(*projects(t))[0]), "", PLAN + "SELECT 'p' || lpad(CAST(k AS VARCHAR), 8, '0') AS project, CAST(level AS INTEGER) AS level, row_number() OVER (ORDER BY level, CASE k % 5 WHEN 4 THEN 0 ELSE k % 5 + 1 END, k) AS position FROM lv")
register("gr4_merge_errors", looped(lambda t: G.merge_plan(*projects(t))[1]), "", "SELECT 'p' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS project, 'missing dependency gone' || CAST(p_partkey AS VARCHAR) AS error FROM part WHERE p_partkey > 1 AND p_partkey % 41 = 0")
register("gr6_closure", looped(lambda t: G.closure(t.links, [3, 5], 3)), "links", ", r(node, depth) AS (SELECT * FROM (VALUES (3, 0), (5, 0)) v(a, b) UNION SELECT dst, depth + 1 FROM r JOIN links ON src = node WHERE depth < 3) SELECT CAST(node AS BIGINT) AS node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node HAVING min(depth) > 0")
register("gr6_closure_of_type", looped(lambda t: G.closure(t.links, [1], 1000, ["related", "replaces"])), "links", ", r(node, depth) AS (SELECT 1, 0 UNION SELECT dst, depth + 1 FROM r JOIN links ON src = node WHERE type IN ('related', 'replaces')) SELECT CAST(node AS BIGINT) AS node, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE depth > 0 GROUP BY node")
register("gr7_evolution_chain", looped(lambda t: G.evolution_chain(t.links)), "links", """
, e AS (SELECT src, dst FROM links WHERE type = 'replaces'), r(id, node, depth) AS (SELECT src, src, 0 FROM (SELECT DISTINCT src FROM e WHERE src NOT IN (SELECT dst FROM e)) UNION SELECT id, dst, depth + 1 FROM r JOIN e ON e.src = node)
SELECT id, node AS current, CAST(min(depth) AS BIGINT) AS hops FROM r WHERE node NOT IN (SELECT src FROM e) GROUP BY 1, 2""")


def integrity(t):
    links = t.links.unionByName(t.links.filter("type = 'replaces' AND dst % 21 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"))
    return links, t.decisions.filter("id % 13 <> 0").select("id", "status")


register("gr8_link_integrity", looped(lambda t: G.link_integrity(*integrity(t))), "links decisions", """
, l AS (SELECT * FROM links UNION ALL SELECT dst, src, type FROM links WHERE type = 'replaces' AND dst % 21 = 0), d AS (SELECT id, status FROM decisions WHERE id % 13 <> 0)
SELECT src AS id, 'dangling ' || CAST(dst AS VARCHAR) AS problem FROM l WHERE dst NOT IN (SELECT id FROM d)
UNION ALL SELECT src, 'conflicts with active ' || CAST(dst AS VARCHAR) FROM l WHERE type = 'conflicts' AND src IN (SELECT id FROM d WHERE status = 'Active') AND dst IN (SELECT id FROM d WHERE status = 'Active')
UNION ALL SELECT DISTINCT unnest([src, dst]), 'cycle' FROM links WHERE type = 'replaces' AND dst % 21 = 0""")
register("gr9_provenance", looped(lambda t: G.provenance(t.decisions, t.links, 3)), "links decisions", """
, c(node, depth) AS (SELECT CAST(3 AS BIGINT), 0 UNION ALL SELECT dst, depth + 1 FROM c JOIN links ON src = node), p(node, depth) AS (SELECT CAST(3 AS BIGINT), 0 UNION ALL SELECT src, depth + 1 FROM p JOIN links ON dst = node),
x AS (SELECT 'child' AS direction, * FROM c WHERE depth > 0 UNION ALL SELECT 'parent', * FROM p WHERE depth > 0) SELECT direction, node AS id, CAST(depth AS BIGINT) AS hops, depth > 5 AS far, product FROM x LEFT JOIN decisions ON id = node""")
register("gr9_most_depended_on", lambda t: G.most_depended_on(t.lineitem.select(F.col("l_suppkey").alias("src"))), "", "SELECT l_suppkey AS id, count(*) AS dependents FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")


def bridged(t):
    """Pairs that replace each other, with one-way links between the pairs."""
    return t.links.unionByName(t.links.filter("type = 'replaces' AND dst % 21 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"))


register("gr8_replacement_cycles", looped(lambda t: G.replacement_cycles(bridged(t))), "links", """
, e AS (SELECT src, dst FROM links WHERE type = 'replaces' UNION SELECT dst, src FROM links WHERE type = 'replaces' AND dst % 21 = 0),
r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)
SELECT CAST(min(x.b) AS BIGINT) AS component, CAST(x.a AS BIGINT) AS node FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")


def split(t):
    """Decisions replaced by one or two others."""
    return t.links.withColumn("type", F.expr("CASE WHEN dst % 7 = 0 THEN 'related' ELSE 'replaces' END"))


said = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
register("gr7_successors", looped(lambda t: G.successors(split(t)).select("id", said("succeeded_by").alias("succeeded_by"), F.sha2(said("current"), 256).alias("current_sha256"), F.size("current").cast("long").alias("n_current"), "nearest", "farthest")), "links", """
, e AS (SELECT src, dst FROM links WHERE dst % 7 <> 0), r(id, node, depth) AS (SELECT src, dst, 1 FROM e UNION ALL SELECT id, dst, depth + 1 FROM r JOIN e ON e.src = node),
ends AS (SELECT id, node, min(depth) AS hops FROM r WHERE node NOT IN (SELECT src FROM e) GROUP BY ALL), direct AS (SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS succeeded_by FROM e GROUP BY src)
SELECT CAST(id AS BIGINT) AS id, any_value(succeeded_by) AS succeeded_by, sha256(string_agg(CAST(node AS VARCHAR), ' ' ORDER BY node)) AS current_sha256,
 count(*) AS n_current, CAST(min(hops) AS BIGINT) AS nearest, CAST(max(hops) AS BIGINT) AS farthest FROM ends JOIN direct USING (id) GROUP BY id""")
