"""Iterative operators on edges: levels, closures, propagation. One loop shape: join only what the last round added, checkpoint it, stop when empty."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import written
from .cycles import path_ends, strong_components


# What a round may send through the driver, in rows.
SMALL_ROUND = 10_000


def reach(start: DataFrame, edges: DataFrame, keys: list[str], max_depth: int | None = None, small: int = SMALL_ROUND) -> DataFrame:
    """start(keys, node) and edges(src, dst) to (keys, node, depth): all that start reaches, or reaches within max_depth, each at its least depth. Where
    edges have columns of keys too, they hold for equal ones only. Edges are worked out once; a round writes only what it adds. Rounds of up to ``small`` rows
    are broadcast to the edges, larger ones and what was seen are never, so that what goes through the driver does not grow with the graph."""
    on = [*(k for k in keys if k in edges.columns), "src"]
    edges = edges.select(*on, "dst").checkpoint()
    frontier = seen = start.select(*keys, "node").distinct().withColumn("depth", F.lit(0)).checkpoint()
    added = frontier.count()
    for depth in count(1):
        if max_depth is not None and depth > max_depth:
            break
        at = frontier.select(*keys, F.col("node").alias("src")).hint("broadcast" if added <= small else "merge")
        step = at.join(edges, on).select(*keys, F.col("dst").alias("node")).distinct()
        frontier = step.join(seen.select(*keys, "node").hint("merge"), [*keys, "node"], "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        added = frontier.count()
        if not added:
            break
        seen = seen.unionByName(frontier)
        if depth % 20 == 0:  # a union of many rounds is too deep a plan
            seen = seen.checkpoint()
    return seen


def topological_levels(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """nodes(keys, node) and edges(keys, src, dst) to the level of each node in Kahn's order; level -1 marks nodes on or behind a cycle. A round writes the
    open nodes once, with how many sources each still waits for."""
    edges = written(edges.select(*keys, "src", "dst").distinct(), "edges")
    waits = edges.groupBy(*keys, F.col("dst").alias("node")).agg(F.count("*").alias("waits"))
    left = written(nodes.select(*keys, "node").distinct().join(waits, [*keys, "node"], "left").select(*keys, "node", F.coalesce("waits", F.lit(0)).alias("waits")), "waiting")
    out = None
    for level in count():
        free = left.filter("waits = 0").select(*keys, "node", F.lit(level).alias("level"))
        if free.isEmpty():
            break
        out = free if out is None else out.unionByName(free)
        if level % 50 == 49:  # a union of many levels is too deep a plan
            out = written(out, "levels")
        done = edges.join(free.select(*keys, F.col("node").alias("src")), [*keys, "src"]).groupBy(*keys, F.col("dst").alias("node")).agg(F.count("*").alias("done"))
        left = left.filter("waits > 0").join(done, [*keys, "node"], "left").select(*keys, "node", (F.col("waits") - F.coalesce("done", F.lit(0))).alias("waits"))
        left = written(left, "waiting")
    rest = left.select(*keys, "node", F.lit(-1).alias("level"))
    return rest if out is None else out.unionByName(rest)


def skip_propagation(status: DataFrame, deps: DataFrame) -> DataFrame:
    """status(task_id, id, status) and deps(task_id, id, dependency): a step is SKIPPED when a dependency, however far, did not pass."""
    failed = status.filter("status <> 'PASS'").select("task_id", F.col("id").alias("node"))
    edges = deps.select("task_id", F.col("dependency").alias("src"), F.col("id").alias("dst")).distinct()
    reached = reach(failed, edges, ["task_id"])
    direct = reached.select("task_id", F.col("node").alias("src")).join(edges, ["task_id", "src"]).select("task_id", F.col("dst").alias("id")).distinct().withColumn("_skip", F.lit(True))
    return status.join(direct, ["task_id", "id"], "left").select("task_id", "id", F.when(F.col("_skip"), "SKIPPED").otherwise(F.col("status")).alias("status"))


LAYERS = ["schema", "backend", "web", "mobile", "infra"]


def merge_plan(projects: DataFrame, depends_on: DataFrame) -> tuple[DataFrame, DataFrame]:
    """projects(project, layer) and depends_on(project, dep) to merge positions by level, layer and name; and errors: missing dependencies, cycles."""
    edges = depends_on.join(projects.select(F.col("project").alias("dep")), "dep", "left_semi").select(F.lit(0).alias("k"), F.col("dep").alias("src"), F.col("project").alias("dst"))
    levels = topological_levels(projects.select(F.lit(0).alias("k"), F.col("project").alias("node")), edges, ["k"]).select(F.col("node").alias("project"), "level")
    layer = F.coalesce(F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer")), F.lit(99))
    ranked = projects.join(levels.filter("level >= 0"), "project").withColumn("_l", layer)
    before = Window.partitionBy("level").orderBy("_l", "project")
    sizes = ranked.groupBy("level").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per level
    plan = ranked.withColumn("_r", F.row_number().over(before)).join(sizes, "level").select("project", "level", (F.col("base") + F.col("_r")).cast("long").alias("position"))
    missing = depends_on.join(projects.select(F.col("project").alias("dep")), "dep", "left_anti").select("project", F.concat(F.lit("missing dependency "), "dep").alias("error"))
    return plan, missing.unionByName(levels.filter("level < 0").select("project", F.lit("cycle").alias("error")))


def closure(links: DataFrame, start: list[int], depth: int | None = None, types: list[str] | None = None) -> DataFrame:
    """links(src, dst, type): what the start nodes reach within a depth, over the given link types."""
    edges = (links.filter(F.col("type").isin(*types)) if types else links).select(F.lit(0).alias("k"), "src", "dst").distinct()
    first = links.sparkSession.createDataFrame([(0, s) for s in start], "k int, node long")
    return reach(first, edges, ["k"], depth).filter("depth > 0").select("node", "depth")


def evolution_chain(links: DataFrame) -> DataFrame:
    """links(src, dst, type): each decision that nothing of type ``replaces`` replaced into, followed to its current heirs: (id, current, hops)."""
    edges = links.filter("type = 'replaces'").select("src", "dst").distinct()
    roots = edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    ends, _ = path_ends(edges)
    return ends.join(roots, "node", "left_semi").select(F.col("node").alias("id"), F.col("end").alias("current"), "hops")


def successors(links: DataFrame) -> DataFrame:
    """links(src, dst, type): each replaced decision with its direct heirs (succeeded_by, several if it was split), the heirs in force today (current) and
    the least and greatest hops to them; no current heirs where its replacements run in a circle."""
    edges = links.filter("type = 'replaces'").select("src", "dst").distinct()
    direct = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("succeeded_by"))  # heirs of one decision
    ends, _ = path_ends(edges)
    today = ends.groupBy(F.col("node").alias("id")).agg(F.sort_array(F.collect_set("end")).alias("current"), F.min("hops").alias("nearest"), F.max("hops").alias("farthest"))
    return direct.join(today, "id", "left").select("id", "succeeded_by", F.coalesce("current", F.array().cast("array<long>")).alias("current"), "nearest", "farthest")


def replacement_cycles(links: DataFrame) -> DataFrame:
    """(component, node) of the cycles of ``replaces`` among links(src, dst, type); a decision between two cycles is in none."""
    edges = links.filter("type = 'replaces'").select(F.lit(0).alias("k"), "src", "dst")
    return strong_components(edges, ["k"]).select("component", "node")


def link_integrity(links: DataFrame, decisions: DataFrame) -> DataFrame:
    """Links to unknown decisions, conflicts between two active ones, and decisions on a cycle of ``replaces``."""
    known = decisions.select(F.col("id").alias("dst"))
    dangling = links.join(known, "dst", "left_anti").select(F.col("src").alias("id"), F.concat(F.lit("dangling "), F.col("dst").cast("string")).alias("problem"))
    active = decisions.filter("status = 'Active'").select("id")
    conflict = links.filter("type = 'conflicts'").join(active.withColumnRenamed("id", "src"), "src").join(active.withColumnRenamed("id", "dst"), "dst")
    conflict = conflict.select(F.col("src").alias("id"), F.concat(F.lit("conflicts with active "), F.col("dst").cast("string")).alias("problem"))
    return dangling.unionByName(conflict).unionByName(replacement_cycles(links).select(F.col("node").alias("id"), F.lit("cycle").alias("problem")))


def provenance(decisions: DataFrame, links: DataFrame, root: int, max_hops: int | None = None) -> DataFrame:
    """What a decision rests on and what rests on it: (direction, id, hops, far beyond five hops, product)."""
    up = closure(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"), [root], max_hops).withColumn("direction", F.lit("parent"))
    down = closure(links, [root], max_hops).withColumn("direction", F.lit("child"))
    rows = up.unionByName(down).join(decisions.select(F.col("id").alias("node"), "product").hint("merge"), "node", "left")
    return rows.select("direction", F.col("node").alias("id"), F.col("depth").cast("long").alias("hops"), (F.col("depth") > 5).alias("far"), "product")


def most_depended_on(links: DataFrame, k: int = 10) -> DataFrame:
    return links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("dependents")).orderBy(F.desc("dependents"), "id").limit(k)
