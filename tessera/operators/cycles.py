"""Strongly connected components and path doubling on edges, as rounds of joins whose number grows with the logarithm of path lengths where it can."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import written


def least_labels(edges: DataFrame, keys: list[str]) -> DataFrame:
    """edges(keys, src, dst) to (keys, node, label): the least node that reaches a node, itself included.

    A round takes the least label of all sources, then the label of the node that the label names (it reaches this one too), so labels run along a path
    in doubling steps. Only nodes whose label fell send it on."""
    nodes = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node")).distinct()
    labels = written(nodes.withColumn("label", F.col("node")).withColumn("fell", F.lit(True)), "labels")
    while True:
        sent = labels.filter("fell").select(*keys, F.col("node").alias("src"), "label").join(edges, [*keys, "src"]).groupBy(*keys, F.col("dst").alias("node")).agg(F.min("label").alias("offer"))
        named = labels.select(*keys, F.col("node").alias("label"), F.col("label").alias("beyond"))
        told = labels.select(*keys, "node", "label").join(sent, [*keys, "node"], "left").join(named, [*keys, "label"])
        least = F.least("label", "offer", "beyond")  # nulls aside
        labels = written(told.select(*keys, "node", least.alias("label"), (least < F.col("label")).alias("fell")), "labels")
        if labels.filter("fell").isEmpty():
            return labels.drop("fell")


def _between(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges whose source has an edge to it and whose target has one from it: the others lie on no cycle."""
    into = edges.select(*keys, F.col("dst").alias("src")).distinct()
    out_of = edges.select(*keys, F.col("src").alias("dst")).distinct()
    return edges.join(into, [*keys, "src"], "left_semi").join(out_of, [*keys, "dst"], "left_semi").select(*keys, "src", "dst")


def strong_components(edges: DataFrame, keys: list[str], trims: int = 1) -> DataFrame:
    """edges(keys, src, dst) to (keys, component, node) of every node that lies on a cycle; component is its cycle's least node.

    Forward and backward labels: nodes of one component have the same least ancestor and the same least descendant, and a node whose two labels are equal
    is in the component of the node they name. What is found is taken out, edges between different labels are cut, and the rest goes round again. Ends
    of chains are trimmed first, a few times a round. Nodes without a cycle, between two cycles among them, are in no row."""
    edges = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(*keys, "src", "dst").distinct()
    loops = edges.filter("src = dst").select(*keys, F.col("src").alias("component"), F.col("src").alias("node"))
    live, out = written(edges.filter("src <> dst"), "edges"), None
    while True:
        for _ in range(trims):
            live = written(_between(live, keys), "edges")
        if live.isEmpty():
            break
        ahead = least_labels(live, keys).withColumnRenamed("label", "ahead")
        same = live.join(ahead.select(*keys, F.col("node").alias("src"), F.col("ahead").alias("a")), [*keys, "src"]).join(ahead.select(*keys, F.col("node").alias("dst"), F.col("ahead").alias("b")), [*keys, "dst"])
        same = written(same.filter("a = b").select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")), "edges")
        back = least_labels(same, keys).withColumnRenamed("label", "back")
        both = written(ahead.join(back, [*keys, "node"]), "components")
        found = both.filter("ahead = back").select(*keys, F.col("ahead").alias("component"), "node")
        found = found.join(found.filter("component <> node").select(*keys, "component").distinct(), [*keys, "component"], "left_semi")  # not a node alone
        out = found if out is None else out.unionByName(found)
        rest = both.filter("ahead <> back").select(*keys, "node", F.struct("ahead", "back").alias("labels"))
        live = same.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
        live = live.join(rest.select(*keys, F.col("node").alias("src"), F.col("labels").alias("a")), [*keys, "src"]).join(rest.select(*keys, F.col("node").alias("dst"), F.col("labels").alias("b")), [*keys, "dst"])
        live = written(live.filter("a = b").select(*keys, "src", "dst"), "edges")
    if out is None:
        return loops
    alone = loops.join(out.select(*keys, "node"), [*keys, "node"], "left_anti").select(*keys, "component", "node")
    return out.unionByName(alone)


def path_ends(edges: DataFrame, keys: list[str] = []) -> tuple[DataFrame, int]:  # noqa: B006
    """edges(keys, src, dst) to (keys, node, end, hops): the nodes without an outgoing edge at which the paths of each node end, at their least distance;
    and the rounds it took. Paths double each round, so a longest path of n edges takes about log2(n) rounds. Ways that only run in circles end nowhere."""
    edges = edges.filter("src <> dst").select(*keys, "src", "dst").distinct()
    goes_on = edges.select(*keys, F.col("src").alias("end"), F.lit(True).alias("open")).distinct()
    goes_on = written(goes_on, "nodes")
    steps = edges.select(*keys, F.col("src").alias("node"), F.col("dst").alias("end"), F.lit(1).cast("long").alias("hops"))
    steps = written(steps.join(goes_on, [*keys, "end"], "left").select(*keys, "node", "end", "hops", F.coalesce("open", F.lit(False)).alias("open")), "paths")
    limit = max(goes_on.count(), 1)
    for rounds in count(1):
        ended = steps.filter("NOT open").drop("open")
        if 2 ** (rounds - 1) > limit or steps.filter("open").isEmpty():  # paths longer than there are nodes run in circles
            return ended, rounds
        more = steps.select(*keys, F.col("node").alias("end"), F.col("end").alias("far"), F.col("hops").alias("further"), F.col("open").alias("still"))
        longer = steps.filter("open").join(more, [*keys, "end"]).select(*keys, "node", F.col("far").alias("end"), (F.col("hops") + F.col("further")).alias("hops"), F.col("still").alias("open"))
        steps = longer.unionByName(steps.filter("NOT open")).groupBy(*keys, "node", "end", "open").agg(F.min("hops").alias("hops"))
        steps = written(steps.select(*keys, "node", "end", "hops", "open"), "paths")

