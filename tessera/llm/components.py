"""Connected components by alternating large-star and small-star steps, each a shuffle of the edges. Before each step a task replaces the edges it reads by
stars of what they connect, a bounded number at a time, which needs no shuffle and shortens long chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import fresh_path, written


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of what the edges connect: each node but the least, and the least."""
    ids, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, parent = places[: len(a)], places[len(a) :], np.arange(len(ids))
    while True:
        high, low = np.maximum(parent[x], parent[y]), np.minimum(parent[x], parent[y])
        if (high == low).all():
            break
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    own = np.flatnonzero(parent != np.arange(len(ids)))
    return ids[own], ids[parent[own]]


def contracted(edges: DataFrame, size: int = 1_000_000) -> DataFrame:
    """edges(u, v) to stars (u above v) of each ``size`` edges of a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            u, v = star_edges(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(u) for u, _ in held) >= size:
                yield close()
        if held:
            yield close()

    return edges.select("u", "v").mapInArrow(work, "u long, v long")


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges(u, v) of one direction each. Link the neighbours of each node to its least neighbour: those above it, or (small) those below it."""
    if small:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """edges(a, b) to (node, root) for every node of an edge; root is the least node of its component. Rounds grow with the logarithm of the size."""
    spark = edges.sparkSession

    def kept(state: DataFrame) -> tuple[DataFrame, tuple]:
        """The state as a written table, and its number of edges and sum of hashes, taken while it is written."""
        seen, path = Observation(), fresh_path(spark, name)
        watched = state.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash"))
        watched.write.parquet(path)
        return spark.read.schema(state.schema).parquet(path), (seen.get["n"], seen.get["hash"])

    state = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), name)  # many small parts are read as few
    for _ in range(rounds):
        stars, before = kept(contracted(state))
        state, after = kept(_star(_star(stars, False), True))
        if after == before:  # stars of least nodes, which neither step changes
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return state.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
