"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or a new local one where that is unset and all runs in one process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(where)
    return where if "://" in where or where.startswith("file:") else f"file://{os.path.abspath(where)}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again. Survives lost executors. options: of the Parquet writer."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options or {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(rows: DataFrame, sample: int, key: str) -> DataFrame:
    """About ``sample`` rows, or all if there are no more: those whose key's hash is small. The rows are counted; none are sorted or moved."""
    n = rows.count()
    if n <= sample:
        return rows
    part = int((1 << 30) * min(1.0, 1.1 * sample / n))
    return rows.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) < part)


def fitted(rows: DataFrame, sample: int, fit, chars: int = 200_000_000):
    """The model that fit(texts, labels) gives for at most ``sample`` of rows(key, text, label), and of these for the first whose texts together pass
    ``chars`` characters. It is fitted in a task; only the model comes back."""
    order = F.xxhash64("key"), "text", "label"
    few = bounded(rows, sample, "key").orderBy(*order).limit(sample)
    before = F.sum(F.length("text").cast("long")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))  # at most `sample` rows
    few = few.withColumn("_before", before).filter(F.coalesce("_before", F.lit(0)) < chars).select("text", "label")

    def work(batches):
        texts, labels = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
        yield pa.record_batch([pa.array([pickle.dumps(fit(texts, labels))], pa.binary())], names=["model"])

    made = few.coalesce(1).mapInArrow(work, "model binary").collect()
    return pickle.loads(made[0][0]) if made else fit([], [])
