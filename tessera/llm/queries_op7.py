"""op7_toxicity over the whole documents table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table
from .toxicity import ToxicityModel, score_toxicity, train_toxicity

HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"


def held_out() -> Column:
    return F.coalesce(F.expr(HELD_OUT), F.lit(False))


def toxicity_model(spark: SparkSession, sf_dir: str) -> ToxicityModel:
    return train_on_labels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def train_on_labels(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> ToxicityModel:
    """Learn from labelled documents that are not held out. The labels are sampled first, so a bounded table of them is broadcast and no text is shuffled."""
    few = bounded(labels.filter(~held_out()).select("doc_id", "toxic"), sample, "doc_id")
    return train_toxicity(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"), sample)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, toxicity_model(spark, sf_dir), 0.7).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE: dict[str, str] = {}
