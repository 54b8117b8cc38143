"""op5_quality over the whole documents table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table
from .quality import QualityModel, score_quality, train_quality

HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"


def held_out() -> Column:
    return F.coalesce(F.expr(HELD_OUT), F.lit(False))


def quality_model(spark: SparkSession, sf_dir: str) -> QualityModel:
    sample = 4000  # labels are sampled first, so a bounded table of them is broadcast and no text is shuffled
    few = bounded(table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", "quality"), sample, "doc_id")
    return train_quality(table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(few), "doc_id"), sample)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, quality_model(spark, sf_dir)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op5_quality": op5_quality}
ORACLE: dict[str, str] = {}
