"""op6_document_fingerprints over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bloom_lookup import fingerprints
from .common import table


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_document_fingerprints": op6_document_fingerprints}
ORACLE: dict[str, str] = {}
