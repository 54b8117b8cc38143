"""op8_language_id over the whole documents table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .language_id import LanguageModel, identify_language, train_language

HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"


def held_out() -> Column:
    return F.coalesce(F.expr(HELD_OUT), F.lit(False))


def language_model(docs: DataFrame) -> LanguageModel:
    return train_language(docs.filter(~held_out()).select("doc_id", "text", "lang"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_language(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
ORACLE: dict[str, str] = {}
