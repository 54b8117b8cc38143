"""op10_sentencepiece over the whole documents table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .sentencepiece_codec import digests


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op10_sentencepiece": op10_sentencepiece}
ORACLE: dict[str, str] = {}
