"""op3_best_fit_packing over the whole documents table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .packing import pack_documents


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
ORACLE: dict[str, str] = {}
