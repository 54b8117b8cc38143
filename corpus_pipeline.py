"""Training-data pipeline: language ID, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return documents with their columns. A stage's result is written as
Parquet and read again as the next one's docs.

The near-duplicate stage decides on rows: rows that repeat a doc_id with other texts are documents of their own, and rows without id are compared too.
Of texts without words, which can't be compared, only rows that repeat both id and text are one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, written
from tessera.llm.jaccard_join import near_duplicates
from tessera.llm.language_id import UNDETERMINED, identify_language
from tessera.llm.packing import pack_documents
from tessera.llm.queries_op7 import train_on_labels
from tessera.llm.queries_op8 import language_model
from tessera.llm.toxicity import score_toxicity

MIN_LANGUAGE_SCORE, TOXIC = 0.5, 0.7


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a probability of at least MIN_LANGUAGE_SCORE."""
    found = identify_language(docs, language_model(docs), lang="_lang", score="_lang_score")
    return found.filter((F.col("_lang") != UNDETERMINED) & (F.col("_lang_score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC."""
    model = train_on_labels(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, TOXIC, score="_toxic_score", predicted="_toxic").filter("_toxic = 0").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the row of smallest doc_id, nulls last, then smallest text digest."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), width=5, percent=80)
    marks = rows.select("_row", "doc_id", F.sha2("text", 256).alias("digest"))
    found = groups.select(F.col("doc_id").alias("_row"), "n_shingles", "component_id").join(marks, "_row")
    same = F.when((F.col("n_shingles") == 0) & F.col("doc_id").isNotNull(), F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.coalesce("digest", F.lit(""))))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "_row")
    keep = found.groupBy(F.coalesce(same, F.col("component_id").cast("string")).alias("group")).agg(F.min(order).alias("least")).select("least._row")
    return rows.join(keep, "_row", "left_semi").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [("language_id", language_stage), ("toxicity", toxicity_stage), ("ngram_jaccard_join", near_duplicate_stage), ("best_fit_packing", packing_stage)]
ORACLE_SQL = None  # trained models and tokens are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
