"""op11_benchmark_decontamination over the whole documents and benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .positional_index import build_index, contamination

WIDTH = 10


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), WIDTH)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


QUERIES = {"op11_benchmark_decontamination": op11_benchmark_decontamination}
ORACLE = {
    "op11_benchmark_decontamination": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
        ), asked AS (
            SELECT DISTINCT item_id, least(10, len(words)) AS n, unnest([array_to_string(words[i:i + 9], ' ') FOR i IN range(1, greatest(2, len(words) - 8))]) AS phrase FROM b WHERE len(words) > 0
        ), grams AS (
            SELECT r, k.n, unnest([{'place': i, 'phrase': array_to_string(words[i:i + k.n - 1], ' ')} FOR i IN range(1, len(words) - k.n + 2)], recursive := true) FROM d, (SELECT DISTINCT n FROM asked) k
        ), found AS (
            SELECT r, place, n, item_id FROM grams JOIN asked USING (n, phrase)
        ), hit AS (
            SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(place, place + n)) AS w FROM found) GROUP BY r
        ), held AS (
            SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r
        )
        SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN held USING (r)
    """
}
