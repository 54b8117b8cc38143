"""op1_ngram_jaccard_join over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .jaccard_join import near_duplicates


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=90)


QUERIES = {"op1_ngram_jaccard_join": op1_ngram_jaccard_join}
ORACLE = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                ELSE list_distinct([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)]) END AS shingles
            FROM w
        ), e AS (
            SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
        ), p AS (
            SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS total, count(*) AS common FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT x, y FROM p WHERE 100 * common >= 90 * (total - common)
        ), sides AS (
            SELECT x, y FROM links UNION ALL SELECT y, x FROM links
        ), reached(doc_id, other) AS (
            SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.y FROM reached r JOIN sides l ON r.other = l.x
        )
        SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, min(other) AS component_id FROM s JOIN reached r ON s.doc_id = r.doc_id GROUP BY ALL
    """
}
