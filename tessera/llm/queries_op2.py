"""op2_exact_top_k over the whole embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .va_file import top_k


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors.filter("vec_id % 20 = 0"), vectors, k=20)


QUERIES = {"op2_exact_top_k": op2_exact_top_k}
ORACLE = {
    "op2_exact_top_k": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product([CAST(x AS DOUBLE) FOR x IN q.c], [CAST(x AS DOUBLE) FOR x IN d.c]) AS BIGINT) AS score
            FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id AND len(q.c) = len(d.c)
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """
}
