"""op4_warc over the whole pages table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .warc_zip import round_trip


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_warc": op4_warc}
ORACLE = {
    "op4_warc": """
        WITH p AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
        ), fives AS (
            SELECT *, [CAST('0x' || substr(hex, 5 * g + 1, 5) AS INTEGER) FOR g IN range(8)] AS parts FROM p
        ), d AS (
            SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31) + 1, 1) FOR k IN range(32)], '') AS payload_digest,
                max(page_id) OVER (PARTITION BY hex) AS original
            FROM fives
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> original THEN original END AS refers_to
        FROM d
    """
}
