"""op12_phrase_collocations over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .collocations import collocations
from .common import table


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), max_words=3, min_count=10, inside_percent=50, top=2000)


QUERIES = {"op12_phrase_collocations": op12_phrase_collocations}
ORACLE = {
    "op12_phrase_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (
            SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p
        ), n AS (
            SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang
        ), grams AS (
            SELECT lang, k.k, unnest([words[i:i + k.k - 1] FOR i IN range(1, len(words) - k.k + 2)]) AS words FROM w, (VALUES (1), (2), (3)) k(k)
        ), f AS (
            SELECT lang, k, words, array_to_string(words, ' ') AS phrase, count(*) AS f FROM grams GROUP BY lang, k, words HAVING count(*) >= 10
        ), cuts AS (
            SELECT c.lang, c.phrase, c.k, c.f AS a, x.k AS cut, x.f AS l, y.f AS r, CAST(1000000 * CAST(c.f AS HUGEINT) * c.f // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
            FROM f c JOIN f x ON c.lang = x.lang AND x.k < c.k AND x.words = c.words[1:x.k] JOIN f y ON c.lang = y.lang AND y.k = c.k - x.k AND y.words = c.words[x.k + 1:c.k]
        ), least AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
        ), held AS (
            SELECT lang, array_to_string(sub, ' ') AS phrase, max(f) AS longer FROM (SELECT lang, f, unnest([words[1:2], words[2:3]]) AS sub FROM f WHERE k = 3) GROUP BY ALL
        ), ranked AS (
            SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least l LEFT JOIN held h USING (lang, phrase) WHERE coalesce(100 * h.longer < 50 * a, true)
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
    """
}
