"""Queries of this subpackage against their SQL in DuckDB on the same tables."""

import duckdb
import pytest

from tessera.llm import registry

TABLES = ("documents", "embeddings", "pages", "benchmark", "conversations")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, found = registry.queries()[name](spark, sf_dir), con.execute(registry.oracle_sql()[name])
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema} == {c[0]: str(c[1]) for c in found.description}
    order = sorted(df.columns)
    want = sorted((tuple(r[[c[0] for c in found.description].index(c)] for c in order) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr) == want
