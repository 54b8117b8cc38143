"""Every registered query against its SQL twin in DuckDB on the same tables."""

import duckdb
import pytest

from tessera.plans import registry
from tessera.plans.fixtures import TABLES

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    found = duck.execute(ORACLE[name])
    cols = [c[0] for c in found.description]
    assert sorted(cols) == sorted(df.columns)
    kinds = {c[0]: str(c[1]) for c in found.description}
    for f in df.schema:
        assert KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) == kinds[f.name], f.name
    order = sorted(cols)
    want = sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == want


def test_all_have_twins():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)


def test_posix_cksum(spark, sf_dir):
    """Published check values: cksum of nothing, and of the digits 1 to 9."""
    from pyspark.sql import functions as F

    from tessera.operators.facts import posix_cksum

    df = spark.createDataFrame([("",), ("123456789",), (None,)], "t string").coalesce(1)
    assert [r.c for r in df.select(posix_cksum(F.col("t")).alias("c")).collect()] == [4294967295, 930766865, None]
    assert QUERIES["cs13_posix_cksum"](spark, sf_dir).filter("cksum IS NULL").count() == 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["repo", "rel", "lineno", "url", "route_idx", "be_repo", "be_rel", "be_lineno", "provenance"] and df.count() > 0
