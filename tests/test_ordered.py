"""Row numbers and ordered comparison on several partitions."""

from tessera.operators.ordered import first_row_match, numbered, ordered_match, row_differences

KIND = "k int, v string"


def test_numbers_follow_the_order_over_partitions_and_ties(spark):
    rows = spark.range(1000).selectExpr("cast((id * 7919) % 250 AS int) AS k", "cast((id * 31) % 1000 AS string) AS v").repartition(6)
    got = [tuple(r) for r in numbered(rows, ["k"]).orderBy("row_no").collect()]
    assert [r[2] for r in got] == list(range(1, 1001)) and [r[0] for r in got] == sorted(r[0] for r in got)
    assert numbered(rows.limit(0), ["k"]).count() == 0


def test_first_difference_and_missing_rows(spark):
    actual = spark.createDataFrame([(3, "c"), (1, "a"), (2, None), (4, "d")], KIND).repartition(3)
    expected = lambda rows: spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "row_no long, k int, v string")
    assert tuple(ordered_match(actual, expected([(1, "a"), (2, None), (3, "c"), (4, "d")]), ["k"]).first()) == (True, None, 0)
    assert tuple(ordered_match(actual, expected([(1, "a"), (2, "x"), (3, "c")]), ["k"]).first()) == (False, 2, 2)
    rows = row_differences(actual, expected([(1, "a"), (2, "x"), (3, "c"), (4, "d"), (5, None)]), ["k"], ["v"]).collect()
    assert sorted(map(tuple, rows)) == [(2, "v", None, "x"), (5, "v", None, None)]


def test_first_row(spark):
    actual = spark.createDataFrame([(3, "c"), (1, "a")], KIND)
    assert first_row_match(actual, ["k"], {"v": "a"}).first().passed and not first_row_match(actual, ["k"], {"v": "c"}).first().passed
    assert not first_row_match(actual.limit(0), ["k"], {"v": None}).first().passed
