from tessera.operators.crossrepo import shared_types
from tessera.operators.docs import doc_node_links


def test_a_type_of_many_modules(spark):
    types = spark.createDataFrame([("r", f"m{i:03}/x.ts", "type A") for i in range(60)] + [("r", "m1/x.ts", "type B")], "repo string, rel string, declaration string")
    for block in (1000, 7):
        rows = [tuple(r) for r in shared_types(types, block).collect()]
        assert sorted(rows) == [("type A", f"r-m{i:03}", f"r-m{j:03}") for i in range(60) for j in range(i + 1, 60)]


def test_slugs(spark):
    nodes = spark.createDataFrame([(1, "auth-service"), (2, "with-payments-api"), (3, "ledger"), (4, "x-y-z")], "id long, term string")
    texts = ["The Auth-Service.", "auth only", "with care", "payments", "pre-x-y-z-post", "x-y", "ledger-x", "with-payments-api", "ledgers auth--", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    found = sorted(map(tuple, doc_node_links(docs, nodes).collect()))
    assert found == [(0, 1), (1, 1), (3, 2), (4, 4), (6, 3), (7, 2), (8, 1)]
    assert sorted(map(tuple, doc_node_links(docs, nodes.filter("id = 3")).collect())) == [(6, 3)]
