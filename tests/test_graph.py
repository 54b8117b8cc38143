from pyspark.sql import functions as F

from tessera.functions.paths import join_route
from tessera.operators.cycles import path_ends, strong_components
from tessera.operators.facts import mounted_routes
from tessera.operators.graph import evolution_chain, link_integrity, provenance, reach, successors, topological_levels
from tessera.operators.qa import validate_steps


def test_long_evolution_chain(spark):
    links = spark.createDataFrame([(i, i + 1, "replaces") for i in range(53)] + [(100, 101, "replaces"), (7, 200, "related")], "src long, dst long, type string")
    assert sorted(map(tuple, evolution_chain(links).collect())) == [(0, 53, 53), (100, 101, 1)]


def test_levels_beyond_one_checkpoint(spark):
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(52)] + [(1, 1, 2), (1, 2, 1)], "k int, src long, dst long")
    nodes = edges.select("k", F.explode(F.array("src", "dst")).alias("node")).distinct()
    rows = topological_levels(nodes, edges, ["k"]).collect()
    assert sorted((r.k, r.node, r.level) for r in rows) == [(0, i, i) for i in range(53)] + [(1, 1, -1), (1, 2, -1)]


EDGES = "k int, src long, dst long"


def reachable(edges):
    """Pairs of nodes joined by a path of at least one edge, per key, by plain search."""
    out = set()
    for k in {e[0] for e in edges}:
        to = {}
        for _, a, b in (e for e in edges if e[0] == k):
            to.setdefault(a, set()).add(b)
        for a in to:
            seen, open_ = set(), [a]
            while open_:
                for b in to.get(open_.pop(), ()):
                    if b not in seen:
                        seen.add(b)
                        open_.append(b)
            out |= {(k, a, b) for b in seen}
    return out


CASES = [
    [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4)],  # two cycles and a node between them
    [(i, (i + 1) % 9) for i in range(9)] + [(100 + i, 101 + i) for i in range(6)] + [(106, 0), (3, 50), (50, 50), (50, 51)],
    [(9, 8), (8, 7), (7, 9), (7, 3), (3, 2), (2, 3), (1, 9), (2, 12), (12, 11), (11, 12)],
    [((i * 7) % 23, (i * i + 1) % 23) for i in range(23)],
    [((i * 5) % 17, (i * i + 3) % 17) for i in range(17)],
    [(9, 8)],
]


def test_strong_components_equal_mutual_reach(spark):
    edges = [(k, a, b) for k, case in enumerate(CASES) for a, b in case]
    far = reachable(edges)
    on = {(k, a) for k, a, b in far if a == b}
    want = {(k, min(b for q, a2, b in far if (q, a2) == (k, a) and (k, b, a) in far), a) for k, a in on}
    rows = [tuple(r) for r in strong_components(spark.createDataFrame(edges, EDGES), ["k"]).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert strong_components(spark.createDataFrame([], EDGES), ["k"]).count() == 0


def test_a_node_between_two_cycles_is_on_none(spark):
    links = spark.createDataFrame([(1, 2, "replaces"), (2, 1, "replaces"), (2, 3, "replaces"), (3, 4, "replaces"), (4, 5, "replaces"), (5, 4, "replaces")], "src long, dst long, type string")
    decisions = spark.createDataFrame([(i, "Warm") for i in range(1, 6)], "id long, status string")
    assert sorted(r.id for r in link_integrity(links, decisions).collect() if r.problem == "cycle") == [1, 2, 4, 5]


def test_a_chain_of_4096_links_takes_14_rounds(spark):
    ends, rounds = path_ends(spark.range(4096).selectExpr("id AS src", "id + 1 AS dst"))
    assert rounds <= 14
    assert ends.filter("end <> 4096 OR hops <> 4096 - node").isEmpty() and ends.count() == 4096


def test_paths_that_run_in_circles_end_nowhere(spark):
    ends, _ = path_ends(spark.createDataFrame([(1, 2), (2, 1), (2, 3), (7, 8), (8, 7)], "src long, dst long"))
    assert sorted(map(tuple, ends.collect())) == [(1, 3, 2), (2, 3, 1)]


def test_parallel_heirs(spark):
    links = spark.createDataFrame([(1, 2, "replaces"), (1, 3, "replaces"), (3, 4, "replaces"), (4, 5, "replaces"), (2, 5, "related"), (8, 9, "replaces"), (9, 8, "replaces")], "src long, dst long, type string")
    assert sorted(map(tuple, successors(links).collect())) == [(1, [2, 3], [2, 5], 1, 3), (3, [4], [5], 2, 2), (4, [5], [5], 1, 1), (8, [9], [], None, None), (9, [8], [], None, None)]


def test_step_file_errors(spark):
    rows = [(1, "a", ["b"]), (1, "b", ["c"]), (1, "c", ["a"]), (1, "d", ["c", "nope"]), (1, "e", ["e"]), (2, "a", []), (2, "b", ["a"]), (3, None, None)]
    steps = spark.createDataFrame([(t, i, "rest", "x", d) for t, i, d in rows], "task_id int, id string, surface string, intent string, depends_on array<string>")
    got = sorted((r.task_id, r.id or "", r.error) for r in validate_steps(steps, ["rest"]).collect())
    assert got == [(1, "a", "dependency cycle"), (1, "b", "dependency cycle"), (1, "c", "dependency cycle"), (1, "d", "unknown dependency"), (1, "e", "dependency cycle"), (3, "", "no steps")]


def test_deep_mounts_are_whole_and_circles_end(spark):
    routes = spark.createDataFrame([("r", "f0", "GET", "/x"), ("r", "a", "GET", "/y")], "repo string, rel string, method string, path string")
    mounts = spark.createDataFrame([("r", f"f{i + 1}", "/m", f"f{i}") for i in range(14)] + [("r", "a", "/p", "b"), ("r", "b", "/q", "a")], "repo string, rel string, prefix string, child string")
    paths = {(r.rel, r.path) for r in mounted_routes(routes, mounts).collect()}
    assert max(len(p) for _, p in paths) == 30 and paths == {("f0", "/m" * k + "/x") for k in range(1, 15)} | {("a", "/q/y")}


def test_rounds_beyond_the_broadcast_size(spark):
    """Small and large rounds find the same, and the last join sends no table through the driver."""
    rows = [(i // 2, i, "replaces") for i in range(2, 200)] + [(150, 3, "replaces"), (9, 9, "related")]
    links = spark.createDataFrame(rows, "src long, dst long, type string")
    edges = links.select(F.lit(0).alias("k"), "src", "dst")
    start = spark.createDataFrame([(0, 1)], "k int, node long")
    want = {(i, i.bit_length() - 1) for i in range(1, 200)}
    for small in (0, 3, 10_000):
        assert {(r.node, r.depth) for r in reach(start, edges, ["k"], small=small).collect()} == want
    decisions = spark.createDataFrame([(i, f"P{i % 4}") for i in range(200)], "id long, product string")
    found = provenance(decisions, links, 75)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.direction, r.id) for r in found.collect() if r.direction == "parent"} == {("parent", i) for i in (37, 18, 9, 4, 2, 1)}


def test_mounts_keep_rows_and_paths_whatever_their_spelling(spark):
    """Steps give what a plain walk with ``join_route`` gives, several prefixes of one mount and spaces at the ends included."""
    routes = spark.createDataFrame([("r", "c", "GET", p) for p in ("", "/", "x", "/x /", "//y//", "/z/ ")], "repo string, rel string, method string, path string")
    mounts = spark.createDataFrame([("r", "b", "/m/", "c"), ("r", "b", "/m", "c"), ("r", "b", "n /", "c"), ("r", "a", "", "b"), ("r", "top", "/", "a"), ("r", "c", "/q", "top")], "repo string, rel string, prefix string, child string")
    walk, step = set(), {("c", p) for p in ("", "/", "x", "/x /", "//y//", "/z/ ")}
    for parent, prefixes in (("b", ("/m/", "/m", "n /")), ("a", ("",)), ("top", ("/",))):
        pairs = spark.createDataFrame([(a, p) for a in prefixes for _, p in step], "a string, p string")
        step = {(parent, r[0]) for r in pairs.select(join_route(F.col("a"), F.col("p"))).collect()}
        walk |= {p for _, p in step}
    rows = mounted_routes(routes, mounts).collect()
    assert {r.path for r in rows} == walk and len(rows) == len(walk)
    one = mounted_routes(routes, mounts.filter("prefix NOT IN ('/m', 'n /')")).collect()
    assert len(one) == len(set(one)) and {r.path for r in one} <= walk


def test_mounts_are_worked_out_once(spark):
    from pyspark.sql.types import StringType

    seen = spark.sparkContext.accumulator(0)

    @F.udf(StringType())
    def counted(x):
        seen.add(1)
        return x

    mounts = spark.range(1, 20).select(F.lit("r").alias("repo"), F.expr("concat('f', id + 1)").alias("rel"), F.lit("/m").alias("prefix"), counted(F.expr("concat('f', id)")).alias("child"))
    routes = spark.createDataFrame([("r", "f1", "GET", "/x")], "repo string, rel string, method string, path string")
    assert mounted_routes(routes, mounts).count() == 19 and seen.value < 2 * 20
