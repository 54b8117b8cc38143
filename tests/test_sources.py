"""Readers and sinks on small files."""

from pyspark.sql import types as T

from tessera.sources.readers import front_matter, parse_tagged, read_corpus, read_jsonl, read_steps, read_tsv, to_lines, write_edge_store


def test_read_corpus(spark, tmp_path):
    for rel, text in {"src/a.ts": "one\ntwo\n", "node_modules/x.js": "no", "src/dist/b.js": "no", "b.py": "x"}.items():
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(text)
    (tmp_path / "src/blob.bin").write_bytes(b"ok \xff\xfe\n\n\n")
    files = read_corpus(spark, {"web": str(tmp_path)})
    odd = files.filter("rel = 'src/blob.bin'")
    assert [(r.lineno, r.content) for r in to_lines(odd).orderBy("lineno").collect()] == [(1, "ok \ufffd\ufffd"), (2, ""), (3, "")]
    files = files.filter("rel <> 'src/blob.bin'")
    assert sorted((r.repo, r.rel, r.bytes) for r in files.collect()) == [("web", "b.py", 1), ("web", "src/a.ts", 8)]
    assert [(r.lineno, r.content) for r in to_lines(files).filter("rel <> 'b.py'").orderBy("lineno").collect()] == [(1, "one"), (2, "two")]


def test_read_tsv(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("# note\nx\ty\n\nshort\nu\tv\tw\n")
    rows = read_tsv(spark, str(tmp_path / "a.tsv"), ["a", "b", "c"], 2).collect()
    assert sorted((tuple(r) for r in rows), key=str) == [("u", "v", "w"), ("x", "y", None)]


def test_read_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "s": "a"}\n{bad\n{"id": 2}\n')
    good, bad = read_jsonl(spark, str(tmp_path / "a.jsonl"), T.StructType([T.StructField("id", T.LongType()), T.StructField("s", T.StringType())]))
    assert sorted((r.id, r.s) for r in good.collect()) == [(1, "a"), (2, None)]
    assert [r.raw for r in bad.collect()] == ["{bad"]


def test_read_steps(spark):
    df = spark.createDataFrame([("t", "a", "API", "x", "b; c", 1), ("t", " ", None, "", None, 2), ("t", "", "web", "y", "", 3), ("t", "d", "fax", "y", "", 4)], "task_id string, ID string, Surface string, `In tent` string, `depends-on` string, row_no int")
    steps, errors = read_steps(df)
    assert [(r.id, r.surface, r.depends_on) for r in steps.collect()] == [("a", "api", ["b", "c"])]
    assert sorted((r.row_no, r.reason) for r in errors.collect()) == [(3, "empty id"), (4, "unknown surface")]


def test_parse_tagged_rejects_null(spark):
    records, rejects = parse_tagged(spark.createDataFrame([("r\ta/b:3:x:y",), (None,), ("bad",)], "raw string"))
    assert [tuple(r) for r in records.collect()] == [("r", "a/b", 3, "x:y")] and rejects.count() == 2


def test_edge_store(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "m", "p1", 1), ("a", "m", "p2", 2), ("", "m", "p", 3)], "id string, type string, path string, seq int")
    edges = spark.createDataFrame([("a", "b", "calls"), ("", "b", "calls"), ("a", None, "x")], "source string, target string, kind string")
    write_edge_store(nodes, edges, str(tmp_path / "store"))
    assert [(r.id, r.path) for r in spark.read.parquet(str(tmp_path / "store/nodes")).collect()] == [("a", "p2")]
    assert spark.read.parquet(str(tmp_path / "store/edges")).count() == 1
    assert spark.read.text(str(tmp_path / "store/edges_tsv")).first()[0] == "a\tcalls\tb"


def test_roots_with_odd_names(spark, tmp_path):
    for name in ("a+b (1)", "a"):
        (tmp_path / name / "in").mkdir(parents=True)
        (tmp_path / name / "in" / "x.py").write_text(name)
    roots = {"one": str(tmp_path / "a+b (1)") + "/", "two": "file://" + str(tmp_path / "a"), "inner": str(tmp_path / "a" / "in")}
    files = read_corpus(spark, roots, {"one": "backend"})
    assert sorted((r.repo, r.role, r.rel, r.content) for r in files.collect()) == [("inner", None, "x.py", "a"), ("one", "backend", "in/x.py", "a+b (1)"), ("two", None, "in/x.py", "a")]


def test_front_matter_repeats(spark):
    text = "---\nstatus: old\nowner: me\nstatus: new\ntags: [a, b]\n---\nbody"
    rows = front_matter(spark.createDataFrame([(1, text), (2, "no block"), (3, None)], "doc_id int, content string")).collect()
    got = {r.doc_id: r.fields for r in rows}
    assert got[1] == {"status": "new", "owner": "me"} and got[2] == {} and not got[3]


def test_lines_end(spark):
    rows = [("r", "a", "x\n\n"), ("r", "b", "x\r\n\r\n\r\n"), ("r", "c", "\n"), ("r", "d", "x"), ("r", "e", "")]
    lines = to_lines(spark.createDataFrame(rows, "repo string, rel string, content string")).collect()
    got = {}
    for r in sorted(lines, key=lambda r: (r.rel, r.lineno)):
        got.setdefault(r.rel, []).append(r.content)
    assert got == {"a": ["x", ""], "b": ["x", "", ""], "c": [""], "d": ["x"]}
