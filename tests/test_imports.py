"""Local imports resolved to files."""

from tessera.operators.facts import resolve_local_imports


def test_spellings_are_tried_once_for_a_path(spark):
    imports = [("r", f"a{i}.ts", "src/x") for i in range(50)] + [("r", "b.ts", "src/y"), ("q", "b.ts", "src/x"), ("r", "b.ts", None), ("r", "b.ts", "src/y"), ("r", "c.ts", "src/z.js"), ("r", "d.ts", "gone")]
    files = [("r", "src/x.ts"), ("r", "src/x/index.js"), ("r", "src/y/index.tsx"), ("q", "src/x.js"), ("r", "src/z.tsx"), ("r", "src/z.js")]
    found = resolve_local_imports(spark.createDataFrame(imports, "repo string, rel string, resolved string"), spark.createDataFrame(files, "repo string, rel string"))
    want = [("r", f"a{i}.ts", "src/x", "src/x.ts") for i in range(50)] + [("r", "b.ts", "src/y", "src/y/index.tsx"), ("q", "b.ts", "src/x", "src/x.js"), ("r", "c.ts", "src/z.js", "src/z.js")]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    tried = next(line for line in plan if "Generate posexplode" in line)
    assert "rel#" not in tried.split("posexplode")[1].split("[rank")[-1]
    assert all("min_by" not in line or "rel#" not in line.split("min_by")[0] for line in plan if "Aggregate" in line)
