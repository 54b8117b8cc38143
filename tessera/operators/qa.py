"""Test evidence: steps, verdicts, logs, gates, ledgers; and checks of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import safe_relpath
from .cycles import strong_components


def missing_dependencies(steps: DataFrame) -> DataFrame:
    """steps(task_id, id, depends_on list) to dependencies that the task lacks."""
    wanted = steps.select("task_id", "id", F.explode("depends_on").alias("dependency"))
    return wanted.join(steps.select("task_id", F.col("id").alias("dependency")).distinct(), ["task_id", "dependency"], "left_anti").select("task_id", "id", "dependency")


def validate_steps(steps: DataFrame, surfaces: list[str]) -> DataFrame:
    """Errors of steps: empty fields, unknown surface, repeated id, unknown dependency, a dependency cycle (for each step on it); and of a task without
    a step that has an id, with a null id: no steps."""
    n = F.count("*").over(Window.partitionBy("task_id", "id"))
    errors = F.array_compact(F.array(F.when(F.col("id") == "", F.lit("empty id")), F.when(F.trim("intent") == "", F.lit("empty intent")), F.when(~F.lower("surface").isin(*surfaces), F.lit("unknown surface")), F.when(F.col("n") > 1, F.lit("duplicate id"))))
    rows = steps.filter("id IS NOT NULL").withColumn("n", n).select("task_id", "id", F.explode(errors).alias("error"))
    none = steps.groupBy("task_id").agg(F.count("id").alias("n")).filter("n = 0").select("task_id", F.lit(None).cast("string").alias("id"), F.lit("no steps").alias("error"))
    missing = missing_dependencies(steps).select("task_id", "id", F.lit("unknown dependency").alias("error"))
    edges = steps.select("task_id", F.explode("depends_on").alias("src"), F.col("id").alias("dst"))
    known = steps.select("task_id", F.col("id").alias("src")).distinct()
    cycles = strong_components(edges.join(known, ["task_id", "src"], "left_semi"), ["task_id"]).select("task_id", F.col("node").alias("id"), F.lit("dependency cycle").alias("error"))
    return rows.unionByName(none).unionByName(missing).unionByName(cycles)


def eval_manifest(results: DataFrame, dry_run: bool = False) -> DataFrame:
    """Per run: steps and outcome; a dry run is yellow at best."""
    out = results.groupBy("run_id").agg(F.count("*").alias("step_count"), F.count_if(F.col("status") == "FAIL").alias("failed"))
    return out.select("run_id", "step_count", F.when(F.col("failed") > 0, "red").otherwise("yellow" if dry_run else "green").alias("outcome"))


def validate_scenarios(scenarios: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """scenarios(label, scenario, steps of id, driver, action, expected map) to errors."""
    none = scenarios.filter(F.coalesce(F.trim("scenario"), F.lit("")) == "").select("label", F.lit("").alias("id"), F.lit("missing scenario").alias("error"))
    empty = scenarios.filter(F.coalesce(F.size("steps"), F.lit(0)) <= 0).select("label", F.lit("").alias("id"), F.lit("no steps").alias("error"))
    steps = scenarios.select("label", F.explode("steps").alias("s")).select("label", "s.*").withColumn("n", F.count("*").over(Window.partitionBy("label", "id")))
    known = reduce(lambda a, b: a | b, ((F.col("driver") == d) & (F.col("action") == a) for d, a in pairs))
    errors = F.array_compact(F.array(F.when(~F.col("id").rlike(r"^[a-z][a-z0-9_-]*$"), F.lit("bad step id")), F.when(F.col("n") > 1, F.lit("duplicate step id")), F.when(~known, F.lit("driver and action do not pair")), F.when(F.coalesce(F.size("expected"), F.lit(0)) <= 0, F.lit("empty expected"))))
    return none.unionByName(empty).unionByName(steps.select("label", "id", F.explode(errors).alias("error")))


def classify_steps(results: DataFrame) -> DataFrame:
    s = F.col("status")
    kind = F.when(s == "PASS", "STEP_PASS").when((s == "FAIL") & F.col("critical"), "STEP_FAIL_CRITICAL").when(s == "FAIL", "STEP_FAIL_NON_CRITICAL").when(s == "SKIP", "STEP_SKIPPED").otherwise("STEP_ERROR")
    return results.withColumn("classification", kind)


def halt_on_stop(results: DataFrame) -> DataFrame:
    """After a failing step with failure mode ``stop`` later steps of its scenario are skipped."""
    before = Window.partitionBy("run_id", "scenario").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.max((F.col("status") == "FAIL") & (F.col("failure_mode") == "stop")).over(before)
    return results.withColumn("status", F.when(F.coalesce(stopped, F.lit(False)), "SKIP").otherwise(F.col("status")))


def verdict(results: DataFrame) -> DataFrame:
    """results with retry_count and retry_history to a verdict per run, by rules in order."""
    c = classify_steps(results)
    is_ = lambda k: F.count_if(F.col("classification") == k)
    mixed = (F.col("retry_count") >= 3) & F.array_contains("retry_history", "PASS") & F.array_contains("retry_history", "FAIL")
    agg = c.groupBy("run_id").agg(F.count("*").alias("n"), is_("STEP_ERROR").alias("errors"), is_("STEP_FAIL_CRITICAL").alias("critical"), F.count_if(mixed).alias("flaky"), is_("STEP_FAIL_NON_CRITICAL").alias("minor"), is_("STEP_SKIPPED").alias("skipped"), is_("STEP_PASS").alias("passed"))
    reason = F.when(F.col("errors") > 0, "FAIL_ERROR").when(F.col("critical") > 0, "FAIL_CRITICAL").when(F.col("flaky") > 0, "FAIL_FLAKY").when(F.col("minor") > 0, "PARTIAL_PASS_NON_CRITICAL").when(F.col("skipped") == F.col("n"), "NO_EXECUTION").otherwise("ALL_PASS")
    color = F.when(F.col("reason") == "ALL_PASS", "GREEN").when(F.col("reason") == "PARTIAL_PASS_NON_CRITICAL", "YELLOW").otherwise("RED")
    return agg.withColumn("reason", reason).select("run_id", "reason", color.alias("verdict"), F.col("n").alias("step_count"), "passed", "skipped")


def confidence(results: DataFrame) -> DataFrame:
    """Confidence of failing steps from their error text and timing; low ones are signals only."""
    e = F.coalesce("error", F.lit(""))
    tier = F.when(e.rlike(r"\b[345][0-9]{2}\b"), "HIGH").when(e.rlike("expected .* got "), "HIGH").when(e.rlike(r"(?i)traceback|stack trace|\n\s+at "), "HIGH")
    tier = tier.when(F.col("sla_ms").isNotNull() & (F.col("duration_ms") > F.col("sla_ms")), "HIGH").when(e.rlike("(?i)timeout|refused"), "MODERATE").when(F.col("retry_count") > 0, "MODERATE").otherwise("LOW")
    return results.filter("status = 'FAIL'").withColumn("confidence", tier).withColumn("signal_only", F.col("confidence") == "LOW")


def sla_breaches(results: DataFrame) -> DataFrame:
    return results.filter(F.col("duration_ms") > F.col("sla_ms"))


def timing_report(results: DataFrame) -> DataFrame:
    """Total and 95th percentile of step times per scenario."""
    return results.groupBy("scenario").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.percentile("duration_ms", F.lit(0.95)).alias("p95_ms"))


TRIAGE = [
    ("flaky", r"(?i)timeout|deadline|race|async"),
    ("bad_test", r"(?i)AssertionError|expected to be|should have"),
    ("real_bug", r"(?i)NullPointer|TypeError|ReferenceError|exception|crashed"),
    ("environment", r"(?i)ECONNREFUSED|ENOTFOUND|refused|unavailable"),
]


def triage(failures: DataFrame) -> DataFrame:
    """failures(id, message) to the first family that its text matches, and how sure: several families conflict."""
    hits = [F.col("message").rlike(p) for _, p in TRIAGE]
    kind = reduce(lambda a, x: a.when(x[0], x[1]), zip(hits[1:], [k for k, _ in TRIAGE[1:]]), F.when(hits[0], TRIAGE[0][0])).otherwise("uncertain")
    n = reduce(lambda a, b: a + b, (h.cast("int") for h in hits))
    return failures.select("id", kind.alias("kind"), F.when(n == 1, "high").when(n > 1, "medium").otherwise("low").alias("confidence"))


def locate_fault(results: DataFrame) -> DataFrame:
    """First failing step of each run and scenario, with the service its HTTP code points to."""
    code = F.regexp_extract("error", r"\b([345][0-9]{2})\b", 1)
    service = F.when(code.isin("502", "503", "504"), "gateway").when(code.startswith("5"), "backend").when(code.isin("401", "403"), "auth").when(code == "404", "routing").when(code.startswith("4"), "client").otherwise("unknown")
    return results.filter("status = 'FAIL'").groupBy("run_id", "scenario").agg(F.min_by(F.struct("step", service.alias("service")), "step").alias("f")).select("run_id", "scenario", "f.step", "f.service")


def _first(pattern: str) -> Column:
    return F.min(F.when(F.col("text").rlike(pattern), F.col("line_no")))


def marker_order(log: DataFrame) -> DataFrame:
    """log(task_id, line_no, text) to breaches of the order of each task's first markers."""
    first = log.groupBy("task_id").agg(_first(r"^\[P4\.1-DISPATCH\]").alias("dispatch"), _first(r"^\[P4\.0-EVAL-YAML\]").alias("evidence"), _first(r"^\[P4\.0-QA-CSV\] approved=yes").alias("qa"), _first(r"^\[P4\.0-TDD-RED\]").alias("tdd"))
    rules = [("dispatch before evidence", "dispatch", "evidence"), ("evidence before QA approval", "evidence", "qa"), ("dispatch before TDD", "dispatch", "tdd")]
    bad = F.array_compact(F.array(*(F.when(F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) < F.col(b))), F.lit(text)) for text, a, b in rules)))
    return first.select("task_id", F.explode(bad).alias("violation"))


def untimed_markers(log: DataFrame) -> DataFrame:
    """Marker lines without a leading ISO-8601 time, per task."""
    marked = F.col("text").rlike(r"\[P\d") & ~F.col("text").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}")
    return log.groupBy("task_id").agg(F.count_if(marked).alias("untimed"))


def latest_state(log: DataFrame, marker: str = "TERMINOLOGY", key: str = "open_doubts") -> DataFrame:
    """The value of the key in each task's last line of the marker; quotes are dropped."""
    value = F.regexp_replace(F.regexp_extract("text", rf"{key}=(\"[^\"]*\"|\S+)", 1), '"', "")
    return log.filter(F.col("text").rlike(rf"^\[{marker}\]")).groupBy("task_id").agg(F.max_by(value, "line_no").alias("value"))


GATES = [("eval", r"^\[P4\.0-EVAL-YAML\]|^\[P4\.0-SEMANTIC\]"), ("qa", r"^\[P4\.0-QA-CSV\] approved=yes"), ("tdd", r"^\[P4\.0-TDD-RED\]"), ("dispatch", r"^\[P4\.1-DISPATCH\]")]


def missing_gates(log: DataFrame) -> DataFrame:
    """The first required gate that each task lacks, and how many it lacks."""
    have = log.groupBy("task_id").agg(*(F.max(F.col("text").rlike(p)).alias(g) for g, p in GATES))
    lacking = F.array_compact(F.array(*(F.when(~F.col(g), F.lit(g)) for g, _ in GATES)))
    return have.select("task_id", F.get(lacking, F.lit(0)).alias("next_gate"), F.size(lacking).cast("long").alias("missing"))


def gate_ledger_errors(log: DataFrame) -> DataFrame:
    """Satisfied gates that lack what they stand on."""
    kind = F.when(F.lit(False), "")
    for g, p in GATES:
        kind = kind.when(F.col("text").rlike(p), g)
    gates = log.select("task_id", kind.alias("gate")).filter("gate IS NOT NULL").groupBy("task_id").agg(F.collect_set("gate").alias("g"))
    has = lambda x: F.array_contains("g", x)
    bad = F.array_compact(F.array(F.when(has("dispatch") & ~has("eval"), F.lit("dispatch without evidence")), F.when(has("eval") & ~has("qa"), F.lit("evidence without QA")), F.when(has("dispatch") & ~has("tdd"), F.lit("dispatch without TDD"))))
    return gates.select("task_id", F.explode(bad).alias("error"))


def ledger_verify(ledger: DataFrame, artifacts: DataFrame) -> DataFrame:
    """ledger(task_id, marker, artifacts of relpath, sha256) against artifacts(task_id, relpath, content): errors per entry. Content is hashed before
    the join, so only digests move."""
    rows = ledger.select("task_id", "marker", F.explode_outer("artifacts").alias("a")).select("task_id", "marker", "a.relpath", "a.sha256")
    have = artifacts.select("task_id", "relpath", F.sha2("content", 256).alias("actual"))
    error = F.when(F.col("relpath").isNull(), "no artifacts").when(~safe_relpath(F.col("relpath")), "unsafe path").when(F.col("actual").isNull(), "missing file").when(F.col("actual") != F.col("sha256"), "hash mismatch")
    return rows.join(have, ["task_id", "relpath"], "left").select("task_id", "marker", "relpath", error.alias("error")).filter("error IS NOT NULL")


def drift_check(prd: DataFrame, evidence: DataFrame, min_chars: int = 12) -> DataFrame:
    """Success criteria (bullets of that section) that a task's evidence text does not hold."""
    section = F.regexp_extract("content", r"(?s)## Success Criteria\n(.*?)(?:\n## |$)", 1)
    bullets = prd.select("task_id", F.explode(F.regexp_extract_all(section, F.lit(r"(?m)^[-*] +(.+)$"), F.lit(1))).alias("criterion")).filter(F.length("criterion") >= min_chars)
    joined = bullets.join(evidence.select("task_id", F.lower("text").alias("_t")), "task_id", "left")
    return joined.filter(F.col("_t").isNull() | ~F.contains(F.col("_t"), F.lower("criterion"))).select("task_id", "criterion")


def assert_table(df: DataFrame, count: int | None = None, min_count: int | None = None, max_count: int | None = None, columns: list[str] | None = None, constant: dict | None = None) -> DataFrame:
    """One row of what was expected of a table and whether it holds, from one aggregate."""
    aggs = [F.count("*").alias("n")] + [F.count_if(~F.col(c).eqNullSafe(F.lit(v))).alias(f"bad_{c}") for c, v in (constant or {}).items()]
    ok = F.lit(columns is None or df.columns == columns)
    for value, test in ((count, lambda v: F.col("n") == v), (min_count, lambda v: F.col("n") >= v), (max_count, lambda v: F.col("n") <= v)):
        ok = ok & test(value) if value is not None else ok
    for c in constant or {}:
        ok = ok & (F.col(f"bad_{c}") == 0)
    return df.agg(*aggs).select(ok.alias("passed"), F.col("n").alias("actual_count"))


def orphan_rows(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def total_mismatch(header: DataFrame, detail: DataFrame, key: str, detail_key: str, total: str, amount: Column, tolerance: float = 0.005) -> DataFrame:
    """Header rows whose total is not the sum of their lines."""
    sums = detail.groupBy(F.col(detail_key).alias(key)).agg(F.sum(amount).alias("lines_total"))
    out = header.select(key, total).join(sums, key, "left").withColumn("lines_total", F.coalesce("lines_total", F.lit(0.0)))
    return out.filter(F.abs(F.col(total) - F.col("lines_total")) > tolerance)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls per column, from one pass."""
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*map(F.col, columns)))).alias("column", "nulls"))


def check_violations(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which a CHECK expression is false (null passes, as in SQL)."""
    return df.filter(~F.expr(expression))


def snapshot_stats(df: DataFrame, key: str, date: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), F.min(date).cast("string").alias("first"), F.max(date).cast("string").alias("last"))


def compare_snapshots(before: DataFrame, after: DataFrame, key: str, date: str) -> DataFrame:
    a, b = snapshot_stats(before, key, date), snapshot_stats(after, key, date)
    names = a.columns
    both = a.select(F.struct(*names).alias("a")).crossJoin(b.select(F.struct(*names).alias("b")))  # one row each
    return both.select(F.explode(F.array(*(F.struct(F.lit(n).alias("what"), F.col(f"a.{n}").cast("string").alias("before"), F.col(f"b.{n}").cast("string").alias("after"), F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")).alias("same")) for n in names))).alias("r")).select("r.*")


def schema_compat(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new(field, type, required): what each field's change means."""
    o, n = old.select("field", F.col("type").alias("t0"), F.col("required").alias("r0")), new.select("field", F.col("type").alias("t1"), F.col("required").alias("r1"))
    change = F.when(F.col("t0").isNull() & F.col("r1"), "major: required field added").when(F.col("t0").isNull(), "minor: optional field added").when(F.col("t1").isNull(), "major: field removed")
    change = change.when(F.col("t0") != F.col("t1"), "major: type changed").when(~F.col("r0") & F.col("r1"), "major: became required").when(F.col("r0") & ~F.col("r1"), "minor: became optional").otherwise("compatible")
    return o.join(n, "field", "full").select("field", change.alias("change"))


def assert_search(hits: DataFrame, min_hits: int, contains_id: int, min_score: float, cardinality: int) -> DataFrame:
    """hits(id, score): the first check that fails, in order; distinct ids are estimated and may be five percent off."""
    one = hits.agg(F.count("*").alias("n"), F.max((F.col("id") == contains_id).cast("int")).alias("found"), F.min("score").alias("low"), F.approx_count_distinct("id", 0.01).alias("distinct"))
    failed = F.when(F.col("n") < min_hits, "hit count").when(F.coalesce("found", F.lit(0)) == 0, "id missing").when(F.col("low") < min_score, "score").when(F.abs(F.col("distinct") - cardinality) > 0.05 * cardinality, "cardinality")
    return one.select(F.coalesce(failed, F.lit("none")).alias("failed"), "n")


def assert_kv(kv: DataFrame, rules: DataFrame) -> DataFrame:
    """rules(key, rule, arg) against kv(key, value, ttl): whether each holds."""
    v, arg = F.col("value"), F.col("arg")
    there = v.isNotNull()
    ok = F.when(F.col("rule") == "exists", there).when(F.col("rule") == "equals", v.eqNullSafe(arg)).when(F.col("rule") == "contains", there & F.contains(v, arg)).when(F.col("rule") == "regex", there & F.regexp_like(v, arg))
    ok = ok.when(F.col("rule") == "number", there & v.rlike(r"^-?[0-9]+(\.[0-9]+)?$")).when(F.col("rule") == "ttl", F.abs(F.col("ttl") - F.expr("try_cast(arg AS double)")) <= 1).when(F.col("rule") == "max_size", F.octet_length(v) <= F.expr("try_cast(arg AS double)"))
    return rules.join(kv, "key", "left").select("key", "rule", "arg", F.coalesce(ok, F.lit(False)).alias("passed"))
