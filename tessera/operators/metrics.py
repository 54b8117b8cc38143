"""Time series of small records, change detection, and their verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import micros, pct_delta
from .corpus import TEST_PATH


def baseline_asof(checks: DataFrame, baselines: DataFrame) -> DataFrame:
    """checks(subject, ts, ...) with the latest baseline(subject, ts, value) at or before each: one union and one window, no range join."""
    names = [c for c in checks.columns if c not in ("subject", "ts")]
    marks = baselines.select("subject", "ts", F.col("value").alias("baseline"), F.lit(0).alias("_kind"), *(F.lit(None).cast(checks.schema[c].dataType).alias(c) for c in names))
    rows = checks.select("subject", "ts", F.lit(None).cast(baselines.schema["value"].dataType).alias("baseline"), F.lit(1).alias("_kind"), *names).unionByName(marks)
    before = Window.partitionBy("subject").orderBy("ts", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("baseline", F.last("baseline", True).over(before)).filter("_kind = 1").drop("_kind")


def work_sessions(commits: DataFrame, gap_s: int = 2700) -> DataFrame:
    """commits(author, ts, sha) to sessions; a gap above gap_s starts a new one."""
    w = Window.partitionBy("author").orderBy("ts", "sha")
    gap = micros(F.col("ts")) - F.lag(micros(F.col("ts"))).over(w) > gap_s * 1_000_000
    numbered = commits.withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("author", "session").agg(F.count("*").alias("commits"), F.min("ts").cast("string").alias("first"), ((F.max(micros(F.col("ts"))) - F.min(micros(F.col("ts")))) / 60_000_000.0).alias("minutes"))


def period_over_period(commits: DataFrame, as_of: str, days: int) -> DataFrame:
    """Per author: commits of the last days, of as many days before, their difference and its direction."""
    end = F.lit(as_of).cast("timestamp_ntz")
    age = (micros(end) - micros(F.col("ts"))) / 86_400_000_000
    out = commits.groupBy("author").agg(F.count_if((age >= 0) & (age < days)).alias("now"), F.count_if((age >= days) & (age < 2 * days)).alias("before")).withColumn("delta", F.col("now") - F.col("before"))
    return out.withColumn("arrow", F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").otherwise("flat"))


def commit_stats(commits: DataFrame) -> DataFrame:
    """Per author: totals by message prefix."""
    has = lambda p: F.count_if(F.col("message").rlike(p))
    return commits.groupBy("author").agg(F.count("*").alias("n"), has("^feat").alias("feat"), has("^fix").alias("fix"), has("^(?:feat|fix)").alias("_f")).select("author", "n", "feat", "fix", (F.col("n") - F.col("_f")).alias("other"))


def commit_totals(commits: DataFrame) -> DataFrame:
    """commits(author, message, paths) per author, and of all as author ``(all)``: totals by message prefix, and commits that touch a test."""
    has = lambda p: F.count_if(F.col("message").rlike(p))
    tests = F.count_if(F.exists("paths", lambda p: F.concat(F.lit("/"), p).rlike(TEST_PATH) | p.rlike(r"(^|/)test_[^/]*$|_test\.[^/]*$")))
    out = commits.withColumn("author", F.col("author").cast("string")).rollup("author").agg(F.count("*").alias("n"), has("^feat").alias("feat"), has("^fix").alias("fix"), tests.alias("with_tests"))
    return out.withColumn("author", F.coalesce("author", F.lit("(all)"))).withColumn("other", F.col("n") - F.col("feat") - F.col("fix"))


WEIGHTS = {"type": 25, "lint": 20, "tests": 30, "dead_code": 15, "shell": 10}


def quality_score(checks: DataFrame) -> DataFrame:
    """checks(subject, check, errors, passed, total) to a weighted score of ten, weights renormalised over the checks that ran, and its tier."""
    e = F.col("errors")
    by_errors = F.when(e == 0, 10.0).when(e <= 2, 8.0).when(e <= 5, 6.0).when(e <= 10, 4.0).when(e <= 20, 2.0).otherwise(0.0)
    raw = F.when((F.col("check") == "tests") & (F.col("total") > 0), F.col("passed") * 10.0 / F.col("total")).when(e.isNotNull(), by_errors)
    weight = F.try_element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), F.col("check"))
    rows = checks.withColumn("raw", raw).withColumn("w", weight).filter("raw IS NOT NULL AND w IS NOT NULL")
    out = rows.groupBy("subject").agg((F.sum(F.col("raw") * F.col("w")) / F.sum("w")).alias("score"))
    return out.withColumn("tier", F.when(F.col("score") >= 8, "GREEN").when(F.col("score") >= 6, "YELLOW").otherwise("RED"))


def trend_last_n(history: DataFrame, n: int = 5) -> DataFrame:
    """The last n scores of each subject with the change from the one before."""
    w = Window.partitionBy("subject").orderBy("ts", "id")
    rows = history.withColumn("change", F.col("score") - F.lag("score").over(w))
    back = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("ts"), F.desc("id")))
    return rows.withColumn("back", back).filter(F.col("back") <= n).select("subject", "back", "score", "change")


def canary_verdict(checks: DataFrame) -> DataFrame:
    """checks(subject, seq, code, base_code, ms, base_ms): verdict over each check and the two before it."""
    bad = (F.col("code") != F.col("base_code")) | (F.col("ms") > 2 * F.col("base_ms"))
    n = F.sum(bad.cast("int")).over(Window.partitionBy("subject").orderBy("seq").rowsBetween(-2, 0))
    return checks.select("subject", "seq", n.alias("anomalies"), F.when(n >= 2, "ALERT").when(n == 1, "WARNING").otherwise("STABLE").alias("verdict"))


def attempt_cap(attempts: DataFrame, cap: int = 3) -> DataFrame:
    """attempts(failure, seq, fix, ok): number of the attempt, whether its fix was tried before, and BLOCKED from the cap's failing attempt on."""
    w = Window.partitionBy("failure").orderBy("seq")
    tried = F.array_contains(F.collect_set("fix").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("fix"))
    failing = F.sum((~F.col("ok")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return attempts.select("failure", "seq", F.row_number().over(w).alias("attempt"), F.coalesce(tried, F.lit(False)).alias("repeated_fix"), F.when(failing >= cap, "BLOCKED").when(F.col("ok"), "RESOLVED").otherwise("RETRY").alias("state"))


def regression_check(checks: DataFrame) -> DataFrame:
    """checks(id, ttfb, base_ttfb, total, base_total, size, base_size) in seconds and bytes: regressions and changes in percent."""
    worse = lambda now, base, factor, limit: (F.col(now) > factor * F.col(base)) | (F.col(now) > limit)
    bad = F.array_compact(F.array(F.when(worse("ttfb", "base_ttfb", 1.5, 0.5), F.lit("ttfb")), F.when(worse("total", "base_total", 1.5, 2.0), F.lit("total")), F.when((F.col("base_size") > 0) & (F.col("size") > 1.25 * F.col("base_size")), F.lit("size"))))
    return checks.select("id", F.array_join(bad, ",").alias("regressions"), F.when(F.size(bad) > 0, "FAIL").otherwise("PASS").alias("verdict"), pct_delta(F.col("total"), F.col("base_total")).alias("total_pct"), pct_delta(F.col("ttfb"), F.col("base_ttfb")).alias("ttfb_pct"), pct_delta(F.col("size"), F.col("base_size")).alias("size_pct"))


def coverage_matrix(scenarios: DataFrame) -> DataFrame:
    """scenarios(area, type): counts of every area and type with totals as ``(all)``; empty cells count zero."""
    seen = scenarios.cube("area", "type").agg(F.count("*").alias("n")).select(F.coalesce("area", F.lit("(all)")).alias("area"), F.coalesce("type", F.lit("(all)")).alias("type"), "n")
    areas, types = seen.select("area").distinct(), seen.select("type").distinct()
    cells = areas.crossJoin(F.broadcast(types))  # names of areas and test types
    return cells.join(seen, ["area", "type"], "left").select("area", "type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def test_case_audit(cases: DataFrame) -> DataFrame:
    """cases(id, priority, source, steps) to problems, counted by kind."""
    n = F.count("*").over(Window.partitionBy("id"))
    bad = F.array_compact(F.array(F.when(F.col("_n") > 1, F.lit("duplicate id")), F.when(~F.col("id").rlike(r"^TC-[0-9]{3,}$"), F.lit("id pattern")), F.when(~F.col("priority").isin("P0", "P1", "P2"), F.lit("priority value")), F.when(F.coalesce(F.trim("steps"), F.lit("")) == "", F.lit("missing steps"))))
    return cases.withColumn("_n", n).select("source", F.explode(bad).alias("problem")).groupBy("source", "problem").agg(F.count("*").alias("n"))


test_case_audit.__test__ = False


def phase_timings(runs: DataFrame) -> DataFrame:
    """runs(run_id, timings map) to a row per phase with its share."""
    rows = runs.select("run_id", F.explode("timings").alias("phase", "ms"))
    return rows.withColumn("share", F.round(F.col("ms") / F.sum("ms").over(Window.partitionBy("run_id")), 6))


def bench_gates(runs: DataFrame) -> DataFrame:
    """runs(suite, mode, ms, ok): whether all ran well, and no change and small changes beat a full run."""
    at = lambda m: F.max(F.when(F.col("mode") == m, F.col("ms")))
    out = runs.groupBy("suite").agg(F.min("ok").alias("all_ok"), at("full").alias("f"), at("nochange").alias("n"), at("small").alias("s"))
    return out.select("suite", "all_ok", (F.col("n") < F.col("f")).alias("nochange_faster"), (F.col("s") < F.col("f")).alias("small_faster"), (F.col("n") <= F.col("s")).alias("nochange_least"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new(repo, rel, sha): what changed. Only digests move."""
    o = old.select("repo", "rel", F.col("sha").alias("_sha"))
    change = F.when(F.col("_sha").isNull(), "added").when(F.col("sha").isNull(), "deleted").when(F.col("sha") != F.col("_sha"), "modified")
    return new.join(o, ["repo", "rel"], "full").select("repo", "rel", change.alias("change")).filter("change IS NOT NULL")


def scan_modes(old: DataFrame, new: DataFrame) -> DataFrame:
    """How each repository is to be scanned: in full without an earlier snapshot, not at all without change."""
    changed = snapshot_diff(old, new).groupBy("repo").agg(F.count("*").alias("changed"))
    known = old.select("repo").distinct().withColumn("_old", F.lit(True))
    out = new.select("repo").distinct().join(known, "repo", "left").join(changed, "repo", "left")
    mode = F.when(F.col("_old").isNull(), "full_fallback").when(F.col("changed").isNull(), "skip_no_changes").otherwise("incremental")
    return out.select("repo", mode.alias("mode"))


def change_manifest(diff: DataFrame, cap: int = 50) -> DataFrame:
    """Per repository: number of changes and the first paths in order."""
    w = Window.partitionBy("repo").orderBy("rel")
    n = diff.groupBy("repo").agg(F.count("*").alias("changed"))
    head = diff.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).groupBy("repo").agg(F.array_join(F.array_sort(F.collect_list("rel")), ",").alias("first"))
    return n.join(head, "repo")


def change_profile(diff: DataFrame) -> DataFrame:
    """Per repository: what the changed paths touch, and whether the cross-repository phases must run."""
    low = F.lower("rel")
    code, types = low.rlike(r"\.(ts|tsx|js|jsx|py|go|java|kt|dart)$") | low.rlike("route|controller|api"), low.rlike(r"\.(ts|tsx|js|jsx)$")
    spec, ui = low.rlike(r"(openapi|swagger)[^/]*\.(json|ya?ml)$"), low.rlike(r"\.(html|htm|vue|svelte|tsx|jsx)$")
    out = diff.groupBy("repo").agg(F.count("*").alias("changed_files"), F.max(code).alias("phase5_inputs"), F.max(spec).alias("openapi"), F.max(ui).alias("ui"), F.max(types).alias("types"))
    return out.withColumn("phase5_required", F.col("phase5_inputs") | F.col("openapi") | F.col("types"))


def scan_diff(prev: DataFrame, cur: DataFrame, keys: list[str]) -> DataFrame:
    """Rows new since the previous scan and rows that vanished, by their keys."""
    a, b = prev.select(*keys).distinct(), cur.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("change", F.lit("new")).unionByName(a.join(b, keys, "left_anti").withColumn("change", F.lit("vanished")))


def stale_nodes(existing: DataFrame, expected: DataFrame) -> DataFrame:
    """existing(id, generated) nodes that the inventory no longer backs; hand-written ones stay."""
    return existing.filter("generated").join(expected.select("id").distinct(), "id", "left_anti").select("id")
