"""Decision records: ranking, tags, copies, life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score(status: Column, product: Column, days_old: Column, wanted: str | None) -> Column:
    """Additive score: status, product match, age; very old ones but patterns count half (whole), archived ones lose 100."""
    base = F.when(status == "pattern", 50).when(status == "resolved", 30).when(status == "open", 10).when(status == "experimental", 5).otherwise(0)
    base = base + F.when(product == wanted, 45).otherwise(0) if wanted else base
    base = base + F.when(days_old < 30, 20).when(days_old < 90, 15).when(days_old < 365, 10).otherwise(0)
    halved = F.when((days_old > 730) & (status != "pattern"), F.expr("0") + F.floor(base / 2)).otherwise(base)
    return (halved - F.when(status.isin("archived", "deprecated"), 100).otherwise(0)).cast("long")


def rank_decisions(decisions: DataFrame, wanted: str, as_of: str) -> DataFrame:
    """decisions(id, status, product, created) scored as of a date, best first, newer first among equals."""
    days = F.datediff(F.lit(as_of).cast("date"), F.col("created"))
    return decisions.withColumn("score", score(F.col("status"), F.col("product"), days, wanted)).orderBy(F.desc("score"), F.desc("created"), "id")


def tag_filter(decisions: DataFrame, every: list[str] = (), some: list[str] = (), none: list[str] = (), archived: bool = False) -> DataFrame:
    """decisions(id, status, tags) by tag algebra; archived ones only on request."""
    lit = lambda xs: F.array(*map(F.lit, xs))
    ok = F.lit(True)
    ok = ok & (F.size(F.array_intersect("tags", lit(every))) == len(set(every))) if every else ok
    ok = ok & F.arrays_overlap("tags", lit(some)) if some else ok
    ok = ok & ~F.arrays_overlap("tags", lit(none)) if none else ok
    return decisions.filter(ok if archived else ok & (F.lower("status") != "archived"))


def _by_head(decisions: DataFrame, lines: int) -> DataFrame:
    head = F.sha2(F.array_join(F.slice(F.split("content", "\n"), 1, lines), "\n"), 256)
    return decisions.select("id", head.alias("hash"))


def primary_results(decisions: DataFrame, lines: int = 10) -> DataFrame:
    """decisions(id, content) to (id, primary_id): of equal first lines the smallest id is primary. One row per decision, however many are equal."""
    keyed = _by_head(decisions, lines)
    return keyed.join(keyed.groupBy("hash").agg(F.min("id").alias("primary_id")), "hash").select("id", "primary_id")


def dedup_results(decisions: DataFrame, lines: int = 10) -> DataFrame:
    """decisions(id, content): of equal first lines the smallest id is primary, the others are listed with it, in one row; see primary_results for groups
    too large for that."""
    keyed = _by_head(decisions, lines)
    others = keyed.groupBy("hash").agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("ids"))
    return others.select("id", F.array_join(F.transform(F.slice("ids", 2, 1 << 30), lambda x: x.cast("string")), ",").alias("also_in"))


def paginate(df: DataFrame, order: list[Column], size: int, page: int) -> DataFrame:
    """One page, from 1. What lies before it is cut by offset; only the leading rows are sorted for it."""
    return df.orderBy(*order).offset(size * (page - 1)).limit(size)


def tag_index(decisions: DataFrame) -> DataFrame:
    """decisions(id, tags, product, domain) to each tag's count, products and domains."""
    rows = decisions.select("id", "product", "domain", F.explode("tags").alias("tag"))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return rows.groupBy("tag").agg(F.countDistinct("id").alias("n"), names("product").alias("products"), names("domain").alias("domains"))


def decision_counts(decisions: DataFrame) -> DataFrame:
    """Counts by tag, by product, by status and by quarter, as grouping sets."""
    quarter = F.concat(F.year("created").cast("string"), F.lit("Q"), F.quarter("created").cast("string"))
    rows = decisions.select("tag", "product", "status", quarter.alias("quarter"))
    dims = ["tag", "product", "status", "quarter"]
    out = rows.groupingSets([[d] for d in dims], *dims).agg(F.count("*").alias("n"))
    return out.select(*dims, "n")


def lifecycle_dashboard(decisions: DataFrame, links: DataFrame, as_of: str) -> DataFrame:
    """Per status: decisions, mean age in days, without dependents, stale for 18 months, depended on by 100 or more."""
    day = F.lit(as_of).cast("date")
    deps = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("dependents"))
    rows = decisions.join(deps, "id", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)))
    stale = F.col("created") < F.add_months(day, -18)
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.avg(F.datediff(day, "created")).alias("mean_days"), F.count_if(F.col("dependents") == 0).alias("no_dependents"), F.count_if(stale).alias("stale"), F.count_if(F.col("dependents") >= 100).alias("red_flags"))


def demote(decisions: DataFrame, as_of: str) -> DataFrame:
    """One step of ageing: Active after 6 months, Warm after 3, Cold after 12 unless evergreen; with what changed and who hears of it.

    decisions(id, status, since, evergreen)."""
    day = F.lit(as_of).cast("date")
    older = lambda months: F.add_months("since", months) < day
    new = F.when((F.col("status") == "Active") & older(6), "Warm").when((F.col("status") == "Warm") & older(3), "Cold").when((F.col("status") == "Cold") & older(12) & ~F.col("evergreen"), "Archived")
    notice = F.when(F.col("new") == "Warm", "team: informational").when(F.col("new") == "Cold", "team: review").when(F.col("new") == "Archived", "audit: archived")
    out = decisions.withColumn("new", new)
    return out.select("id", F.coalesce("new", "status").alias("status"), F.when(F.col("new").isNotNull(), day).otherwise(F.col("since")).alias("since"), F.when(F.col("new").isNotNull(), "age").alias("reason"), notice.alias("notice"))


def archive_candidates(decisions: DataFrame, links: DataFrame, as_of: str) -> DataFrame:
    """Cold decisions of a year or more that are not evergreen: age, dependents, last reference (largest referring id)."""
    day = F.lit(as_of).cast("date")
    deps = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("dependents"), F.max("dst").alias("last_reference"))
    old = decisions.filter((F.col("status") == "Cold") & ~F.col("evergreen") & (F.add_months("created", 12) <= day))
    return old.join(deps, "id", "left").select("id", F.datediff(day, "created").cast("long").alias("age_days"), F.coalesce("dependents", F.lit(0)).cast("long").alias("dependents"), "last_reference")


def promote_patterns(observations: DataFrame) -> DataFrame:
    """observations(pattern, product): seen once is warm, twice in one product active, in three products a skill candidate."""
    out = observations.groupBy("pattern").agg(F.count("*").alias("n"), F.countDistinct("product").alias("products"))
    return out.withColumn("state", F.when(F.col("products") >= 3, "skill_candidate").when(F.col("n") >= 2, "active").otherwise("warm"))
