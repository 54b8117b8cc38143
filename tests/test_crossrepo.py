"""Joins across repositories on small tables."""

from pyspark.sql import functions as F

from tessera.operators import crossrepo as J
from tessera.plans import crossrepo_queries, registry
from tessera.plans.fixtures import Inputs


def test_templates_meet_paths_by_their_keys(spark):
    urls = ["/v1/a/7", "/v1/a/b", "/v1//a/7/", "/v1/a", "/", "/x/y/z"]
    templates = ["/v1/a/{id}", "/v1/{k}/{id}", "/v1/a/b", "/v1/{id}", "/", "/x/{y/z}", "/{a}/y/{b}"]
    rows = spark.createDataFrame([(u,) for u in urls], "alias string")
    known = spark.createDataFrame([(x,) for x in templates], "template string")
    want = {tuple(r) for r in rows.crossJoin(known).filter(J.template_matches(F.col("alias"), F.col("template"))).collect()}
    assert {tuple(r) for r in J.with_templates(rows, known, bare=True).select("alias", "template").collect()} == want
    assert ("/", "/") in want and ("/", "/") not in {tuple(r) for r in J.with_templates(rows, known).select("alias", "template").collect()}


def test_path_templates_are_not_paired_by_length_alone(spark, sf_dir):
    """The join of URLs and templates has the path in its key, not only its number of segments."""
    plan = registry.queries()["jn2_path_template_match"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert any("_key" in line for line in joins)


def test_urls_of_calls_are_worked_out_once(spark, sf_dir):
    """Joins read the table of URLs, and the role fallback the distinct unmatched calls; neither works the call sites out again."""
    t = Inputs(spark, sf_dir)
    assert crossrepo_queries.calls(t) is crossrepo_queries.calls(t)
    assert "event_id" not in crossrepo_queries.unmatched(t)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("/calls-" in f for f in crossrepo_queries.roles_of(t)[0].inputFiles())
