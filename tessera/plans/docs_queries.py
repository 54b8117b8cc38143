"""Queries of documentation and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import docs as D
from ..operators.search import search_positions, write_positions
from .registry import register
from .shared import fresh_path

REL = "CASE doc_id % 9 WHEN 0 THEN 'README.md' WHEN 1 THEN 'docs/adr/0001-x.md' WHEN 2 THEN 'docs/guide' || CAST(doc_id AS STRING) || '.md' WHEN 3 THEN 'guides/g.md' WHEN 4 THEN 'rfc/r' || CAST(doc_id AS STRING) || '.md' WHEN 5 THEN 'api/openapi.json' WHEN 6 THEN 'CHANGELOG.md' WHEN 7 THEN 'src/x' || CAST(doc_id AS STRING) || '.txt' ELSE 'secret/s' || CAST(doc_id AS STRING) || '.md' END"
PATHS = f"SELECT doc_id, source AS repo, {REL} AS rel, n_chars AS bytes, text AS content FROM documents"


def paths(t):
    return t.documents.select("doc_id", F.col("source").alias("repo"), F.expr(REL).alias("rel"), F.col("n_chars").alias("bytes"), F.col("text").alias("content"))


def policy(t):
    return t.documents.select(F.col("source").alias("repo")).distinct().filter("repo <> 'src1'").select("repo", F.array(F.lit("secret/")).alias("deny"), F.array(F.lit("CHANGELOG")).alias("index_only"), F.array(F.lit("src/x")).alias("allow_extra"), F.lit(4).alias("max_files"), F.lit(3000).alias("max_bytes"))


ACTION = """SELECT repo, rel, bytes, CASE WHEN repo <> 'src1' AND contains(rel, 'secret/') THEN 'denied' WHEN rel LIKE '%.txt' AND repo = 'src1' THEN 'not_a_document' WHEN bytes > CASE WHEN repo = 'src1' THEN 524288 ELSE 3000 END THEN 'too_large' WHEN repo <> 'src1' AND contains(rel, 'CHANGELOG') THEN 'index_only' ELSE 'mirror' END AS action FROM p"""
register("dc1_select_docs", lambda t: D.select_docs(paths(t), policy(t)), "", f", p AS ({PATHS}) {ACTION}")
register("ag10_skip_reasons", lambda t: D.skip_reasons(D.select_docs(paths(t), policy(t))), "", f", p AS ({PATHS}), a AS ({ACTION}) SELECT action, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM a WHERE action <> 'mirror' GROUP BY action")
register("wn8_cap_per_repo", lambda t: D.cap_per_repo(paths(t).withColumn("rel", F.concat("rel", F.lit("/"), "doc_id")), policy(t), 6), "", f"""
, p AS ({PATHS}), r AS (SELECT repo, rel || '/' || CAST(doc_id AS VARCHAR) AS rel FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN starts_with(lower(rel), 'docs/') THEN 0 WHEN regexp_matches(lower(rel), '(^|/)guides/') THEN 3 WHEN regexp_matches(lower(rel), '(^|/)rfc/') THEN 4 WHEN regexp_matches(lower(rel), 'readme|changelog') THEN 6 ELSE 7 END, rel) AS n FROM r)
SELECT repo, rel, CASE WHEN n <= CASE WHEN repo = 'src1' THEN 6 ELSE 4 END THEN 'kept' ELSE 'per_repo_cap' END AS status FROM o""")
register("dc2_doc_type", lambda t: paths(t).select("doc_id", D.doc_type(F.col("rel"), F.col("content")).alias("doc_type")), "", """
SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'readme' WHEN 1 THEN 'adr' WHEN 2 THEN CASE WHEN regexp_matches(lower(substr(text, 1, 2000)), '\\bstatus\\s*:\\s*(accepted|proposed|deprecated|superseded)\\b') THEN 'adr' WHEN regexp_matches(lower(substr(text, 1, 2000)), '## api|endpoint|request') THEN 'api-reference' ELSE 'guide' END
 WHEN 3 THEN 'guide' WHEN 4 THEN 'rfc' WHEN 5 THEN 'openapi' WHEN 6 THEN 'changelog' ELSE 'doc' END AS doc_type FROM documents""".replace("\\\\", "\\"))
ADR_PATHS = "CASE doc_id % 10 WHEN 0 THEN 'decisions/x.md' WHEN 1 THEN 'a/architecture-decisions/x.md' WHEN 2 THEN '12-x.md' WHEN 3 THEN 'adrs/x.md' WHEN 4 THEN 'a/decision/README.md' WHEN 5 THEN 'x/123_y.rst' WHEN 6 THEN '1-x.md' WHEN 7 THEN 'mydecisions/x.md' WHEN 8 THEN 'ADR/x.md' ELSE 'b/adr-001-x.md' END"
register("dc2_decision_records", lambda t: t.documents.select("doc_id", D.doc_type(F.expr(ADR_PATHS), F.col("text")).alias("doc_type")), "", "SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN 'readme' WHEN doc_id % 10 IN (0, 1, 2, 5, 8) THEN 'adr' ELSE 'doc' END AS doc_type FROM documents")
NOTE = "concat('---\ntitle: x\n---\n# Note ', conv_id, '\nStatus: Accepted\n## Context\n', role, ' ', replace(coalesce(text, ''), '\n', ' '), '\n### Alternatives\nnone\n##nospace\n')"


def notes(t):
    return t.conversations.select(F.expr("conv_id * 1000 + turn").cast("long").alias("doc_id"), F.lit("docs/n.md").alias("rel"), F.expr(NOTE).alias("content"))


register("dc3_headings", lambda t: D.headings(notes(t)), "", """
SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS doc_id, CAST(u.lineno AS BIGINT) AS lineno, CAST(u.level AS INTEGER) AS level, CASE u.lineno WHEN 1 THEN 'Note ' || CAST(conv_id AS VARCHAR) WHEN 3 THEN 'Context' ELSE 'Alternatives' END AS title FROM conversations, (VALUES (1, 1), (3, 2), (5, 3)) u(lineno, level)""")
register("dc4_sections", lambda t: D.sections(t.doc_lines), "doc_lines", r"""
, c AS (SELECT doc_id, lineno, lead(content) OVER (PARTITION BY doc_id ORDER BY lineno) AS body, content FROM doc_lines)
SELECT doc_id, substr(content, 4) AS heading, 2 AS level, substr(s, 1, 200) AS summary FROM (SELECT *, trim(regexp_replace(body, '\s+', ' ', 'g')) AS s FROM c WHERE lineno % 2 = 1) WHERE s <> ''""")
register("dc5_adr_fields", lambda t: D.adr_fields(notes(t)), "", r"""
SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS doc_id, 'status' AS field, 'Accepted' AS value FROM conversations UNION ALL SELECT CAST(conv_id * 1000 + turn AS BIGINT), 'alternative', 'none ##nospace' FROM conversations
UNION ALL SELECT CAST(conv_id * 1000 + turn AS BIGINT), 'context', substr(trim(regexp_replace(role || ' ' || coalesce(text, ''), '\s+', ' ', 'g')), 1, 300) FROM conversations""")


def terms(t):
    return t.benchmark.select(F.col("item_id").alias("id"), F.expr("element_at(split(text, '[^a-zA-Z]+'), 3)").alias("term"))


TERMS = "n AS (SELECT term, max(item_id) AS id FROM (SELECT item_id, lower(list_extract(regexp_split_to_array(text, '[^a-zA-Z]+'), 3)) AS term FROM benchmark) WHERE length(term) >= 4 GROUP BY term)"
register("jn16_doc_node_links", lambda t: D.doc_node_links(t.documents.select("doc_id", F.col("text").alias("content")), terms(t)), "", rf", {TERMS}, w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+')) AS term FROM documents) SELECT DISTINCT doc_id, id FROM w JOIN n USING (term)")
register("dc6_enrich_docs", lambda t: D.enrich_docs(notes(t), terms(t)), "", rf""", {TERMS}, w AS (SELECT DISTINCT CAST(conv_id * 1000 + turn AS BIGINT) AS doc_id, unnest(regexp_split_to_array(lower('title note status accepted context ' || role || ' ' || coalesce(text, '') || ' alternatives none nospace'), '[^\p{{L}}\p{{N}}_]+')) AS term FROM conversations),
l AS (SELECT doc_id, count(DISTINCT id) AS links FROM w JOIN n USING (term) GROUP BY 1)
SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS doc_id, CASE WHEN regexp_matches(lower(substr('---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) || '# Note ' || CAST(conv_id AS VARCHAR) || chr(10), 1, 2000)), 'never') THEN '' ELSE 'adr' END AS doc_type, 'Note ' || CAST(conv_id AS VARCHAR) || ' > Context > Alternatives' AS outline, 'Accepted' AS status, coalesce(links, 0) AS links FROM conversations LEFT JOIN l ON conv_id * 1000 + turn = l.doc_id""")
register("dc7_doc_manifest", lambda t: D.doc_manifest(t.documents.select(F.col("source").alias("group"), F.expr("CASE WHEN doc_id % 3 = 0 THEN concat('report-', doc_id, '.md') ELSE concat('log-', doc_id) END").alias("rel"), F.col("doc_id").alias("version"), F.col("text").alias("content"))), "", """
SELECT source AS "group", CASE WHEN doc_id % 3 = 0 THEN 'report-' || CAST(doc_id AS VARCHAR) || '.md' ELSE 'log-' || CAST(doc_id AS VARCHAR) END AS rel, sha256(text) AS sha256 FROM (SELECT *, max(CASE WHEN doc_id % 3 = 0 THEN doc_id END) OVER (PARTITION BY source) AS v FROM documents) WHERE doc_id % 3 <> 0 OR doc_id = v""")
register("st5_incremental_docs", lambda t: D.incremental_docs(t.snapshot_old.withColumn("version", F.lit(1)), t.snapshot_new.withColumn("version", F.expr("CASE WHEN rel LIKE '%7' THEN 2 ELSE 1 END"))), "snapshot_old snapshot_new", """
SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.rel, o.rel) AS rel, CASE WHEN n.sha IS NULL THEN 'removed' WHEN n.sha = o.sha AND n.rel NOT LIKE '%7' THEN 'kept' ELSE 'process' END AS action FROM snapshot_new n FULL JOIN snapshot_old o ON n.repo = o.repo AND n.rel = o.rel""")


def vault(t):
    body = "concat('see [[n', p_partkey + 1, '|next]] and [[dir/n', p_partkey * 2, '#top]] or [[http://x]] [[ ]]')"
    return t.part.select(F.expr("concat(CASE p_partkey % 2 WHEN 0 THEN 'dir/' ELSE 'etc/' END, 'n', CASE WHEN p_partkey % 10 = 3 THEN p_partkey + 1 ELSE p_partkey END, '.md')").alias("path"), F.expr(body).alias("content"))


VAULT = "v AS (SELECT p_partkey AS k, CASE p_partkey % 2 WHEN 0 THEN 'dir/' ELSE 'etc/' END || 'n' || CAST(CASE WHEN p_partkey % 10 = 3 THEN p_partkey + 1 ELSE p_partkey END AS VARCHAR) AS p FROM part)"
register("jn10_wikilink_orphans", lambda t: D.wikilink_orphans(vault(t)), "", f""", {VAULT}, l AS (SELECT p || '.md' AS path, unnest(['n' || CAST(k + 1 AS VARCHAR), 'dir/n' || CAST(k * 2 AS VARCHAR)]) AS target FROM v)
SELECT DISTINCT path, target FROM l WHERE target NOT IN (SELECT p FROM v) AND target NOT IN (SELECT split_part(p, '/', 2) FROM v)""")
register("jn11_ambiguous_names", lambda t: D.ambiguous_names(vault(t)), "", f", {VAULT} SELECT split_part(p, '/', 2) AS stem, string_agg(DISTINCT p || '.md', ',' ORDER BY p || '.md') AS paths FROM v GROUP BY 1 HAVING count(DISTINCT p) > 1")
SEARCH = r"""
, w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents),
n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM w), p AS (SELECT doc_id, len(t) AS l, q.term, len(list_filter(t, lambda x: x = q.term)) AS tf FROM w, (VALUES ('de'), ('la')) q(term)),
h AS (SELECT * FROM p WHERE tf > 0), d AS (SELECT term, count(*) AS df FROM h GROUP BY term),
s AS (SELECT doc_id, sum(greatest(ln((n.n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / n.a))) AS score, count(*) AS c FROM h JOIN d USING (term), n GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score FROM s WHERE c = 2 ORDER BY round(score, 9) DESC, doc_id LIMIT 20"""
register("tk1_search", lambda t: D.search(t.documents.select("doc_id", "text"), "de la").select("doc_id", "score"), "", SEARCH)


def _indexed(t):
    """The same search over an index that is written first."""
    docs, path = t.documents.select("doc_id", "text"), fresh_path(t.spark, "index")
    D.write_index(docs, path, 16)
    return D.search_index(path, docs, "de la").select("doc_id", "score")


register("tk1_search_index", _indexed, "", SEARCH)


def _positions(query):
    def run(t):
        docs, path = t.documents.select("doc_id", "text"), fresh_path(t.spark, "positions")
        write_positions(docs, path)
        return search_positions(path, docs, query).select("doc_id", "score")

    return run


def _positions_sql(atoms: list[str], holds: str) -> str:
    """BM25 of phrases, each given as the list positions i of t at which it stands."""
    counts = ", ".join(f"len(list_filter(range(1, len(t) + 1), lambda i: {a})) AS tf{k}" for k, a in enumerate(atoms))
    parts = " + ".join(f"CASE WHEN tf{k} > 0 THEN greatest(ln((n.n - df{k} + 0.5) / (df{k} + 0.5)), 1e-6) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * l / n.a)) ELSE 0 END" for k in range(len(atoms)))
    return rf"""
, w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
c AS (SELECT doc_id, len(t) AS l, {counts} FROM w), n AS (SELECT count(*) AS n, avg(l) AS a, {', '.join(f'count(*) FILTER (WHERE tf{k} > 0) AS df{k}' for k in range(len(atoms)))} FROM c),
s AS (SELECT doc_id, {parts} AS score FROM c, n WHERE {holds}) SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, doc_id LIMIT 20"""


register("tk1_phrase", _positions('"de la"'), "", _positions_sql(["t[i] = 'de' AND t[i + 1] = 'la'"], "tf0 > 0"))
register("tk1_prefix", _positions("ent* AND the"), "", _positions_sql(["starts_with(t[i], 'ent')", "t[i] = 'the'"], "tf0 > 0 AND tf1 > 0"))
register("tk1_boolean", _positions('(la OR "the of") NOT que'), "", _positions_sql(["t[i] = 'la'", "t[i] = 'the' AND t[i + 1] = 'of'", "t[i] = 'que'"], "(tf0 > 0 OR tf1 > 0) AND tf2 = 0"))
register("tk1_words_by_blocks", _positions("de la"), "", SEARCH)
register("tk1_postings", lambda t: D.build_index(t.documents.select("doc_id", "text"))[0].groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), "", r"""
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents) WHERE term <> '' GROUP BY term""")
