"""Tables derived from the given ones. One SQL text serves Spark and DuckDB; ``{name}`` stands for a given table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Lines of code by number; %u is a user, %e an event type.
_LINES = [
    ("ts", "import x from \"./lib/u%u\""),
    ("ts", "import type {{ A }} from \"../%e/index\""),
    ("ts", "const dep = require(\"./m%u.js\")"),
    ("ts", "export class Widget%u extends Base {{"),
    ("ts", "export interface Props {{"),
    ("ts", "export function load%e(id) {{"),
    ("ts", "const h%u = (a) => a"),
    ("ts", "await fetch(\"/api/v1/%e/%u?x=1\")"),
    ("ts", "axios.post(\"/v2/%e\", body)"),
    ("ts", "router.get(\"/v1/%e/{{id}}\", h)"),
    ("ts", "app.use(\"/api/%e\", require(\"./routes/%e\"))"),
    ("ts", "const key = process.env.API_KEY_%E"),
    ("ts", "bus.publish(\"%e.created\", msg)"),
    ("ts", "bus.subscribe(\"%e.created\", cb)"),
    ("ts", "const API_%E = \"/api/v1/%e\""),
    ("ts", "const u = `${{base}}/api/%e/${{id}}`"),
    ("py", "from app.%e import views"),
    ("py", "import os, app.m%u as m"),
    ("py", "class Model%u(Base):"),
    ("py", "def handle_%e(req):"),
    ("py", "requests.get(\"https://svc.local/api/v1/%e/%u\")"),
    ("py", "topic = emit(\"%e-topic\")"),
    ("py", "token = os.environ.get(\"%E\")"),
    ("py", "@app.route(\"/api/v1/%e\")"),
    ("go", "type Order%u struct {{"),
    ("go", "func Handle%u(w http.ResponseWriter) {{"),
    ("go", "func (s *Server) Serve%u() error {{"),
    ("go", "mux.HandleFunc(\"/v1/%e\", h)"),
    ("go", "resp, _ := http.Get(\"/internal/%e\")"),
    ("go", "v := os.Getenv(\"%E\")"),
    ("java", "public class Service%u {{"),
    ("java", "@RestController"),
    ("java", "    public String find%u(int id) {{"),
    ("java", "@GetMapping(\"/v1/%e/{{id}}\")"),
    ("java", "restTemplate.getForObject(\"/api/v1/%e\", A.class)"),
    ("java", "static final String PATH_%E = \"/api/v2/%e\";"),
    ("java", "@KafkaListener(\"%e.created\")"),
    ("java", "import com.acme.u%u;"),
    ("kt", "data class Item%u(val id: Int)"),
    ("kt", "override fun onClick%u() {{"),
    ("kt", "@GET(ApiPaths.%E)"),
    ("kt", "val ENDPOINT_%E = \"v1/%e\""),
    ("html", "<form id=\"f%u\" action=\"/api/%e\">"),
    ("html", "<script src=\"./js/u%u.js\"></script>"),
    ("html", "<div data-role=\"%e\">TODO: write</div>"),
    ("test.ts", "it(\"should fail when %e is missing\", t)"),
    ("test.ts", "describe(\"%e\", () => {{"),
    ("dart", "dio.get(\"/api/v1/%e\")"),
    ("dart", "class Page%u extends Widget {{"),
    ("dart", "  Widget build%u(BuildContext c) {{"),
    ("rs", "pub struct Item%u {{"),
    ("rs", "pub(crate) enum Kind%u {{"),
    ("rs", "    pub fn run_%e(&self) {{"),
    ("kt", "@Service"),
    ("ts", "  public run%u(a) {{"),
    ("ts", "@Injectable()"),
    ("ts", "export default async function main() {{"),
    ("py", "    def method_%e(self):"),
    ("py", "    def __init__(self):"),
    ("py", "@dataclass"),
    ("java", "    public String make%u() {{ return new Order(); }}"),
]


def _values() -> str:
    """The lines as a table; a dollar sign before a brace is spelt apart, for Spark reads it as a variable."""
    rows = []
    for k, (ext, line) in enumerate(_LINES):
        text = line.replace("${{", "' || '$' || '{{")
        rows.append(f"({k}, '{ext}', '{text}')")
    return ", ".join(rows)


_DIR = "CASE user_id % 7 WHEN 0 THEN 'src/pages' WHEN 1 THEN 'app/users' WHEN 2 THEN 'lib' WHEN 3 THEN 'src/tests/unit' WHEN 4 THEN 'public' WHEN 5 THEN 'src/layouts' ELSE 'src' END"

FIXTURES = {
    "files": "SELECT source AS repo, lang || '/d' || CAST(doc_id AS STRING) || CASE doc_id % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.test.js' WHEN 3 THEN '_test.go' WHEN 4 THEN '.md' ELSE '.min.js' END AS rel, text AS content FROM {documents}",
    "code": f"SELECT 'repo' || CAST(user_id % 5 AS STRING) AS repo, {_DIR} || '/f' || CAST(user_id % 40 AS STRING) || '.' || ext AS rel, CAST(event_id AS BIGINT) AS lineno, replace(replace(replace(line, '%u', CAST(user_id % 20 AS STRING)), '%e', event_type), '%E', upper(event_type)) AS content FROM {{events}} JOIN (VALUES {_values()}) v(k, ext, line) ON event_id % {len(_LINES)} = k",
    "import_lines": "SELECT 'repo' || CAST(l_suppkey % 5 AS STRING) AS repo, 'src/p' || CAST(l_partkey AS STRING) || '.ts' AS rel, CAST(l_linenumber AS BIGINT) AS lineno, 'import x from \"./s' || CAST(l_suppkey AS STRING) || '\"' AS content FROM {lineitem}",
    "callsites": "SELECT 'web' || CAST(user_id % 7 AS STRING) AS repo, 'src/m' || CAST(user_id % 13 AS STRING) || '/client.ts' AS rel, CAST(event_id AS BIGINT) AS lineno, 'await client.' || CASE WHEN event_type IN ('purchase','signup') THEN 'post' ELSE 'get' END || '(\"/api/v' || CAST(event_id % 2 + 1 AS STRING) || '/' || event_type || CAST(user_id % 40 AS STRING) || '/' || CAST(user_id AS STRING) || '\")' AS content FROM {events}",
    "routes": "SELECT route_idx, repo, 'src/' || kind || '/routes.ts' AS rel, lineno, CASE WHEN side = 0 THEN 'router.get(\"/v1/' || kind || '/{{id}}\")' ELSE 'router.post(\"/api/v1/' || kind || '/' || CAST(no AS STRING) || '\")' END AS content FROM (SELECT CAST(s_suppkey AS BIGINT) AS route_idx, 'svc' || CAST(s_suppkey % 5 AS STRING) AS repo, (s_suppkey % 5) % 2 AS side, CAST(s_suppkey * 10 + 1 AS BIGINT) AS lineno, CAST(floor(s_suppkey / 25.0) AS BIGINT) AS no, CASE CAST(floor(s_suppkey / 5.0) AS BIGINT) % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'error' END || CAST(CAST(floor(s_suppkey / 25.0) AS BIGINT) AS STRING) AS kind FROM {supplier})",
    "results": "SELECT user_id AS run_id, 'SC-' || CAST(user_id % 5 AS STRING) AS scenario, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS step, CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'signup' THEN 'SKIP' ELSE 'PASS' END AS status, CASE event_id % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'continue' ELSE 'log' END AS failure_mode, (event_id % 4 = 0) AS critical, value AS duration_ms FROM {events}",
    "commits": "SELECT event_id AS sha, user_id AS author, ts, CASE event_type WHEN 'purchase' THEN 'feat: x' WHEN 'error' THEN 'fix: y' ELSE 'chore: z' END AS message FROM {events}",
    "decisions": "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Warm' ELSE 'Cold' END AS status, CAST(o_orderdate AS DATE) AS created, 'P' || CAST(o_custkey % 4 AS STRING) AS product, o_orderpriority AS tag, (o_orderkey % 11 = 0) AS evergreen FROM {orders}",
    "links": "SELECT CAST(floor(p_partkey / 2.0) AS BIGINT) AS src, p_partkey AS dst, CASE p_partkey % 3 WHEN 0 THEN 'replaces' WHEN 1 THEN 'related' ELSE 'conflicts' END AS type FROM {part} WHERE p_partkey > 1",
    "doc_lines": "SELECT conv_id AS doc_id, CAST(turn * 2 + 1 AS BIGINT) AS lineno, '## ' || role AS content FROM {conversations} UNION ALL SELECT conv_id, CAST(turn * 2 + 2 AS BIGINT), text FROM {conversations}",
    "log": "SELECT user_id AS task_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS line_no, CASE event_type WHEN 'view' THEN '[P4.0-EVAL-YAML]' WHEN 'click' THEN '[P4.1-DISPATCH]' WHEN 'purchase' THEN '[P4.0-QA-CSV] approved=yes' WHEN 'signup' THEN '[P4.0-TDD-RED]' ELSE '[TERMINOLOGY] open_doubts=' || CASE WHEN event_id % 2 = 0 THEN 'pending' ELSE '\"none\"' END END AS text FROM {events}",
    "messages": "SELECT 'events' AS topic, CAST(user_id % 4 AS BIGINT) AS part_no, event_id AS msg_offset, CAST(user_id AS STRING) || ':' || event_type AS idempotency_id, ts, event_type, props AS value FROM {events}",
    "snapshot_new": "SELECT source AS repo, CAST(doc_id AS STRING) AS rel, CASE WHEN doc_id % 10 = 0 THEN 'changed' ELSE md5(text) END AS sha FROM {documents} WHERE doc_id % 13 <> 0",
    "snapshot_old": "SELECT source AS repo, CAST(doc_id AS STRING) AS rel, md5(text) AS sha FROM {documents} WHERE doc_id % 17 <> 0",
    "steps": "SELECT CAST(floor(p_partkey / 16.0) AS BIGINT) AS task_id, 's' || CAST(p_partkey % 16 AS STRING) AS id, CASE p_partkey % 6 WHEN 0 THEN 'web-cdp' WHEN 1 THEN 'rest' WHEN 2 THEN 'db' WHEN 3 THEN 'Cache' WHEN 4 THEN 'bus' ELSE 'fax' END AS surface, p_name AS intent, CASE WHEN p_partkey % 16 = 0 THEN '' WHEN p_partkey % 29 = 0 THEN 'missing' ELSE 's' || CAST(CAST(floor((p_partkey % 16) / 2.0) AS BIGINT) AS STRING) END AS depends_on, CAST(p_partkey AS BIGINT) AS row_no FROM {part}",
}


def duck_sql(names: tuple[str, ...]) -> str:
    """CTEs of the fixtures for DuckDB."""
    given = {t: t for t in TABLES}
    return ", ".join(f"{n} AS ({FIXTURES[n].format(**given)})" for n in names)


class Inputs:
    """Given tables and fixtures of one data directory, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in FIXTURES:
            raise AttributeError(name)
        used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in FIXTURES[name]}
        return self.spark.sql(FIXTURES[name], **used)
