"""Facts of code lines: routes, HTTP calls, endpoint constants, environment keys, events, imports, links between pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_api_path, join_route, normalize_route, resolve_relative, without_query
from ..plans.shared import written
from .corpus import LOW_SIGNAL_FILE, LOW_SIGNAL_PATH, TEST_PATH

Q = "['\"`]"


def any_of(names: list[str]) -> str:
    """A pattern for any of the literal names."""
    return "|".join(re.escape(n) for n in names)


# What a line that declares a route holds.
ROUTE_MARKS = [
    "@Get", "@Post", "@Put", "@Delete", "@Patch",
    "@GetMapping", "@PostMapping", "@PutMapping", "@DeleteMapping", "@PatchMapping", "@RequestMapping",
    "@Controller", "@Route",
    "router.get", "router.post", "router.put", "router.delete", "router.patch",
    "router.route", "app.route", "router.use", "app.use",
    "app.get", "app.post", "app.put", "app.delete", "app.patch",
    "r.GET", "r.POST", "r.PUT", "r.DELETE", "r.PATCH",
    "@app.route", "@router.",
    "mux.HandleFunc", "http.HandleFunc", "e.GET", "e.POST", "g.GET", "g.POST",
]
ROUTE_LINE = any_of(ROUTE_MARKS)

# Patterns of routes, mounts, path templates, URLs and verbs.
ROUTE_EXT = r"\.(ts|tsx|mts|cts|py|go|java|kt|js|jsx|mjs|cjs)$"
JS_ROUTE = rf"(?i)\b(?:app|router)\.(get|post|put|patch|delete|head|options|all|use)\s*\(\s*{Q}([^'\"`]+){Q}"
JS_CHAIN = rf"(?i)\b(?:app|router)\.route\s*\(\s*{Q}([^'\"`]+){Q}\s*\)\s*\.(get|post|put|patch|delete|head|options|all)\s*\("
SPRING = r"(?i)@(Get|Post|Put|Patch|Delete|Request)Mapping\s*\(\s*(?:(?:value|path)\s*=\s*)?['\"]([^'\"]+)['\"]"
SPRING_CLASS = r"(?i)@RequestMapping\s*\(\s*(?:(?:value|path)\s*=\s*)?['\"]([^'\"]+)['\"][^)]*\)\s*(?:public|private|protected|abstract|final|\s)*class\s"
NEST_CLASS = rf"(?i)@Controller\s*\(\s*{Q}([^'\"`]*){Q}\s*\)"
NEST = rf"(?i)@(Get|Post|Put|Patch|Delete)\s*\(\s*{Q}([^'\"`]*){Q}\s*\)"
MOUNT = rf"\b(?:app|router)\.use\(\s*{Q}(/[^'\"`]+){Q}"
MOUNT_REQUIRE = rf"(?i)\b(?:app|router)\.use\(\s*{Q}([^'\"`]+){Q}\s*,\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)"
TEMPLATES = [(r"(?i)\b(?:GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)\s+(/[^\s]+)", 1), (rf"{Q}(/[^'\"]+){Q}", 1), (r"/api[^\s'\"`?#)]+", 0), (r"/v[0-9]+[^\s'\"`?#)]+", 0), (r"https?://[^/\s'\"]+(/[^\s'\"`?#)]+)", 1)]
URLS = [(r"/api[^\s'\"`?#)]+", 0), (r"/v[0-9]+[^\s'\"`?#)]+", 0), (r"/graphql[^\s'\"`?#)]+", 0), (r"/rest[^\s'\"`?#)]+", 0), (rf"{Q}(/[^'\"`]+){Q}", 1), (r"https?://[^/\s'\"]+(/[^\s'\"`?#)]+)", 1)]
RELATIVE_URL = rf"{Q}((?:api|internal|graphql|v[0-9]+)[^'\"`?#)\s]*){Q}"
CALL_METHOD = r"(?i)method\s*[:=]\s*['\"]?(GET|POST|PUT|PATCH|DELETE|HEAD)|\.(get|post|put|patch|delete|head)\s*\("
ROUTE_METHOD = r"(?i)@(Get|Post|Put|Patch|Delete|Head)Mapping|@(GET|POST|PUT|PATCH|DELETE|HEAD)\(|\b(?:router|app)\.(get|post|put|patch|delete|head)\s*\("

# How calls of HTTP clients look, by language.
CALLS = {
    "js": [
        "fetch(", "$fetch(", "useFetch(", "ofetch(", "axios.", "got.", "superagent.", "ky.", "needle.",
        "http.get(", "http.post(", "http.put(", "http.delete(", "http.patch(", "request(", "apiClient.",
        "client.get(", "client.post(", "client.put(", "client.delete(", "createApi(",
    ],
    "java": ["restTemplate.", "webClient.", "HttpClient.", "OkHttpClient.", ".exchange(", ".getForObject(", ".postForObject(", "@FeignClient"],
    "kotlin": ["client.get(", "client.post(", "client.put(", "client.delete(", "Fuel.get(", "Fuel.post(", ".get<", ".post<"],
    "retrofit": ["@GET(", "@POST(", "@PUT(", "@DELETE(", "@PATCH("],
    "python": ["requests.get(", "requests.post(", "requests.put(", "requests.delete(", "httpx.get(", "httpx.post(", "aiohttp."],
    "go": ["http.Get(", "http.Post(", "http.NewRequest(", "resty.", "client.R().Get("],
    "dart": ["dio.get(", "dio.post(", "dio.put(", "dio.delete(", "http.get(", "http.post("],
}
# Mappings that are calls where path or line speaks of a client.
FEIGN_MAPPINGS = ["@GetMapping", "@PostMapping", "@PutMapping", "@DeleteMapping", "@PatchMapping", "@RequestMapping"]
CLIENT = r"(?i)feign|client"

#: HTTP call rules: extensions, pattern of the line, paths left out, pattern that path or line must hold.
CALL_RULES = [
    ("ts|tsx|js|jsx", any_of(CALLS["js"]), "", ""),
    ("java", any_of(CALLS["java"]), r"(Test|IT|Tests)\.java$", ""),
    ("java", any_of(FEIGN_MAPPINGS), "", CLIENT),
    ("kt", any_of(CALLS["kotlin"]), r"(Test|Spec)\.kt$", ""),
    ("kt", any_of(CALLS["retrofit"]), "", ""),
    ("py", any_of(CALLS["python"]), r"_test\.py$|/conftest\.py$|(^|/)test_[^/]*$", ""),
    ("go", any_of(CALLS["go"]), r"_test\.go$", ""),
    ("dart", any_of(CALLS["dart"]), "", ""),
]

# Constants that hold endpoints, and environment access.
ENDPOINT_CONST = r"\b(?:const\s+val|val|const|public\s+static\s+final\s+String|static\s+final\s+String)\s+([A-Za-z_][A-Za-z0-9_]*)\s*(?::\s*[A-Za-z0-9_<>,.? ]+)?=\s*['\"]([^'\"]{2,260})['\"]"
ENV = r"process\.env\.|os\.environ\.|os\.Getenv|System\.getenv|dotenv|env\.|Env\."
ENV_KEYS = [(r"process\.env\.([A-Z_]+)", 1), (r"os\.environ\.get\(['\"]([A-Z_]+)", 1), (r"[Gg]etenv\(['\"]([A-Z_]+)", 1)]

# Names by which event producers and consumers show, the first that matches counts.
EVENT_APIS = {
    "pub": ["publish(", "produce(", "emit(", "sendMessage", "kafkaProducer", "channel.send", "rabbitMQ.publish", ".send("],
    "sub": ["subscribe(", "consume(", ".on(", "kafkaConsumer", "channel.receive", "rabbitMQ.consume", "@KafkaListener", ".listen("],
}

# Import statements.
TS_IMPORT = r"^\s*(?:import\s+(?:type\s+)?(?:[\w*{}\s,]+?\s+from\s+)?|export\s+(?:\*|\{[^}]*\}|type\s+[^=]+)\s+from\s+)[\"']([^\"']+)[\"']"
TS_REQUIRE = r"^\s*(?:const|let|var)\s+[\w$]+\s*=\s*require\([\"']([^\"']+)[\"']\)"
PY_FROM = r"^\s*from\s+([A-Za-z0-9_\.]+)\s+import\s+"
PY_IMPORT = r"^\s*import\s+([A-Za-z0-9_\., ]+)"


def all_of(text: Column, patterns: list[tuple[str, int]]) -> Column:
    return F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in patterns))


def route_lines(lines: DataFrame, pattern: str = ROUTE_LINE) -> DataFrame:
    rel = F.col("rel")
    return lines.filter(rel.rlike(ROUTE_EXT) & ~rel.rlike(r"node_modules|(^|/)dist/") & ~rel.rlike(TEST_PATH) & F.col("content").rlike(pattern))


def synthetic_routes(files: DataFrame) -> DataFrame:
    """files(repo, rel, content) to (repo, rel, method, path) of routes that whole-file patterns show, class prefixes joined on."""
    c = F.col("content")

    def pairs(pattern: str, verb: int, path: int) -> Column:
        return F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(verb)).alias("verb"), F.regexp_extract_all(c, F.lit(pattern), F.lit(path)).alias("path"))

    js = F.filter(F.concat(pairs(JS_ROUTE, 1, 2), pairs(JS_CHAIN, 2, 1)), lambda x: F.lower(x["verb"]) != "use")
    prefixed = lambda found, prefix: F.transform(found, lambda x: F.struct(x["verb"].alias("verb"), join_route(prefix, x["path"]).alias("path")))
    spring_prefix, nest_prefix = F.regexp_extract(c, SPRING_CLASS, 1), F.regexp_extract(c, NEST_CLASS, 1)
    spring = F.filter(pairs(SPRING, 1, 2), lambda x: (F.lower(x["verb"]) != "request") | (spring_prefix == ""))
    by = lambda ext, found: F.when(F.col("rel").rlike(ext), found).otherwise(F.expr("cast(array() as array<struct<verb:string,path:string>>)"))
    js_rows = F.transform(js, lambda x: F.struct(x["verb"].alias("verb"), normalize_route(x["path"]).alias("path")))
    rows = F.concat(by(r"\.(js|jsx|mjs|cjs|ts|tsx|mts|cts)$", js_rows), by(r"\.(java|kt)$", prefixed(spring, spring_prefix)), by(r"\.ts$", F.when(c.rlike(NEST_CLASS), prefixed(pairs(NEST, 1, 2), nest_prefix)).otherwise(F.expr("cast(array() as array<struct<verb:string,path:string>>)"))))
    out = files.select("repo", "rel", F.explode(rows).alias("r")).select("repo", "rel", F.upper("r.verb").alias("method"), "r.path")
    return out.withColumn("method", F.when(F.col("method") == "REQUEST", "ALL").otherwise(F.col("method"))).filter("path <> ''").distinct()


def mounted_routes(routes: DataFrame, mounts: DataFrame) -> DataFrame:
    """routes(repo, rel, method, path) under mounts(repo, rel, prefix, child): each route also with the prefixes of every mount path that leads to it, however
    long. A path visits a file once, which ends mounts that run in a circle. Only what the last step added is joined again. Mounts are worked out once, with
    their prefixes normalized; steps can repeat a row only where a file mounts another under several prefixes, and only then are they made distinct."""
    edges = written(mounts.select("repo", F.col("child").alias("rel"), "prefix", normalize_route(F.col("prefix")).alias("led"), F.col("rel").alias("parent")).distinct(), "mounts")
    repeats = not edges.groupBy("repo", "rel", "parent").count().filter("count > 1").isEmpty()
    step = routes.select("repo", "rel", "method", "path", F.col("rel").alias("at"), F.array("rel").alias("seen")).distinct()
    out, first = step.limit(0), True
    while True:
        up = step.alias("s").join(edges.alias("e"), (F.col("s.repo") == F.col("e.repo")) & (F.col("s.at") == F.col("e.rel"))).filter(~F.array_contains("s.seen", F.col("e.parent")))
        path = join_route(F.col("e.prefix"), F.col("s.path")) if first else _led(F.col("e.prefix"), F.col("e.led"), F.col("s.path"))
        up = up.select("s.repo", "s.rel", "s.method", path.alias("path"), F.col("e.parent").alias("at"), F.array_append("s.seen", F.col("e.parent")).alias("seen"))
        step = written(up.distinct() if first or repeats else up, "mounted")
        first = False
        if step.isEmpty():
            return out.select("repo", "rel", "method", "path").distinct()
        out = out.unionByName(step)


def _led(prefix: Column, led: Column, path: Column) -> Column:
    """``join_route`` of a prefix, given normalized as well, and a path that it gave: only one that ends in a space is not normalized already."""
    plain = F.when(led == "", path).when(path.isin("", "/"), led).when(led == "/", path).otherwise(F.concat(led, path))
    return F.when(path.endswith(" "), join_route(prefix, path)).otherwise(plain)


def mount_edges(files: DataFrame) -> DataFrame:
    """``.use(prefix, require(child))`` in files, the child as a path of the repository without suffix."""
    c = F.col("content")
    found = F.arrays_zip(F.regexp_extract_all(c, F.lit(MOUNT_REQUIRE), F.lit(1)).alias("prefix"), F.regexp_extract_all(c, F.lit(MOUNT_REQUIRE), F.lit(2)).alias("spec"))
    return files.select("repo", "rel", F.explode(found).alias("m")).select("repo", "rel", "m.prefix", resolve_relative(F.col("rel"), F.col("m.spec")).alias("child"))


def route_templates(line: Column, templates: list[tuple[str, int]] = TEMPLATES) -> Column:
    """Distinct path strings of a route line, in the order of the pattern families."""
    return F.array_distinct(F.transform(all_of(line, templates), lambda x: F.regexp_extract(x, r"^([^?]*)", 1)))


def _first_group(text: Column, pattern: str, groups: int) -> Column:
    return F.nullif(F.upper(F.concat(*(F.regexp_extract(text, pattern, g) for g in range(1, groups + 1)))), F.lit(""))


def route_method(line: Column) -> Column:
    return _first_group(line, ROUTE_METHOD, 3)


def call_method(line: Column) -> Column:
    return _first_group(line, CALL_METHOD, 2)


def mount_prefixes(routes: DataFrame) -> DataFrame:
    """Distinct mount prefixes of each repository that look like API paths."""
    return routes.select("repo", F.explode(F.regexp_extract_all("content", F.lit(MOUNT), F.lit(1))).alias("prefix")).filter(is_api_path(F.concat("prefix", F.lit("/")))).distinct()


def is_mount_only(line: Column) -> Column:
    low = F.lower(line)
    return low.contains(".use(") & ~low.rlike(r"(get|post|put|patch|delete|head)\(|@(get|post|put|patch|delete|head)")


def call_sites(lines: DataFrame, rules: list[tuple[str, str, str, str]] = CALL_RULES) -> DataFrame:
    """HTTP-shaped calls of six language families, one pass over the lines."""
    rel, content = F.col("rel"), F.col("content")
    any_rule = F.lit(False)
    for ext, pattern, skip, about in rules:
        rule = rel.rlike(rf"\.({ext})$") & content.rlike(pattern)
        rule = rule & ~rel.rlike(skip) if skip else rule
        any_rule = any_rule | (rule & F.concat("rel", F.lit(":"), "content").rlike(about) if about else rule)
    return lines.filter(any_rule & ~rel.rlike(TEST_PATH) & ~rel.rlike(LOW_SIGNAL_PATH) & ~rel.rlike(LOW_SIGNAL_FILE) & ~rel.contains("node_modules"))


def union_call_sites(primary: DataFrame, extra: DataFrame) -> DataFrame:
    key = ["repo", "rel", "lineno"]
    return primary.unionByName(extra.join(primary.select(*key).distinct(), key, "left_anti"))


def endpoint_constants(lines: DataFrame) -> DataFrame:
    """Constants whose value looks like an endpoint."""
    symbol, value = F.regexp_extract("content", ENDPOINT_CONST, 1), F.trim(F.regexp_extract("content", ENDPOINT_CONST, 2))
    low = F.lower(value)
    absolute = low.rlike("^https?://") & low.rlike("/api|/v|/graphql|/internal")
    local = low.rlike("^(/|api/|v)") & low.rlike("api|graphql|internal|^v[0-9]+")
    good = F.col("rel").rlike(r"\.(kt|java|ts|tsx|js|jsx)$") & ~F.col("rel").rlike(TEST_PATH) & ~F.col("rel").rlike(LOW_SIGNAL_PATH)
    return lines.filter(good & F.col("content").rlike(ENDPOINT_CONST)).select("repo", "rel", "lineno", symbol.alias("symbol"), value.alias("value")).filter(F.when(low.rlike("^https?://"), absolute).otherwise(local))


def urls_in_content(content: Column) -> Column:
    """Sorted distinct API paths of a line."""
    relative = F.transform(F.regexp_extract_all(content, F.lit(RELATIVE_URL), F.lit(1)), lambda x: F.concat(F.lit("/"), x))
    found = F.transform(F.concat(all_of(content, URLS), relative), without_query)
    return F.array_sort(F.array_distinct(F.filter(found, is_api_path)))


def resolve_symbols(refs: DataFrame, constants: DataFrame) -> DataFrame:
    """refs(repo, call_id, symbol) to endpoint values: by full symbol, or by leaf name if that has one value in the repository."""
    leaf = lambda c: F.regexp_extract(c, r"([^.]*)$", 1)
    exact = constants.select("repo", "symbol", F.col("value").alias("exact")).distinct()
    single = constants.groupBy("repo", leaf(F.col("symbol")).alias("leaf")).agg(F.collect_set("value").alias("v")).filter(F.size("v") == 1).select("repo", "leaf", F.col("v")[0].alias("by_leaf"))
    out = refs.join(exact, ["repo", "symbol"], "left").withColumn("leaf", leaf(F.col("symbol"))).join(single, ["repo", "leaf"], "left")
    value = F.coalesce("exact", "by_leaf")
    path = F.when(value.startswith("/"), value).otherwise(F.concat(F.lit("/"), value))
    return out.select("repo", "call_id", "symbol", without_query(path).alias("url")).filter(F.col("url").isNotNull() & is_api_path(F.col("url"))).distinct()


def frontend_urls(lines: DataFrame) -> DataFrame:
    return lines.select("repo", F.explode(F.regexp_extract_all("content", F.lit(rf"{Q}((?:https?:/)?/[^'\"`\s]+){Q}"), F.lit(1))).alias("url")).distinct()


def dynamic_url_lines(lines: DataFrame) -> DataFrame:
    """Lines that build a URL from parts and so need a look."""
    return lines.filter(F.col("content").rlike(r"`[^`]*\$\{[^}]*\}[^`]*/|['\"]/[^'\"]*['\"]\s*\+"))


def env_usage(lines: DataFrame, pattern: str = ENV) -> DataFrame:
    rel = F.col("rel")
    return lines.filter(rel.rlike(r"\.(ts|js|py|go|java|kt)$") & ~F.lower(F.concat("rel", "content")).contains("test") & F.col("content").rlike(pattern))


def env_keys(lines: DataFrame, keys: list[tuple[str, int]] = ENV_KEYS) -> DataFrame:
    return env_usage(lines).select(F.explode(all_of(F.col("content"), keys)).alias("key")).distinct()


def event_endpoints(lines: DataFrame, topics: list[str] | None = None, apis: dict[str, list[str]] = EVENT_APIS) -> DataFrame:
    """Publisher and subscriber lines with the first API name that matches and a topic: a known one, or one with a dot or dash or in lower case."""
    c = F.col("content")
    quoted = F.regexp_extract_all(c, F.lit(r"['\"]([\w.\-/]+)['\"]"), F.lit(1))
    known = lambda x: x.isin(*topics) if topics else F.lit(False)
    lower = lambda x: (x == F.lower(x)) & x.rlike("[a-z]")
    topic = F.coalesce(F.try_element_at(F.filter(quoted, lambda x: known(x) | x.rlike(r"[.\-]") | lower(x)), F.lit(1)), F.lit(""))
    kinds = [F.when(F.size(hit) > 0, F.struct(F.lit(kind).alias("kind"), hit[0].alias("api"))) for kind, names in apis.items() for hit in [F.filter(F.array(*map(F.lit, names)), lambda a: F.contains(c, a))]]
    rows = lines.filter(F.col("rel").rlike(r"\.(ts|py|go|java|kt)$") & ~F.lower(F.concat("rel", "content")).contains("test"))
    return rows.withColumn("k", F.explode(F.array_compact(F.array(*kinds)))).select("repo", "rel", "lineno", "k.kind", "k.api", topic.alias("topic"))


def import_edges(lines: DataFrame) -> DataFrame:
    """Import targets of TypeScript, JavaScript and Python lines: relative ones as paths, graded by how sure the form is."""
    c, rel = F.col("content"), F.col("rel")
    js, py = rel.rlike(r"\.(ts|tsx|js|jsx|mjs|cjs)$"), rel.endswith(".py")
    one = lambda pattern, kind, sure: F.when(F.regexp_extract(c, pattern, 1) != "", F.array(F.struct(F.lit(kind).alias("kind"), F.regexp_extract(c, pattern, 1).alias("target"), F.lit(sure).alias("provenance"))))
    names = F.transform(F.split(F.regexp_extract(c, PY_IMPORT, 1), ","), lambda x: F.regexp_extract(F.trim(x), r"^(\S*)", 1))
    many = F.when(F.regexp_extract(c, PY_IMPORT, 1) != "", F.transform(F.filter(names, lambda x: x != ""), lambda x: F.struct(F.lit("import").alias("kind"), x.alias("target"), F.lit("HEURISTIC").alias("provenance"))))
    found = F.when(js, F.coalesce(one(TS_IMPORT, "import", "HEURISTIC"), one(TS_REQUIRE, "require", "HEURISTIC"))).when(py, F.coalesce(one(PY_FROM, "from", "HEURISTIC"), many))
    rows = lines.withColumn("e", F.explode(found)).select("repo", "rel", "lineno", "e.kind", "e.target", "e.provenance", js.alias("js"))
    dotted = F.regexp_replace("target", r"\.", "/")
    return rows.withColumn("resolved", F.when(F.col("js"), resolve_relative(rel, F.col("target"))).otherwise(dotted)).drop("js")


SUFFIXES = ["tsx", "jsx", "ts", "js", "mjs", "cjs"]


def resolve_local_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports(repo, rel, resolved) to existing files: the path itself, with a suffix in order, then an index file of the directory. Spellings are tried once
    for each path that is imported, not for each import of it."""
    p = F.col("resolved")
    bare = F.regexp_replace(p, r"\.[^./]*$", "")
    tries = F.array(p, *(F.concat(bare, F.lit(f".{s}")) for s in SUFFIXES), *(F.concat(p, F.lit(f"/index.{s}")) for s in SUFFIXES))
    known = imports.filter("resolved IS NOT NULL").select("repo", "rel", "resolved")
    rows = known.select("repo", "resolved").distinct().select("repo", "resolved", F.posexplode(tries).alias("rank", "file"))
    found = rows.join(files.select("repo", F.col("rel").alias("file")).distinct(), ["repo", "file"])
    found = found.groupBy("repo", "resolved").agg(F.min_by("file", "rank").alias("file"))
    return known.distinct().join(found, ["repo", "resolved"]).select("repo", "rel", "resolved", "file")


def html_asset_links(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) to script sources and stylesheet or module targets within the site."""
    script = F.regexp_extract_all("html", F.lit("(?i)<script[^>]*\\ssrc=[\"']([^\"']+)[\"']"), F.lit(1))
    link = F.regexp_extract_all("html", F.lit("(?i)<link[^>]*\\shref=[\"']([^\"']+)[\"']"), F.lit(1))
    anchor = F.regexp_extract_all("html", F.lit("(?i)<a[^>]*\\shref=[\"']([^\"']+)[\"']"), F.lit(1))
    tagged = lambda kind, found: F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("target")))
    rows = pages.select("page_id", F.explode(F.concat(tagged("script", script), tagged("link", link), tagged("anchor", anchor))).alias("l")).select("page_id", "l.kind", "l.target")
    return rows.filter(~F.col("target").rlike("^(data|blob|mailto|javascript):|^#")).distinct()


def page_link_graph(links: DataFrame) -> DataFrame:
    """links(page, target, via) to one row per target: how it is reached, and the pages that refer to it."""
    return links.groupBy("target", "via").agg(F.array_join(F.array_sort(F.collect_set("page")), ",").alias("pages"), F.countDistinct("page").alias("n"))


def slug_ids(symbols: DataFrame) -> DataFrame:
    """Stable ids of inventory rows: a hash of the line, and a slug of the file."""
    from ..functions.paths import slug

    line = F.concat_ws(":", "rel", "lineno", "content")
    return symbols.select("repo", "rel", "lineno", F.xxhash64(line).alias("id"), F.concat("repo", F.lit("-"), slug(F.col("rel"))).alias("file_id"))


def posix_cksum(text: Column) -> Column:
    """POSIX cksum of a string's bytes: the CRC of polynomial 04C11DB7, most significant bit first, over the bytes and then the length's, inverted. A fold
    over the bytes; Spark's crc32 goes the other way round."""
    crc = [byte << 24 for byte in range(256)]
    for _ in range(8):
        crc = [(c << 1 ^ (0x04C11DB7 if c >> 31 else 0)) & 0xFFFFFFFF for c in crc]
    table = F.array(*(F.lit(c).cast("long") for c in crc))
    data = F.encode(text, "UTF-8")
    n = F.octet_length(data)
    own = F.transform(F.filter(F.sequence(F.lit(0), n), lambda k: k > 0), lambda k: F.conv(F.hex(F.substring(data, k, F.lit(1))), 16, 10).cast("int"))
    size = F.transform(F.filter(F.array(*(F.shiftright(n, 8 * k) for k in range(4))), lambda x: x > 0), lambda x: x.bitwiseAND(255))
    step = lambda c, byte: F.shiftleft(c, 8).bitwiseAND(0xFFFFFFFF).bitwiseXOR(F.get(table, F.shiftright(c, 24).bitwiseXOR(byte.cast("long")).cast("int")))
    return F.aggregate(F.concat(own, size), F.lit(0).cast("long"), step, lambda c: c.bitwiseXOR(F.lit(0xFFFFFFFF).cast("long")))


def module_routes(routes: DataFrame) -> DataFrame:
    """routes(module, method, path) to each module's routes, as one sorted list."""
    return routes.groupBy("module").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "method", "path"))), "; ").alias("routes"), F.count("*").alias("n"))


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


