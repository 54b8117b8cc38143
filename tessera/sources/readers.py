"""Sources: source trees, tagged records, TSV, step CSV, JSONL, and JSON documents held in columns; and the edge-store sink."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Directories that hold no source of the product.
SKIP_DIRS = ("node_modules", ".git", "__pycache__", "vendor", "dist", "build", "coverage", "target", ".next", "out", ".turbo", ".nuxt", ".output", "tmp", "temp", ".tmp", ".cache", ".gradle", "generated")

# Names a test surface goes by, and the surface each means.
SURFACES = {
    "web": "web", "web-cdp": "web", "ui": "web", "api": "api", "api-http": "api", "http": "api", "rest": "api", "mysql": "mysql", "db": "mysql", "database": "mysql",
    "redis": "redis", "cache": "redis", "es": "es", "elasticsearch": "es", "search": "es", "kafka": "kafka", "bus": "kafka",
    "ios": "ios", "xctest": "ios", "android": "android", "adb": "android", "mobile-android": "android",
}


def in_skipped_dir(rel: Column) -> Column:
    names = "|".join(d.replace(".", r"\.") for d in SKIP_DIRS)
    return rel.rlike(f"(^|/)({names})/")


def read_corpus(spark: SparkSession, roots: dict[str, str], roles: dict[str, str] | None = None) -> DataFrame:
    """files(repo, role, rel, content, bytes, sha) of whole trees, one folder per repository, a role per repository where given. One scan reads all
    folders, and the path filter comes before the content is decoded; bytes that are not UTF-8 become U+FFFD. Empty files are not listed."""
    plain = {repo: "/" + re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", root).strip("/") for repo, root in roots.items()}
    folders: dict[str, list[str]] = {}
    for repo, folder in plain.items():
        folders.setdefault(folder, []).append(repo)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(sorted(set(roots.values())))
    where = F.regexp_replace("path", r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "")
    parts = F.split("where", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    known = F.create_map(*(x for folder, repos in folders.items() for x in (F.lit(folder), F.array(*map(F.lit, repos)))))
    found = F.transform(F.filter(above, lambda d: F.map_contains_key(known, d)), lambda d: F.struct(d.alias("folder"), F.element_at(known, d).alias("repos")))
    rows = raw.withColumn("where", where).withColumn("in", F.explode(found)).withColumn("rel", F.expr("substring(`where`, length(`in`.folder) + 2)"))
    rows = rows.filter(~in_skipped_dir(F.col("rel"))).withColumn("repo", F.explode("in.repos"))
    role = F.lit(None).cast("string")
    if roles:
        role = F.try_element_at(F.create_map(*(F.lit(x) for kv in roles.items() for x in kv)), F.col("repo"))
    text = F.expr("make_valid_utf8(cast(content AS string))")
    return rows.select("repo", role.alias("role"), "rel", text.alias("content"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha"))


def to_lines(files: DataFrame) -> DataFrame:
    """files(repo, rel, content) to numbered lines; a final newline starts no line, blank lines before it are lines."""
    body = F.regexp_replace("content", r"\r?\n\z", "")
    lines = files.filter(F.length("content") > 0).select("repo", "rel", F.posexplode(F.split(body, r"\r?\n")).alias("k", "content"))
    return lines.select("repo", "rel", (F.col("k") + 1).cast("long").alias("lineno"), "content")


def parse_tagged(df: DataFrame, column: str = "raw") -> tuple[DataFrame, DataFrame]:
    """``repo<TAB>rel:line:content`` to records, and the rows that are not of that form."""
    pattern = r"^([^\t]*)\t([^:]*):(\d+):(.*)$"
    part = lambda k: F.regexp_extract(column, pattern, k)
    good = F.col(column).rlike(pattern)
    records = df.filter(good).select(part(1).alias("repo"), part(2).alias("rel"), part(3).cast("long").alias("lineno"), part(4).alias("content"))
    return records, df.filter(~F.coalesce(good, F.lit(False))).select(F.lit("malformed").alias("reason"), F.col(column).alias("raw"))


def read_tsv(spark: SparkSession, path: str, columns: list[str], min_cols: int) -> DataFrame:
    """Tab-separated rows with at least min_cols fields; ``#`` lines are comments, missing fields null."""
    fields = F.split(F.col("value"), "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "") & (F.size(fields) >= min_cols))
    return rows.select(*(F.try_element_at(fields, F.lit(k + 1)).alias(c) for k, c in enumerate(columns)))


def read_steps(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Step rows with any spelling of their headers to steps(task_id, id, surface, intent, depends_on, row_no), and error rows."""
    names = {c: "".join(ch for ch in c.lower() if ch.isalnum()) for c in df.columns}
    by = {v: F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))) for k, v in names.items()}
    surface = F.lower(by["surface"])
    known = F.create_map(*(F.lit(x) for kv in SURFACES.items() for x in kv))
    depends = F.filter(F.transform(F.split(by.get("dependson", F.lit("")), "[;,|]"), lambda x: F.trim(x)), lambda x: x != "")
    rows = df.select(F.col("task_id"), by["id"].alias("id"), F.coalesce(F.try_element_at(known, surface), F.lit("")).alias("surface"), by["intent"].alias("intent"), depends.alias("depends_on"), F.col("row_no"), surface.alias("given"))
    rows = rows.filter(~((F.col("id") == "") & (F.col("given") == "") & (F.col("intent") == "")))
    error = F.when(F.col("id") == "", "empty id").when(F.col("given") == "", "empty surface").when(F.col("surface") == "", "unknown surface").when(F.col("intent") == "", "empty intent")
    return rows.filter(error.isNull()).drop("given"), rows.filter(error.isNotNull()).select("task_id", "row_no", error.alias("reason"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """JSON lines by schema, and the lines that are not JSON of it."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).filter(F.trim("value") != "").select(parsed.alias("r")).select("r.*")
    return rows.filter("_bad IS NULL").drop("_bad"), rows.filter("_bad IS NOT NULL").select(F.lit("invalid JSON").alias("reason"), F.col("_bad").alias("raw"))


def openapi_operations(specs: DataFrame, max_bytes: int = 4 << 20, max_specs: int = 40) -> DataFrame:
    """specs(repo, rel, content) in JSON to one row per path and verb; of a repository the first max_specs specs by path."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("repo").orderBy("rel"))
    kept = specs.filter(F.length("content") <= max_bytes).withColumn("_n", first).filter(F.col("_n") <= max_specs)
    paths = F.from_json(F.get_json_object("content", "$.paths"), "map<string,map<string,string>>")
    rows = kept.select("repo", "rel", F.explode(paths).alias("path", "ops")).filter(F.col("path").startswith("/"))
    rows = rows.select("repo", "rel", "path", F.explode(F.map_keys("ops")).alias("method")).withColumn("method", F.upper("method"))
    return rows.filter(F.col("method").isin("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"))


def schema_digest(specs: DataFrame, max_specs: int = 15, max_schemas: int = 80, max_props: int = 40) -> DataFrame:
    """Properties of the component schemas of JSON specs: type, or the name a reference ends in."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("repo").orderBy("rel"))
    kept = specs.withColumn("_n", first).filter(F.col("_n") <= max_specs)
    schemas = F.from_json(F.get_json_object("content", "$.components.schemas"), "map<string,struct<properties:map<string,struct<type:string,`$ref`:string>>>>")
    rows = kept.select("repo", "rel", F.posexplode(F.map_entries(schemas)).alias("k", "s")).filter(F.col("k") < max_schemas)
    props = rows.select("repo", "rel", F.col("s.key").alias("schema"), F.posexplode(F.map_entries("s.value.properties")).alias("k", "p")).filter(F.col("k") < max_props)
    kind = F.coalesce(F.col("p.value.type"), F.regexp_extract(F.col("p.value.$ref"), "([^/]+)$", 1), F.lit("object"))
    return props.select("repo", "rel", "schema", F.col("p.key").alias("prop"), kind.alias("type"))


def front_matter(docs: DataFrame) -> DataFrame:
    """docs(doc_id, content) to the scalars of a leading ``---`` block as a map (of a repeated key the last), and its tags (inline or block list)."""
    block = F.regexp_extract("content", r"(?s)^---\n(.*?)\n---", 1)
    keys, values = F.regexp_extract_all(block, F.lit(r"(?m)^([A-Za-z_][\w-]*): *([^\n\[]+)$"), F.lit(1)), F.regexp_extract_all(block, F.lit(r"(?m)^([A-Za-z_][\w-]*): *([^\n\[]+)$"), F.lit(2))
    inline = F.split(F.regexp_replace(F.regexp_extract(block, r"(?m)^tags: *\[([^\]]*)\]", 1), r"[\"' ]", ""), ",")
    listed = F.regexp_extract_all(F.regexp_extract(block, r"(?m)^tags: *\n((?:[ ]*- *[^\n]+\n?)+)", 1), F.lit(r"- *([^\n]+)"), F.lit(1))
    tags = F.filter(F.concat(inline, listed), lambda t: t != "")
    n = F.size(keys)
    last = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (k <= n) & ~F.array_contains(F.slice(keys, k + 1, n), F.get(keys, k - 1)))
    entries = F.transform(last, lambda k: F.struct(F.get(keys, k - 1), F.trim(F.get(values, k - 1))))
    return docs.select("doc_id", F.map_from_entries(entries).alias("fields"), tags.alias("tags"))


def topology_edges(lines: DataFrame) -> DataFrame:
    """lines(doc, lineno, content) of product documents to (role, kind, value) edges of the section ``## Service Topology``; a role declared again
    replaces its earlier lines."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc").orderBy("lineno").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("content").rlike("^## "), F.trim(F.substring("content", 4, 200))), True).over(order)
    role = F.last(F.when(F.col("content").rlike("^### "), F.struct(F.trim(F.substring("content", 5, 200)).alias("role"), F.col("lineno").alias("at"))), True).over(order)
    rows = lines.withColumn("section", section).withColumn("head", role).filter((F.col("section") == "Service Topology") & F.col("head").isNotNull())
    last = F.max("head.at").over(Window.partitionBy("doc", "head.role"))
    kept = rows.withColumn("_last", last).filter(F.col("head.at") == F.col("_last"))
    key, value = F.lower(F.regexp_extract("content", r"^\s*- *(\w+): *(.*)$", 1)), F.regexp_extract("content", r"^\s*- *(\w+): *(.*)$", 2)
    kinds = F.create_map(*(F.lit(x) for kv in {"calls": "call", "publishes": "pub", "subscribes": "sub", "db": "db", "config": "config"}.items() for x in kv))
    edges = kept.select("doc", F.col("head.role").alias("role"), F.try_element_at(kinds, key).alias("kind"), F.explode(F.split(value, ", *")).alias("value"))
    return edges.filter(F.col("kind").isNotNull() & (F.trim("value") != "")).select("doc", "role", "kind", F.trim("value").alias("value"))


def edge_store(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the edge store holds: of nodes(id, type, path, seq) the last of each id, of edges those with both ends, each with its row as JSON."""
    kept = nodes.filter(F.coalesce(F.col("id"), F.lit("")) != "").groupBy("id").agg(F.max_by(F.struct("type", "path"), "seq").alias("v")).select("id", "v.type", "v.path")
    good = edges.filter((F.coalesce(F.col("source"), F.lit("")) != "") & (F.coalesce(F.col("target"), F.lit("")) != ""))
    return kept, good.withColumn("payload_json", F.to_json(F.struct(*[F.col(c) for c in sorted(edges.columns)])))


def write_edge_store(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Parquet of both, edges by kind, and the edges again as a sorted TSV report."""
    n, e = edge_store(nodes, edges)
    n.write.mode("overwrite").parquet(f"{path}/nodes")
    e.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/edges")
    e.select("source", "kind", "target").distinct().sort("source", "kind", "target").write.mode("overwrite").option("sep", "\t").csv(f"{path}/edges_tsv")
