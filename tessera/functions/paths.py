"""Column expressions on paths, names and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(rel: Column) -> Column:
    return F.regexp_extract(rel, "([^/]*)$", 1)


def extension(rel: Column) -> Column:
    """Last suffix of the name with its dot, lower-case; empty without one."""
    return F.lower(F.regexp_extract(base_name(rel), r"(\.[^.]*)$", 1))


def stem(rel: Column) -> Column:
    return F.regexp_replace(base_name(rel), r"(.)\.[^.]*$", "$1")


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def module_id(repo: Column, rel: Column) -> Column:
    """Repository and slug of the directory."""
    return F.concat(repo, F.lit("-"), slug(F.regexp_replace(rel, "/?[^/]*$", "")))


def insight_slug(text: Column) -> Column:
    return F.substring(slug(text), 1, 40)


def normalize_header(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def fold_path(path: Column) -> Column:
    """Path without ``.`` and ``..`` parts; a ``..`` at the root is dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.expr("cast(array() as array<string>)")
    folded = F.aggregate(parts, empty, lambda acc, p: F.when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(folded, "/")


def resolve_relative(source: Column, spec: Column) -> Column:
    """Path a relative import means, from the importing file; null for others."""
    parent = F.regexp_replace(source, "/?[^/]*$", "")
    return F.when(spec.startswith("/"), F.regexp_replace(spec, "^/+", "")).when(spec.startswith("."), F.nullif(fold_path(F.concat_ws("/", parent, spec)), F.lit("")))


def normalize_route(path: Column) -> Column:
    """Leading slash, no doubled and no trailing one; empty stays empty."""
    p = F.trim(F.coalesce(path, F.lit("")))
    led = F.regexp_replace(F.concat(F.lit("/"), p), "/{2,}", "/")
    return F.when(p == "", "").otherwise(F.when(F.length(led) > 1, F.regexp_replace(led, "/$", "")).otherwise(led))


def join_route(prefix: Column, path: Column) -> Column:
    a, b = normalize_route(prefix), normalize_route(path)
    return F.when(a == "", b).when(b.isin("", "/"), a).otherwise(normalize_route(F.concat(a, b)))


def without_query(url: Column) -> Column:
    return F.trim(F.regexp_extract(url, "^([^?#]*)", 1))


def canonical_path(path: Column) -> Column:
    """One spelling per functional route: no query, single slashes, ``/api`` before a version dropped."""
    p = without_query(path)
    p = F.regexp_replace(F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)), "/{2,}", "/")
    p = F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)
    return F.when(p.startswith("/api/v"), F.substring(p, 5, 1 << 20)).otherwise(p)


def url_aliases(url: Column) -> Column:
    """A URL path, its twin with or without ``/api`` before a version, and their canonical forms."""
    b = without_query(url)
    twin = F.when(b.startswith("/v"), F.concat(F.lit("/api"), b)).when(b.startswith("/api/v"), F.substring(b, 5, 1 << 20))
    both = F.transform(F.array_compact(F.array(b, twin)), lambda x: F.regexp_replace(x, "/{2,}", "/"))
    none = F.expr("cast(array() as array<string>)")
    return F.when(b.startswith("/"), F.array_distinct(F.flatten(F.transform(both, lambda x: F.array(x, canonical_path(x)))))).otherwise(none)


def is_api_path(url: Column) -> Column:
    """Whether a path looks like an API's: API, internal, GraphQL or version prefix, without template marks, not under a low-signal root."""
    low = url.rlike(r"^/(dev|proc|tmp|home|dist|debug|validator)(/|$)")
    return url.startswith("/") & (F.length(url) >= 3) & ~url.contains("${") & ~(url.contains("{") & url.contains("}")) & ~low & url.rlike(r"^/(api/|internal/|graphql|v[0-9]+([./]|$))")


def safe_relpath(path: Column) -> Column:
    """Whether a path stays within its folder: relative, no ``..`` part, no backslash."""
    return path.isNotNull() & ~path.rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)") & (path != "")


def pct_delta(now: Column, base: Column) -> Column:
    """Change in percent, null on a zero or missing base."""
    return F.when(base != 0, (now - base) / base * 100)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def safe_task_id(task_id: Column) -> Column:
    """A task id that can be part of a path, without spaces at its ends; null for any other (a separator, ``..``, a leading sign, an empty one)."""
    value = F.trim(task_id)
    return F.when(value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*\z") & ~F.contains(value, F.lit("..")), value)


def substrings(text: Column, lengths: Column, start: str = "") -> Column:
    """Distinct substrings of the text that have one of the lengths and start with the given character (by default any)."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda k: (F.substring(text, k, F.lit(1)) == start) if start else F.length(text) > 0)
    of_length = lambda n: F.transform(F.filter(places, lambda k: k + n - 1 <= F.length(text)), lambda k: F.substring(text, k, n))
    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))
