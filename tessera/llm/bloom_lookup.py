"""Document fingerprints as invertible Bloom lookup tables, in DataFrame and SQL functions only.

A text is cut into paragraphs (its lines, a longer one into runs of at most ``run`` characters); the 64-bit digests of the distinct ones are the keys of
the table. Each key goes into one cell of each of three parts; a cell holds how many keys it got, their XOR, and the XOR of their check values. Two
tables subtract cell by cell, which leaves only the keys that one of the texts lacks, and peeling recovers those: a cell with one key gives it away, its
removal from the other parts frees further cells. If cells remain, the differing keys were too many, and the comparison is retried with larger tables: a
table of ``cells`` cells for every eight keys of the two texts, chosen by digest, and where one of those fails, one four times and one sixteen times as
large. The last resort for such a group is the difference of its key lists themselves; ``listed_groups`` says how many groups came to that.

Likeness of two texts is the share of their distinct paragraphs that both hold; of two texts without paragraphs it is 1.

Defined results: null text is empty; the next document is that with the next smaller id, and after the smallest comes the largest (a null id is below
all others); of rows that repeat an id each is a row of the result, and the one with the least text is that id's document to the one before; a
single document is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEAST = -(1 << 63)
_NO_KEYS = "cast(array() as array<struct<c:int,k:bigint>>)"


def paragraphs(text: Column, run: int) -> Column:
    """Digests of the distinct paragraphs of a text."""
    return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(f"[^\n]{{1,{run}}}"), F.lit(0))), lambda p: F.xxhash64(p))


def table_sql(keys: str, cells: int) -> str:
    """A table of the keys: cells with the number c, XOR k and check XOR h of their keys."""
    third = cells // 3
    part = "transform(sequence(0L, {top}L), i -> aggregate(filter({keys}, x -> (shiftright(x, {shift}) & {top}L) = i), named_struct('c', 0, 'k', 0L, 'h', 0), (a, x) -> named_struct('c', a.c + 1, 'k', a.k ^ x, 'h', a.h ^ hash(x))))"
    return "concat(" + ", ".join(part.format(top=third - 1, keys=keys, shift=16 * t) for t in range(3)) + ")"


def subtract_sql(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('c', x.c - y.c, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"


def peel_sql(difference: str, cells: int, rounds: int = 14) -> str:
    """What peeling recovers: numbers of keys only in the first (p) and only in the second (m), and whether no cell is left (ok)."""
    third = cells // 3
    within = f"(shiftright(y.k, 16 * cast(i div {third} as int)) & {third - 1}L) = i % {third}"
    state = "named_struct('t', {t}, 'f', {f}, 'p', {p}, 'm', {m}, 'go', {go})"
    found = "array_distinct(transform(filter(s.t, x -> abs(x.c) = 1 AND x.h = hash(x.k)), x -> named_struct('c', x.c, 'k', x.k)))"
    left = f"transform(s.t, (x, i) -> aggregate(filter(s.f, y -> {within}), x, (a, y) -> named_struct('c', a.c - y.c, 'k', a.k ^ y.k, 'h', a.h ^ hash(y.k))))"
    search = state.format(t="s.t", f=found, p="s.p", m="s.m", go="true")
    remove = state.format(t=left, f=_NO_KEYS, p="s.p + size(filter(s.f, y -> y.c = 1))", m="s.m + size(filter(s.f, y -> y.c = -1))", go="true")
    stop = state.format(t="s.t", f="s.f", p="s.p", m="s.m", go="false")
    start = state.format(t=difference, f=_NO_KEYS, p="0", m="0", go="true")
    step = f"CASE WHEN NOT s.go THEN s WHEN r % 2 = 1 THEN {search} WHEN size(s.f) = 0 THEN {stop} ELSE {remove} END"
    return f"aggregate(sequence(1, {2 * rounds}), {start}, (s, r) -> {step}, s -> named_struct('p', s.p, 'm', s.m, 'ok', NOT exists(s.t, x -> x.c <> 0 OR x.k <> 0L)))"


def bind_sql(value: str, name: str, body: str) -> str:
    """body with the value worked out once under the name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def retried_sql(a: str, b: str, cells: int) -> str:
    """The same over tables that grow with the texts: one for every eight keys; a group that fails is retried four and sixteen times larger, and counted (x)
    where its key lists had to be compared. Keys are dealt to about as many parts as each part has groups, so that no key is looked at once per group."""
    exact = "named_struct('p', size(array_except(ga, gb)), 'm', size(array_except(gb, ga)), 'x', 1L)"
    for larger in (16, 4, 1):
        n = larger * cells
        once = peel_sql(subtract_sql(table_sql("ga", n), table_sql("gb", n)), n)
        exact = bind_sql(once, f"o{larger}", f"CASE WHEN o{larger}.ok THEN named_struct('p', o{larger}.p, 'm', o{larger}.m, 'x', 0L) ELSE {exact} END")
    total = "aggregate({rows}, named_struct('p', 0, 'm', 0, 'x', 0L), (s, x) -> named_struct('p', s.p + x.p, 'm', s.m + x.m, 'x', s.x + x.x))"
    half = "greatest(1L, cast(ceil({power}((size({a}) + size({b})) / 8.0D)) as bigint))"
    of = lambda keys, seed, n, i: f"filter({keys}, x -> pmod(xxhash64(x, {seed}), {n}) = {i})"
    group = bind_sql(of("pa", 2, "gn", "g"), "ga", bind_sql(of("pb", 2, "gn", "g"), "gb", exact))
    part = bind_sql(half.format(power="", a="pa", b="pb"), "gn", total.format(rows=f"transform(sequence(0L, gn - 1), g -> {group})"))
    part = bind_sql(of(a, 1, "pn", "i"), "pa", bind_sql(of(b, 1, "pn", "i"), "pb", part))
    return bind_sql(half.format(power="sqrt", a=a, b=b), "pn", total.format(rows=f"transform(sequence(0L, pn - 1), i -> {part})"))


def compared(a_table: str, b_table: str, a: str, b: str, cells: int) -> Column:
    """Likeness of two texts, and for how many groups of keys no table sufficed."""
    first = peel_sql(subtract_sql(a_table, b_table), cells)
    got = bind_sql(first, "q", f"CASE WHEN q.ok THEN named_struct('p', q.p, 'm', q.m, 'x', 0L) ELSE {retried_sql(a, b, cells)} END")
    share = f"CASE WHEN size({a}) + w.m = 0 THEN 1.0D ELSE cast(size({a}) - w.p as double) / (size({a}) + w.m) END"
    return F.expr(bind_sql(got, "w", f"named_struct('likeness', {share}, 'listed', w.x)"))


def fingerprint(table: str) -> Column:
    """A table as text: number, key XOR and check XOR of each cell in hexadecimal."""
    return F.expr(f"array_join(transform({table}, x -> concat(hex(x.c), ':', lpad(hex(x.k), 16, '0'), lpad(hex(x.h & 4294967295L), 8, '0'))), '.')")


def successors(docs: DataFrame, per_bucket: int = 100_000) -> DataFrame:
    """docs(oid, n) to one row per distinct id: oid, its longest n, and next_oid in descending order, the largest after the smallest. Ids are dealt to ranges
    of like numbers of ids, ordered within these, and the ranges by their ends."""
    ids = docs.groupBy("oid").agg(F.max("n").alias("n"))
    high, rows = docs.agg(F.max("oid"), F.count("*")).first()
    if not rows:
        return ids.withColumn("next_oid", F.col("oid"))
    ids = written(ids.repartitionByRange(-(-rows // per_bucket), "oid").withColumn("bucket", F.spark_partition_id()), "id-ranges")
    ends = ids.groupBy("bucket").agg(F.max("oid").alias("top"))
    below = ends.select("bucket", F.lag("top").over(Window.orderBy("bucket")).alias("below"))  # a row per bucket
    within = F.lead("oid").over(Window.partitionBy("bucket").orderBy(F.desc("oid")))
    return ids.withColumn("inner", within).join(below, "bucket").select("oid", "n", F.coalesce("inner", "below", F.lit(int(high))).alias("next_oid"))


def fingerprints(docs: DataFrame, run: int = 256, cells: int = 24) -> DataFrame:
    """docs(doc_id, text) to fingerprints of each text and of its edited text (the last third replaced by the start of the next document), and their
    likeness, and that to the next document."""
    text = F.coalesce("text", F.lit(""))
    # Two columns and no more: then both sides of the join below read one exchange.
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("oid"), text.alias("text"))
    order = successors(base.select("oid", F.length("text").cast("long").alias("n")))
    # A running sum, not row_number, and the plain text: else Spark limits groups or adds a column ahead of the exchange, which makes it another one.
    one = F.sum(F.lit(1)).over(Window.partitionBy("oid").orderBy("text").rowsBetween(Window.unboundedPreceding, 0))
    given = order.select(F.col("next_oid").alias("oid"), F.col("oid").alias("to"), F.col("n").alias("to_n"))
    gift = base.withColumn("_one", one).filter("_one = 1").join(given, "oid")
    gift = gift.select(F.col("to").alias("oid"), F.expr("substring(text, 1, cast(floor(to_n / 3) as int))").alias("head"), paragraphs(F.col("text"), run).alias("next_keys"))
    both = base.join(gift, "oid").withColumn("doc_id", F.when(F.col("oid") != LEAST, F.col("oid"))).withColumn("n", F.length("text").cast("long"))
    third = "cast(floor(n / 3) as int)"
    edited = both.select("doc_id", "n", "text", F.expr(f"concat(substring(text, 1, cast(n as int) - {third}), substring(head, 1, {third}))").alias("edited"), "next_keys")
    keyed = edited.select("doc_id", "n", F.sha2("edited", 256).alias("edited_sha256"), paragraphs(F.col("text"), run).alias("keys"), paragraphs(F.col("edited"), run).alias("edited_keys"), "next_keys")
    tabled = keyed.select("*", *(F.expr(table_sql(k, cells)).alias(t) for k, t in (("keys", "tab"), ("edited_keys", "edited_tab"), ("next_keys", "next_tab"))))
    names = ["doc_id", "n", "edited_sha256", "tab", "edited_tab"]
    done = tabled.select(*names, compared("tab", "edited_tab", "keys", "edited_keys", cells).alias("to_edited"), compared("tab", "next_tab", "keys", "next_keys", cells).alias("to_next"))
    return done.select(
        "doc_id",
        F.col("n").alias("n_chars"),
        "edited_sha256",
        fingerprint("tab").alias("fingerprint"),
        fingerprint("edited_tab").alias("edited_fingerprint"),
        F.col("to_edited.likeness").alias("near_edited"),
        F.col("to_next.likeness").alias("near_next"),
        (F.col("to_edited.listed") + F.col("to_next.listed")).alias("listed_groups"),
    )
