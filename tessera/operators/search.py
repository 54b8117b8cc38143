"""Positional full-text index, and phrase, prefix and boolean search in it.

``write_positions`` writes a row per term and block of documents: the documents, term counts, lengths and positions, and the greatest count and least length
among them. A block is a hash range of documents of bounded size, the same for all terms, so a common term is as many rows as there are blocks, each in a
file of its own; files are sorted by term, so words and prefixes are ranges of rows in them.

``search_positions`` reads a query as words (all must occur), ``"a phrase"``, ``prefix*``, ``AND``, ``OR``, ``NOT`` and parentheses; words side by side
bind closest, then NOT, AND, OR. A document scores the sum of BM25 parts of the query's phrases it holds (a word is a phrase of one), as often as a phrase
stands there; idf is floored at 1e-6, ties go to the smaller id. Where the query has words alone, blocks whose best possible sum lies below the k-th
score of the most promising blocks are not read further.

Defined results: null and empty texts hold nothing; rows that repeat a doc_id are one document that holds the words of all; a query without a word, or NOT
alone, is an error; an empty index gives no rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import written
from .docs import tokens

_TOKEN = re.compile(r'"([^"]*)"\s*(\*?)|([()])|([^\s()"]+)')


def parse(query: str) -> tuple[tuple, list[tuple[tuple[str, ...], bool]]]:
    """The query as a tree of (op, ...) over numbers of phrases, and the phrases: their words, and whether the last is a prefix."""
    parts, phrases = [], []
    for said, star, paren, word in _TOKEN.findall(query):
        if paren or word in ("AND", "OR", "NOT"):
            parts.append(paren or word)
            continue
        text = word or said
        words = tuple(w for w in re.split(r"[\W_]+", text.lower()) if w)
        if words:
            phrases.append((words, bool(star) or (bool(word) and word.endswith("*"))))
            parts.append(len(phrases) - 1)
    at = 0

    def peek():
        return parts[at] if at < len(parts) else None

    def take():
        nonlocal at
        at += 1
        return parts[at - 1]

    def atom() -> tuple:
        if peek() == "(":
            take()
            inner = level(0)
            if peek() != ")":
                raise ValueError(f"unclosed parenthesis in {query!r}")
            take()
            return inner
        if not isinstance(peek(), int):
            raise ValueError(f"a phrase was expected in {query!r}")
        return ("is", take())

    def level(k: int) -> tuple:
        if k == 3:
            out = atom()
            while isinstance(peek(), int) or peek() == "(":
                out = ("AND", out, atom())
            return out
        out = level(k + 1)
        while peek() == ("OR", "AND", "NOT")[k]:
            out = (take(), out, level(k + 1))
        return out

    tree = level(0)
    if at < len(parts):
        raise ValueError(f"{peek()!r} stands alone in {query!r}")
    return tree, phrases


def _holds(tree: tuple, has) -> Column:
    op, *rest = tree
    if op == "is":
        return has(rest[0])
    a, b = (_holds(t, has) for t in rest)
    return a | b if op == "OR" else a & ~b if op == "NOT" else a & b


def write_positions(docs: DataFrame, path: str, block_docs: int = 4096, files: int = 64) -> None:
    """docs(doc_id, text) as a positional index under a path, of at least ``files`` blocks.

    What is shuffled are the texts, once, to the task of their block; terms are gathered there, and each task writes its own file."""
    words = tokens(F.coalesce("text", F.lit("")))
    sizes = docs.select("doc_id", F.size(words).alias("len")).groupBy("doc_id").agg(F.sum("len").alias("len"))
    totals = sizes.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"))
    totals.write.mode("overwrite").parquet(f"{path}/totals")
    blocks = max(files, -(-docs.sparkSession.read.parquet(f"{path}/totals").first()["n_docs"] // block_docs))
    placed = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")).repartitionById(blocks, "block")
    rows = placed.select("block", "doc_id", words.alias("t")).groupBy("block", "doc_id").agg(F.flatten(F.array_sort(F.collect_list("t"))).alias("t")).withColumn("len", F.size("t").cast("long"))
    rows = rows.select("block", "doc_id", "len", F.posexplode("t").alias("pos", "term")).groupBy("block", "term", "doc_id", "len").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    held = F.array_sort(F.collect_list(F.struct("doc_id", "len", "positions")))  # of one term in one block of documents
    rows = rows.groupBy("block", "term").agg(held.alias("docs"), F.max(F.size("positions")).alias("max_tf"), F.min("len").alias("min_len"), F.count("*").alias("n"))
    rows.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")


def _postings(path: str, spark, words: tuple[str, ...], prefix: bool) -> DataFrame:
    """Rows of the words of a phrase with their places in it (k); the last may be a prefix."""
    every, out = spark.read.parquet(f"{path}/postings"), None
    for k, w in enumerate(words):
        term = F.col("term")
        rows = every.filter((term >= w) & term.startswith(w) if prefix and k == len(words) - 1 else term == w).withColumn("k", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out


def phrase_hits(path: str, spark, words: tuple[str, ...], prefix: bool, blocks: DataFrame | None = None) -> DataFrame:
    """(doc_id, len, tf, pos): how often a phrase stands in a document, and where first: positions less their offsets meet where all words stand."""
    rows = _postings(path, spark, words, prefix)
    if blocks is not None:
        rows = rows.join(blocks.select("block"), "block", "left_semi")
    rows = rows.select("k", F.explode("docs").alias("d"))
    if len(words) == 1 and not prefix:
        return rows.select("d.doc_id", "d.len", F.size("d.positions").cast("long").alias("tf"), F.element_at("d.positions", 1).alias("pos"))
    starts = rows.select("d.doc_id", "d.len", "k", F.explode("d.positions").alias("p")).select("doc_id", "len", "k", (F.col("p") - F.col("k")).alias("pos"))
    whole = starts.groupBy("doc_id", "len", "pos").agg(F.count_distinct("k").alias("n")).filter(F.col("n") == len(words))
    return whole.groupBy("doc_id", "len").agg(F.count("*").alias("tf"), F.min("pos").alias("pos"))


def search_positions(path: str, docs: DataFrame, query: str, k: int = 20, k1: float = 1.2, b: float = 0.75, first_blocks: int = 8) -> DataFrame:
    """The best k documents for a query: doc_id, score, and a snippet of eight words from the first hit."""
    spark, (tree, phrases) = docs.sparkSession, parse(query)
    totals = spark.read.parquet(f"{path}/totals").first()
    n_docs, avg_len = totals["n_docs"], totals["avg_len"] or 1.0
    part = lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))
    idf = lambda df: F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    plain = all(len(w) == 1 and not prefix for w, prefix in phrases)

    def scored(blocks: DataFrame | None) -> DataFrame:
        out = None
        for i, (words, prefix) in enumerate(phrases):
            hits = phrase_hits(path, spark, words, prefix, blocks)
            hits = hits if plain else written(hits, "hits")
            hits = hits.crossJoin(F.broadcast(dfs[i] if plain else hits.agg(F.count("*").alias("df"))))  # one row
            hits = hits.select("doc_id", F.lit(i).alias("phrase"), "pos", (idf(F.col("df")) * part(F.col("tf"), F.col("len"))).alias("score"))
            out = hits if out is None else out.unionByName(hits)
        found = out.groupBy("doc_id").agg(F.collect_set("phrase").alias("held"), F.sum("score").alias("score"), F.min("pos").alias("pos"))
        return found.filter(_holds(tree, lambda i: F.array_contains("held", i))).select("doc_id", F.round("score", 9).alias("score"), "pos")

    blocks = None
    if plain:
        meta = spark.read.parquet(f"{path}/postings").select("term", "block", "max_tf", "min_len", "n")
        of = [meta.filter(F.col("term") == w[0]) for w, _ in phrases]
        dfs = [m.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("df")) for m in of]
        bounds = None
        for i, m in enumerate(of):
            rows = m.crossJoin(F.broadcast(dfs[i])).select("block", F.lit(i).alias("phrase"), (idf(F.col("df")) * part(F.col("max_tf"), F.col("min_len"))).alias("most"))
            bounds = rows if bounds is None else bounds.unionByName(rows)
        bounds = written(bounds.groupBy("block").agg(F.sum("most").alias("most")), "bounds")
        best = bounds.orderBy(F.desc("most"), "block").limit(first_blocks)
        kth = scored(best).orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("score"), F.count("*").alias("n")).first()
        blocks = bounds.filter(F.col("most") >= kth["score"] - 1e-6) if kth["n"] == k else bounds
    top = scored(blocks).orderBy(F.desc("score"), "doc_id").limit(k)
    told = Window.partitionBy("doc_id").orderBy(F.desc(F.length("text")), "text")
    texts = docs.select("doc_id", "text").join(F.broadcast(top), "doc_id").withColumn("_r", F.row_number().over(told)).filter("_r = 1")  # k documents
    exact, starts = [w for words, p in phrases for w in (words[:-1] if p else words)], [words[-1] for words, p in phrases if p]
    mark = lambda w: w.isin(*exact) if not starts else w.isin(*exact) | F.array_contains(F.array(*[w.startswith(s) for s in starts]), True)
    marked = F.transform(F.slice(tokens(F.col("text")), F.col("pos") + 1, F.lit(8)), lambda w: F.when(mark(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return texts.select("doc_id", F.round("score", 6).alias("score"), F.array_join(marked, " ").alias("snippet"))
