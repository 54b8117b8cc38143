"""Many patterns at once: an automaton over the literals that patterns require finds which patterns a line can match, and only those are tried on it.

Rules are a DataFrame (rule, pattern) of any size. A block of counted rules is broadcast and built into one Aho-Corasick automaton per worker; more rules
than a block holds go round in further blocks. A rule whose pattern requires no literal is tried on every line; ``literals`` says which those are."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import written

BLOCK = 50_000
_OPTIONAL = ("?", "*", "{")


def literals(pattern: str) -> list[str] | None:
    """Lower-cased literals of which every match of a pattern holds at least one; None where the pattern requires none that this reads.

    Read are plain and escaped characters, groups and alternatives; what may be left out (``?``, ``*``, ``{``), classes and lookarounds count as nothing."""
    found, end = _alternatives(pattern, 0)
    return sorted(found) if found and end == len(pattern) else None


def _alternatives(p: str, i: int) -> tuple[set[str] | None, int]:
    branches = []
    while True:
        got, i = _sequence(p, i)
        branches.append(got)
        if i < len(p) and p[i] == "|":
            i += 1
            continue
        return (None if any(b is None for b in branches) else set().union(*branches)), i


def _sequence(p: str, i: int) -> tuple[set[str] | None, int]:
    """The best literals of a run of items up to ``|``, ``)`` or the end."""
    best: list[set[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if run:
            best.append({run.lower()})
        run = ""

    while i < len(p) and p[i] not in "|)":
        c, group = p[i], None
        if c == "\\" and i + 1 < len(p):
            char = p[i + 1] if not p[i + 1].isalnum() else None
            i += 2
        elif c == "[":
            close_at = i + (2 if p[i + 1 : i + 2] != "^" else 3)  # a bracket first in a class is a member
            while close_at < len(p) and p[close_at] != "]":
                close_at += 2 if p[close_at] == "\\" else 1
            char, i = None, close_at + 1
        elif c == "(":
            j = i + 1
            look = p.startswith(("?=", "?!", "?<=", "?<!"), j)
            if p[j : j + 1] == "?":
                while j < len(p) and p[j] not in ":)=!>":
                    j += 1
                if p[j : j + 1] == ")":  # flags
                    i, char = j + 1, None
                    close()
                    continue
                j += 1
            group, j = _alternatives(p, j)
            group, char, i = (None if look else group), None, j + 1
        else:
            char, i = (None if c in ".^$+*?{}" else c), i + 1
        optional = i < len(p) and p[i] in _OPTIONAL
        if char is None or optional:
            close()
            if group and not optional:
                best.append(group)
        else:
            run += char
        if i < len(p) and p[i] in "?*+{":
            close()
            i = p.index("}", i) + 1 if p[i] == "{" and "}" in p[i:] else i + 1
            while i < len(p) and p[i] in "?+":
                i += 1
    close()
    return max(best, key=lambda s: min(map(len, s)), default=None), i


class Automaton:
    """Which of the words stand in a text."""

    def __init__(self, words: list[str]):
        import ahocorasick

        self.of = ahocorasick.Automaton()
        for i, w in enumerate(words):
            self.of.add_word(w, i)
        if words:
            self.of.make_automaton()
        self.empty = not words

    def found(self, text: str) -> set[int]:
        return set() if self.empty else {i for _, i in self.of.iter(text)}


@lru_cache(4)
def _built(number: int, words: tuple[str, ...]) -> Automaton:
    return Automaton(list(words))


def automaton(held: Broadcast) -> Automaton:
    """The automaton of a broadcast tuple of words, built once in each worker."""
    return _built(held.id if hasattr(held, "id") else hash(held.value), held.value)


def blocks(rules: DataFrame, column: str, block: int = BLOCK) -> Iterator[list]:
    """The distinct values of a column in blocks of about ``block``, one at a time."""
    kinds = written(rules.select(column).filter(F.col(column).isNotNull()).distinct(), "kinds")
    of = max(1, -(-kinds.count() // block))
    for k in range(of):
        yield [r[0] for r in (kinds if of == 1 else kinds.filter(F.pmod(F.xxhash64(column), F.lit(of)) == k)).collect()]


def matching(lines: DataFrame, rules: DataFrame, text: str = "content", block: int = BLOCK) -> DataFrame:
    """lines with each rule(rule, pattern) that matches: their columns, rule and pattern. One row per line and rule; null texts match nothing."""
    spark, out, rules = lines.sparkSession, None, rules.select("rule", "pattern").distinct()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema) + ", pattern string"
    at = lines.columns.index(text)
    for patterns in blocks(rules, "pattern", block):
        by_word: dict[str, list[int]] = {}
        always = []
        for i, p in enumerate(patterns):
            need = literals(p)
            always += [i] if need is None else []
            for w in need or ():
                by_word.setdefault(w, []).append(i)
        words = tuple(by_word)
        held, told = spark.sparkContext.broadcast(words), spark.sparkContext.broadcast((patterns, list(by_word.values()), always))

        def work(batches: Iterator[pa.RecordBatch], held=held, told=told) -> Iterator[pa.RecordBatch]:
            of, (patterns, rules_of, always) = automaton(held), told.value
            for batch in batches:
                rows, names = [], []
                for k, said in enumerate(batch.column(at).to_pylist()):
                    if said is not None:
                        may = {i for w in of.found(said.lower()) for i in rules_of[w]}.union(always)
                        rows += [k] * len(may)
                        names += [patterns[i] for i in sorted(may)]
                yield pa.record_batch([*batch.take(pa.array(rows, pa.int64())).columns, pa.array(names, pa.string())], names=[*batch.schema.names, "pattern"])

        may = lines.mapInArrow(work, schema).filter(F.expr(f"`{text}` RLIKE pattern"))
        out = may if out is None else out.unionByName(may)
    return out.join(rules, "pattern").select(*lines.columns, "rule", "pattern")


def starts_of(words: DataFrame, column: str) -> DataFrame:
    """(start, sizes): the lengths of the words by their first two characters, all digits as 0. Few rows, however many words there are."""
    start = F.translate(F.substring(column, 1, 2), "123456789", "000000000")
    return words.filter(F.col(column) != "").groupBy(start.alias("start")).agg(F.sort_array(F.collect_set(F.length(column))).alias("sizes"))


def may_occur(lines: DataFrame, words: DataFrame, text: str, column: str) -> DataFrame:
    """lines with each substring of their text that starts and is as long as some value of words(column), and how often it stands there, counted without
    overlaps: column and ``times_found``. A line is read once, whatever the number of words; the caller joins the words."""
    spark = lines.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema) + f", `{column}` string, times_found long"
    at = lines.columns.index(text)
    held = spark.sparkContext.broadcast({r["start"]: r["sizes"] for r in starts_of(words, column).collect()})
    zeros = str.maketrans("123456789", "000000000")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = held.value
        for batch in batches:
            rows, names, times = [], [], []
            for k, said in enumerate(batch.column(at).to_pylist()):
                if said:
                    seen, shape, end = set(), said.translate(zeros), len(said)
                    for i in range(end):
                        for start in {shape[i : i + 1], shape[i : i + 2]}:
                            seen.update(said[i : i + n] for n in sizes.get(start, ()) if i + n <= end)
                    rows += [k] * len(seen)
                    names += seen
                    times += [said.count(w) for w in seen]
            yield pa.record_batch([*batch.take(pa.array(rows, pa.int64())).columns, pa.array(names, pa.string()), pa.array(times, pa.int64())], names=[*batch.schema.names, column, "times_found"])

    return lines.mapInArrow(work, schema)


def occurrences(lines: DataFrame, words: DataFrame, text: str, column: str) -> DataFrame:
    """lines with each of the distinct values of words(column) that stands in their text, and how often, counted without overlaps: column and ``times_found``."""
    return may_occur(lines, words, text, column).join(words.select(column).distinct(), column, "left_semi").select(*lines.columns, column, "times_found")
