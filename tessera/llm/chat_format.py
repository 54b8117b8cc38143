"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the sorted spans of the turns that carry loss are intersected with the
token spans by binary search. A token on the border of a span counts with its part inside the span.

Template of a turn: ``### <role>: <text></turn>\\n``. Inside a role or text a backslash becomes ``\\\\``, each ``#`` that opens ``###`` becomes
``\\h``, the ``<`` of ``</turn>`` becomes ``\\l``, and inside a role a ``:`` becomes ``\\c``; so an unescaped mark is always the template's own.

Defined results: null text and null role are empty strings; turns are ordered by (turn, role, text), a null turn first; repeated rows stay, as
turns of their own; rows of a null conv_id make one conversation; an empty table gives no rows; other columns are ignored. One conversation is
one sequence for the encoder, so it is held by one task; its size is that of one training example, not of the table.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</turn>"
_OUT = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
_BACK = {"\\": "\\", "h": "#", "l": "<", "c": ":"}
_IN_TEXT = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_IN_ROLE = re.compile(r"\\|#(?=##)|<(?=/turn>)|:")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, pattern: re.Pattern = _IN_TEXT) -> str:
    return pattern.sub(lambda m: _OUT[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the character spans of the texts that carry loss."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role, _IN_ROLE)}: ", escape(text)
        if role == loss_role and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns = []
    for part in formatted.split(f"{END}\n")[:-1]:
        role, text = part.removeprefix("### ").split(": ", 1)
        turns.append((unescape(role), unescape(text)))
    return turns


def intersect(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, from, to) of each part of a token inside a span; spans and tokens are sorted. Tokens that share a character (bytes of one code point)
    count it once, with the first of them."""
    tok, lo, hi = [], [], []
    for a, b in spans:
        i, j = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")
        s, e = np.clip(starts[i:j], a, b), np.clip(ends[i:j], a, b)
        s = np.maximum(s, np.maximum.accumulate(np.concatenate([[a], e[:-1]]))) if len(s) else s
        keep = s < e
        tok.append(np.arange(i, j)[keep]), lo.append(s[keep]), hi.append(e[keep])
    cat = lambda x: np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32)
    return cat(tok), cat(lo), cat(hi)


FORMATTED = (
    "conv_id long, formatted string, token_ids array<int>, token_start array<int>, token_end array<int>, loss_token array<int>, loss_start array<int>, loss_end array<int>"
)


def format_conversations(rows: DataFrame, tokenizer: str, loss_role: str = "assistant") -> DataFrame:
    """rows(conv_id, turn, role, text) to one row per conversation: its text, its tokens with offsets, and the parts of tokens that carry loss."""
    turns = (
        rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(tokenizer)
        encoder.encode_special_tokens = True
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [render([(t["role"], t["text"]) for t in turns], loss_role) for turns in part.column(1).to_pylist()]
                cols: list[list] = [[] for _ in range(7)]
                codes = encoder.encode_batch([text for text, _ in made], add_special_tokens=False)
                for (text, spans), code in zip(made, codes, strict=True):
                    offsets = np.array(code.offsets, np.int32).reshape(-1, 2)
                    for col, value in zip(cols, (text, code.ids, offsets[:, 0], offsets[:, 1], *intersect(spans, offsets[:, 0], offsets[:, 1])), strict=True):
                        col.append(value)
                ints = pa.list_(pa.int32())
                yield pa.record_batch([part.column(0), pa.array(cols[0], pa.string()), *(pa.array(c, ints) for c in cols[1:])], names=[x.split()[0] for x in FORMATTED.split(", ")])

    return turns.mapInArrow(work, FORMATTED)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def _rows(lists: pa.ListArray) -> Callable[[int], np.ndarray]:
    """The numbers of a row of a list column."""
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return lambda k: values[ends[k] : ends[k + 1]]


def joined(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Parts that follow each other without a gap as one."""
    if not len(starts):
        return []
    gap = np.flatnonzero(starts[1:] != ends[:-1])
    return list(zip(starts[np.append(0, gap + 1)].tolist(), ends[np.append(gap, len(ends) - 1)].tolist(), strict=True))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, read from the output of format_conversations alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            ids, tokens, starts, ends = (_rows(batch.column(k)) for k in (2, 5, 6, 7))
            for k, (conv, text) in enumerate(zip(batch.column(0).to_pylist(), texts, strict=True)):
                turns = parse(text)
                loss = unescape("".join(text[a:b] for a, b in joined(starts(k), ends(k))))
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
                out.append((conv, len(turns), sha(said), len(loss), sha(loss), len(text), len(ids(k)), len(np.unique(tokens(k)))))
            names = [x.split() for x in READ.split(", ")]
            kinds = {"long": pa.int64(), "string": pa.string()}
            yield pa.record_batch([pa.array([r[i] for r in out], kinds[k]) for i, (_, k) in enumerate(names)], names=[n for n, _ in names])

    return formatted.mapInArrow(work, READ)
