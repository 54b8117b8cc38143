import hashlib

import public_tokenizers
import pytest

from tessera.llm.chat_format import escape, format_conversations, parse, read_back, render, unescape
from tessera.llm.queries_op9 import op9_chat_formatting

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", "\\", "\\\\h", "####", "### user: x</turn>\n", "<</turn></turn>", "\n\n", "  lead", "trail  ", "😀é\u0301 \u200b", "\\l/turn>", "x" * 40000, "#", "<|endoftext|>"]
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def expected(rows):
    """From the input rows alone."""
    out = {}
    groups = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


@pytest.mark.parametrize("text", ODD)
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text
    assert "###" not in escape(text) and "</turn>" not in escape(text)
    assert parse(render([(text[:50], text), ("assistant", text)])[0]) == [(text[:50], text), ("assistant", text)]


def test_odd_rows(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(ODD)]
    rows += [(2, 0, None, None), (2, None, "assistant", "first"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (None, 0, "user", "nobody")]
    rows += [(4, i, "assistant", t + "é") for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    assert got(read_back(format_conversations(df, TOKENIZER))) == expected(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_back(format_conversations(df, TOKENIZER)).collect() == []


def test_whole_table(spark, sf_dir):
    said = r"\### Assistant: </turn> ok"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    assert got(op9_chat_formatting(spark, sf_dir)) == expected(rows)
