"""Quality: attention-based multiple-instance learning with gated attention.

A document is a bag of passages of so many words. Every passage of the whole text becomes a vector of frequencies of adjacent character classes and of
how often a word repeats one of those shortly before it; an encoder maps it to a hidden vector, gated attention (a tanh branch times a sigmoid branch)
weighs the passages against each other, and a linear layer scores their weighted mean. All weights are learnt together from document labels, on at most
``sample`` labelled rows (those of smallest hash).

Defined results: null and empty texts are one passage without words; repeated rows give repeated rows; labelled rows without a text or label are not
learnt from; without labelled rows of both classes every score is the share of label 1 (0.5 if there are no labels); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fitted
from .textvec import code_points, sigmoid, slices

LAGS = (1, 2, 3, 4, 6)
CLASSES = 16
WIDTH = CLASSES * CLASSES + len(LAGS) + 1


def _class_table() -> np.ndarray:
    """A class for each code point up to 0x24F, by what kind of character it is; one class for all above."""
    out = np.full(0x251, 13, np.int64)
    for c in range(0x250):
        ch = chr(c)
        out[c] = 0 if ch == "\n" else 1 if ch.isspace() else (2 if c < 128 else 3) if ch.islower() else (4 if c < 128 else 5) if ch.isupper() else 6 if ch.isdigit() else 13
    for k, marks in enumerate((".", ",;:", "!?", "|", "#$%&*", "\"'()[]{}<>", "-_/=+@~^\\"), 7):
        for ch in marks:
            out[ord(ch)] = k if k < 13 else 14
    return out


_CLASS = _class_table()


def passages(texts: list[str], words: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the first passage of each text (one more for the end)."""
    codes, bounds = code_points(texts, "\n")
    kind = _CLASS[np.minimum(codes, 0x250)]
    inside = kind > 1
    begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1  # a text starts after a pad, so no word begins at 0
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    owner = np.searchsorted(bounds, begins, side="right") - 1
    n_words = np.bincount(owner, minlength=len(texts))
    first_word = np.cumsum(n_words) - n_words
    n_pass = np.maximum(-(-n_words // words), 1)
    first = np.concatenate([[0], np.cumsum(n_pass)])
    word_pass = first[owner] + (np.arange(len(begins)) - first_word[owner]) // words
    # A character belongs to the passage of the last word begun before it.
    starts = np.zeros(len(codes), np.int64)
    if len(begins):
        starts[begins] = np.diff(word_pass, prepend=0)
    char_pass = np.cumsum(starts)
    text_first = np.repeat(first[:-1], np.diff(bounds))
    char_pass = np.maximum(char_pass, text_first)
    total = int(first[-1])
    pair = char_pass * (CLASSES * CLASSES) + kind * CLASSES + np.append(kind[1:], kind[:1])  # every text ends with the same pair of pads
    x = np.zeros((total, WIDTH), np.float32)
    grams = np.bincount(pair, minlength=total * CLASSES * CLASSES).reshape(total, -1)
    x[:, : CLASSES * CLASSES] = np.sqrt(grams / np.maximum(grams.sum(1, keepdims=True), 1))
    # Hash of each word: sums of mixed characters times odd powers of their place, over the word's range.
    place = np.arange(len(codes)) - np.repeat(np.concatenate([[0], begins]), np.diff(np.concatenate([[0], begins, [len(codes)]])))
    mixed = (codes.astype(np.uint64) + np.uint64(0x9E37)) * (np.uint64(2) * place.astype(np.uint64) + np.uint64(0x632BE5AB)) * np.uint64(0xD1342543DE82EF95)
    mixed ^= mixed >> np.uint64(29)
    run = np.concatenate([[np.uint64(0)], np.cumsum(mixed)])
    word = run[ends] - run[begins]
    count = np.maximum(np.bincount(word_pass, minlength=total), 1)
    for k, lag in enumerate(LAGS):
        same = np.zeros(len(word), bool)
        same[lag:] = (word[lag:] == word[:-lag]) & (owner[lag:] == owner[:-lag])
        x[:, CLASSES * CLASSES + k] = np.bincount(word_pass, same, total) / count
    x[:, -1] = np.log1p(np.bincount(word_pass, ends - begins, total) / count) / 4
    return x, first


@dataclass
class QualityModel:
    words: int
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    constant: float | None = None

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = np.zeros(len(texts))
        for a, b in slices(texts):
            x, first = passages(texts[a:b], self.words)
            out[a:b] = sigmoid(_forward(self.p, (x.astype(float) - self.mean) / self.scale, first)[0])
        return out


def _forward(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> tuple:
    h = np.tanh(x @ p["W"] + p["b"])
    v, u = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    e = (v * u) @ p["w"]
    bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
    a = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
    a /= np.add.reduceat(a, first[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
    return z @ p["c"] + p["d"], h, v, u, a, z, bag


def fit_quality(texts: list[str], labels: np.ndarray, words: int = 64, hidden: int = 24, gate: int = 12, epochs: int = 12, l2: float = 1e-4) -> QualityModel:
    labels = np.asarray(labels, float)
    empty = np.zeros(0)
    if len(set(labels.tolist())) < 2:
        return QualityModel(words, empty, empty, {}, float(labels.mean()) if len(labels) else 0.5)
    parts = [passages(texts[a:b], words) for a, b in slices(texts)]
    x = np.concatenate([x for x, _ in parts])
    sizes = np.concatenate([np.diff(f) for _, f in parts])
    starts = np.cumsum(sizes) - sizes
    mean, scale = x.mean(0), x.std(0) + 0.02
    x = (x - mean) / scale
    rng = np.random.default_rng(0)
    p = {"W": rng.normal(0, WIDTH**-0.5, (WIDTH, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, gate)), "U": rng.normal(0, hidden**-0.5, (hidden, gate))}
    p |= {"w": rng.normal(0, 0.1, gate), "c": rng.normal(0, hidden**-0.5, hidden), "d": np.zeros(1)}
    p = {k: q.astype(np.float32) for k, q in p.items()}
    m1, m2, step = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 64):
            docs = order[at : at + 64]
            rows = np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in docs])
            first = np.concatenate([[0], np.cumsum(sizes[docs])])
            xb = x[rows]
            logit, h, v, u, a, z, bag = _forward(p, xb, first)
            g = ((sigmoid(logit) - labels[docs]) / len(docs)).astype(np.float32)
            gz = np.outer(g, p["c"])
            ga = (gz[bag] * h).sum(1)
            ge = a * (ga - np.add.reduceat(a * ga, first[:-1])[bag])
            gh = a[:, None] * gz[bag]
            gv, gu = np.outer(ge, p["w"]) * u * (1 - v * v), np.outer(ge, p["w"]) * v * u * (1 - u)
            gh = (gh + gv @ p["V"].T + gu @ p["U"].T) * (1 - h * h)
            grads = {"W": xb.T @ gh, "b": gh.sum(0), "V": h.T @ gv, "U": h.T @ gu, "w": (v * u).T @ ge, "c": z.T @ g, "d": g.sum(keepdims=True)}
            step += 1
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            for k, q in grads.items():
                q = q + l2 * p[k]
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * q, 0.99 * m2[k] + 0.01 * q * q
                p[k] = (p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return QualityModel(words, mean, scale, {k: q.astype(float) for k, q in p.items()})


def train_quality(labelled: DataFrame, sample: int = 4000, key: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """Fit on at most ``sample`` rows of labelled(key, text, label)."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    return fitted(rows, sample, fit_quality)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.5, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with a score from 0 to 1 and a prediction; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in (score, predicted)]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            s = shared.value.scores([t or "" for t in texts]).astype(float)
            yield pa.record_batch([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*kept, score, predicted])

    rows = docs.select(*kept)
    schema = T.StructType([*rows.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])
    return rows.mapInArrow(work, schema)
