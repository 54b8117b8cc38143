"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Fit: from at most ``sample`` rows with a text and a language (those of smallest hash). Each text becomes the L2-normalised vector of log-damped counts of
its hashed character n-grams times their inverse document frequency. Weights are learnt row by row with follow-the-regularised-leader (proximal, a step
size per coordinate) under an elastic-net penalty, so most stay exactly zero; a part of the sample that took no part in it sets the temperature that
calibrates the probabilities. Score: every whole text in a vectorised pass.

Defined results: a null text, and one without any letter, is ``und`` with score 0; if nothing could be learnt from, so is every text; repeated rows give
repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fitted
from .textvec import code_points, ngrams, slices

LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


def _counts(texts: list[str], orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Texts by buckets: how often each bucket occurs."""
    codes, bounds = code_points([t.lower() for t in texts])
    out = np.zeros(len(texts) << bits, np.int64)
    for h, doc in ngrams(codes, bounds, orders, bits):
        out += np.bincount(doc << bits | h, minlength=len(out))
    return out.reshape(len(texts), 1 << bits)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    at = np.nonzero(counts)
    x = np.zeros(counts.shape, np.float32)
    x[at] = np.log1p(counts[at]) * idf[at[1]]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class LanguageModel:
    bits: int
    orders: tuple[int, ...]
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets by languages
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        for a, b in slices(texts):
            for c in range(a, b, 64):
                d = min(b, c + 64)
                out[c:d] = _vectors(_counts(texts[c:d], self.orders, self.bits), self.idf) @ self.weights + self.bias
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [i for i, t in enumerate(texts) if self.languages and t and LETTER.search(t)]
        names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if known:
            p = softmax(self.logits([texts[i] for i in known]) / self.temperature)
            for i, k, s in zip(known, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                names[i], score[i] = self.languages[k], s
        return names, score


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_language(texts: list[str], langs: list[str], bits: int = 13, orders: tuple[int, ...] = (1, 2, 3), alpha: float = 0.5, beta: float = 1.0, l1: float = 0.2, l2: float = 0.1, epochs: int = 2) -> LanguageModel:
    names = sorted(set(langs))
    size, k = 1 << bits, len(names)
    model = LanguageModel(bits, orders, names, np.ones(size), np.zeros((size, k)), np.zeros(k))
    if k < 2:
        return model
    y = np.array([names.index(x) for x in langs])
    rows, df = [], np.zeros(size)
    for a in range(0, len(texts), 64):
        for counts in _counts(texts[a : a + 64], orders, bits):
            at = np.flatnonzero(counts)
            df[at] += 1
            rows.append((at.astype(np.int32), np.log1p(counts[at])))
    model.idf = np.log((1 + len(texts)) / (1 + df)) + 1
    rows = [(at, x * model.idf[at]) for at, x in rows]
    rows = [(at, x / max(np.linalg.norm(x), 1e-12)) for at, x in rows]
    own = [i for i in range(len(rows)) if i % 8 == 7]  # for the temperature
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    for _ in range(epochs):
        for i, (at, x) in enumerate(rows):
            if i % 8 == 7:
                continue
            at, x = np.append(at, size), np.append(x, 1.0)
            w = weights(at)
            g = np.outer(x, softmax(x @ w) - (np.arange(k) == y[i]))
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(slice(None))
    model.weights, model.bias = w[:-1], w[-1]
    if own:
        logits = np.array([rows[i][1] @ model.weights[rows[i][0]] + model.bias for i in own])
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(own)), y[own]] + 1e-300).mean()
        grid = np.exp(np.linspace(np.log(0.1), np.log(5), 60))
        model.temperature = float(grid[int(np.argmin([loss(t) for t in grid]))])
    return model


def train_language(labelled: DataFrame, sample: int = 5000, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on at most ``sample`` rows of labelled(key, text, lang)."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("label"))
    return fitted(rows, sample, fit_language)


def identify_language(docs: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with a predicted language and its calibrated probability; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in (lang, score)]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits weights a language

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, s = shared.value.predict(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.record_batch([*batch.columns, pa.array(names, pa.string()), pa.array(s)], names=[*kept, lang, score])

    rows = docs.select(*kept)
    schema = T.StructType([*rows.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return rows.mapInArrow(work, schema)
