"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

Fit: from at most ``sample`` labelled rows (those of smallest hash, so the choice doesn't depend on partitioning). Each text is the set of its hashed
character n-grams. The log-count ratio of a feature compares its smoothed document counts in the two classes; the features with the largest chi-squared
statistic are kept, scaled by their ratio, and weighed by logistic regression with an L2 penalty, in which the rarer class counts more. Score: every whole text, in one vectorised pass; a
text's score depends on nothing but the text.

Defined results: null and empty texts score as texts without features; repeated rows give repeated rows; labelled rows without a text or label are not
learnt from; without labelled rows of both classes every score is the share of toxic labels (0 if there are none); an empty table gives no rows; other
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
from .textvec import code_points, ngrams, sigmoid, slices


@dataclass
class ToxicityModel:
    bits: int
    orders: tuple[int, ...]
    buckets: np.ndarray  # kept features, ascending
    weights: np.ndarray  # their weight times their log-count ratio
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        flag = np.zeros(1 << self.bits, bool)
        flag[self.buckets] = True
        out = np.zeros(len(texts))
        for a, b in slices(texts):
            codes, bounds = code_points([t.lower() for t in texts[a:b]])
            found = []
            for h, doc in ngrams(codes, bounds, self.orders, self.bits):
                hit = np.flatnonzero(flag[h])
                found.append(doc[hit] << self.bits | h[hit])
            seen = np.unique(np.concatenate(found))
            weight = self.weights[np.searchsorted(self.buckets, seen & ((1 << self.bits) - 1))]
            out[a:b] = np.bincount(seen >> self.bits, weight, b - a)
        return sigmoid(out + self.bias)


def fit_toxicity(texts: list[str], labels: np.ndarray, bits: int = 22, orders: tuple[int, ...] = (4, 5, 6, 7, 8), features: int = 3000, alpha: float = 0.2, l2: float = 1e-3, least: int = 3, balance: float = 1.6) -> ToxicityModel:
    labels = np.asarray(labels, np.int64)
    n = np.bincount(labels, minlength=2)[:2]
    none = np.zeros(0, np.int64)
    if not n.all():
        share = float(n[1] > 0)
        return ToxicityModel(bits, orders, none, np.zeros(0), 30.0 if share else -60.0)
    counts = np.zeros((2, 1 << bits), np.int32)

    def grams() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for a, b in slices(texts):
            codes, bounds = code_points([t.lower() for t in texts[a:b]])
            for h, doc in ngrams(codes, bounds, orders, bits):
                yield a, doc, h

    for a, doc, h in grams():  # a bucket that two orders share in one text counts twice, which costs nothing but a little weight
        keys = np.sort(doc << bits | h)
        keys = keys[np.diff(keys, prepend=-1) != 0]
        doc, h = keys >> bits, keys & ((1 << bits) - 1)
        for y in (0, 1):
            np.add.at(counts[y], h[labels[a + doc] == y], 1)
    used = np.flatnonzero(counts.sum(0) >= least)
    c = counts[:, used].astype(float)
    del counts
    p = (c + alpha) / (n[:, None] + 2 * alpha)
    ratio = np.log(p[1] / p[0])
    both, total = c.sum(0), n.sum()
    chi = total * (c[1] * n[0] - c[0] * n[1]) ** 2 / (both * (total - both + 1e-9) * n[0] * n[1] + 1e-9)
    keep = np.sort(np.argsort(-chi, kind="stable")[:features])
    buckets, ratio = used[keep], ratio[keep]
    flag = np.zeros(1 << bits, bool)
    flag[buckets] = True
    rows, cols = [], []
    for a, doc, h in grams():
        hit = np.flatnonzero(flag[h])
        keys = np.unique(doc[hit] << bits | h[hit])
        rows.append(a + (keys >> bits))
        cols.append(np.searchsorted(buckets, keys & ((1 << bits) - 1)))
    row, col = np.concatenate(rows), np.concatenate(cols)
    share = np.where(labels == 1, (n[0] / n[1]) ** balance, 1.0)  # what an error counts: toxic rows are few, and to miss one is worse
    share /= share.sum()
    w, bias = np.zeros(len(buckets)), float(np.log(share[labels == 1].sum() / share[labels == 0].sum()))
    m = v = np.zeros(len(buckets) + 1)
    for step in range(1, 301):  # Adam on the whole sample
        z = np.bincount(row, (w * ratio)[col], len(labels)) + bias
        err = (sigmoid(z) - labels) * share
        g = np.append(np.bincount(col, err[row], len(w)) * ratio + l2 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:-1], bias - float(move[-1])
    return ToxicityModel(bits, orders, buckets, w * ratio, bias)


def train_toxicity(labelled: DataFrame, sample: int = 8000, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Fit on at most ``sample`` rows of labelled(key, text, label)."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    return fitted(rows, sample, fit_toxicity)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with a score from 0 to 1 and a prediction; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in (score, predicted)]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `features` weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            s = shared.value.scores([t or "" for t in texts])
            yield pa.record_batch([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*kept, score, predicted])

    rows = docs.select(*kept)
    schema = T.StructType([*rows.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])
    return rows.mapInArrow(work, schema)
