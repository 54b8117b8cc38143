"""The three trained models against slow versions of the same methods: plain loops over dicts and single passages."""

import math
import random

import numpy as np
import pytest

from tessera.llm.language_id import fit_language
from tessera.llm.quality import _CLASS, CLASSES, LAGS, QualityModel, fit_quality, passages
from tessera.llm.textvec import code_points, ngrams
from tessera.llm.toxicity import fit_toxicity

KNOWN: dict[tuple, int] = {}


def bucket(gram, bits):
    """A gram's bucket, from the gram alone."""
    if (gram, bits) not in KNOWN:
        codes, _ = code_points([gram], "")
        KNOWN[gram, bits] = int(next(ngrams(codes, np.array([0, len(gram)]), (len(gram),), bits))[0][0])
    return KNOWN[gram, bits]


def grams(text, orders, bits):
    padded = f" {text.lower()} "
    return [bucket(padded[k : k + n], bits) for n in orders for k in range(len(padded) - n + 1)]


def logistic(z):
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def prose(seed, n, bad=()):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ba", "no", "ri", "tel", "ú", "sta")) for _ in range(rng.randint(1, 3)))
    out = []
    for k in range(n):
        words = [word() for _ in range(rng.randint(0, 40))]
        if bad and k % 3 == 0:
            words.insert(rng.randint(0, len(words)), rng.choice(bad))
        out.append(" ".join(words).capitalize())
    return out


def slow_toxicity(texts, labels, bits, orders, features, alpha, l2, least, balance):
    sets = [set(grams(t, orders, bits)) for t in texts]
    n = [labels.count(0), labels.count(1)]
    count = [{}, {}]
    for s, y in zip(sets, labels):
        for b in s:
            count[y][b] = count[y].get(b, 0) + 1
    ratio, chi = {}, {}
    for b in set(count[0]) | set(count[1]):
        c0, c1 = count[0].get(b, 0), count[1].get(b, 0)
        if c0 + c1 >= least:
            ratio[b] = math.log((c1 + alpha) / (n[1] + 2 * alpha)) - math.log((c0 + alpha) / (n[0] + 2 * alpha))
            chi[b] = sum(n) * (c1 * n[0] - c0 * n[1]) ** 2 / ((c0 + c1) * (sum(n) - c0 - c1 + 1e-9) * n[0] * n[1] + 1e-9)
    kept = sorted(chi, key=lambda b: (-chi[b], b))[:features]
    share = [(n[0] / n[1]) ** balance if y else 1.0 for y in labels]
    share = [x / sum(share) for x in share]
    w, bias = dict.fromkeys(kept, 0.0), math.log(sum(x for x, y in zip(share, labels) if y) / sum(x for x, y in zip(share, labels) if not y))
    m, v = {}, {}
    for step in range(1, 301):
        grad = {b: l2 * w[b] for b in kept}
        grad["bias"] = 0.0
        for s, y, x in zip(sets, labels, share):
            err = (logistic(sum(w[b] * ratio[b] for b in s if b in w) + bias) - y) * x
            grad["bias"] += err
            for b in s:
                if b in w:
                    grad[b] += err * ratio[b]
        for b, g in grad.items():
            m[b], v[b] = 0.9 * m.get(b, 0.0) + 0.1 * g, 0.99 * v.get(b, 0.0) + 0.01 * g * g
            move = 0.03 * (m[b] / (1 - 0.9**step)) / (math.sqrt(v[b] / (1 - 0.99**step)) + 1e-9)
            if b == "bias":
                bias -= move
            else:
                w[b] -= move
    return {b: w[b] * ratio[b] for b in kept}, bias


@pytest.mark.parametrize("features", [40, 100_000])
def test_toxicity(features):
    texts = [*prose(1, 60, ("zonkers", "gritfop")), "", "x"]
    labels = [int("zonkers" in t.lower() or "gritfop" in t.lower()) for t in texts]
    how = {"bits": 25, "orders": (4, 6), "features": features, "alpha": 0.2, "l2": 1e-3, "least": 2, "balance": 1.6}
    model = fit_toxicity(texts, np.array(labels), **how)
    weights, bias = slow_toxicity(texts, labels, **how)
    tests = [*texts, *prose(2, 20, ("gritfop",)), "Zonkers zonkers"]
    want = [logistic(sum(weights.get(b, 0.0) for b in set(grams(t, how["orders"], 25))) + bias) for t in tests]
    assert np.allclose(model.scores(tests), want, atol=1e-3)
    if features > 1000:
        assert model.buckets.tolist() == sorted(weights)
        assert np.allclose(model.weights, [weights[b] for b in model.buckets.tolist()], atol=1e-3)


def slow_language(texts, langs, bits, orders, alpha, beta, l1, l2, epochs):
    names = sorted(set(langs))
    counts = []
    for t in texts:
        c = {}
        for b in grams(t, orders, bits):
            c[b] = c.get(b, 0) + 1
        counts.append(c)
    df = {}
    for c in counts:
        for b in c:
            df[b] = df.get(b, 0) + 1
    idf = lambda b: math.log((1 + len(texts)) / (1 + df.get(b, 0))) + 1

    def vector(c):
        x = {b: math.log1p(n) * idf(b) for b, n in c.items()}
        size = max(math.sqrt(sum(q * q for q in x.values())), 1e-12)
        return {b: q / size for b, q in x.items()}

    z, n = {}, {}

    def weight(key):
        if abs(z.get(key, 0.0)) <= l1:
            return 0.0
        return -(z[key] - math.copysign(l1, z[key])) / ((beta + math.sqrt(n[key])) / alpha + l2)

    def odds(x):
        s = [sum(q * weight((b, k)) for b, q in x.items()) + weight(("bias", k)) for k in range(len(names))]
        e = [math.exp(q - max(s)) for q in s]
        return s, [q / sum(e) for q in e]

    for _ in range(epochs):
        for i, c in enumerate(counts):
            if i % 8 == 7:
                continue
            x = vector(c)
            p = odds(x)[1]
            old = {(b, k): weight((b, k)) for b in [*x, "bias"] for k in range(len(names))}
            for b, q in [*x.items(), ("bias", 1.0)]:
                for k, name in enumerate(names):
                    g = q * (p[k] - (langs[i] == name))
                    before = n.get((b, k), 0.0)
                    z[b, k] = z.get((b, k), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * old[b, k]
                    n[b, k] = before + g * g
    own = [(odds(vector(c))[0], names.index(langs[i])) for i, c in enumerate(counts) if i % 8 == 7]

    def loss(t):
        total = 0.0
        for s, y in own:
            e = [math.exp((q - max(s)) / t) for q in s]
            total -= math.log(e[y] / sum(e) + 1e-300)
        return total

    temperature = min((math.exp(q) for q in np.linspace(math.log(0.1), math.log(5), 60)), key=loss)
    return lambda t: odds(vector({b: grams(t, orders, bits).count(b) for b in grams(t, orders, bits)}))[0], temperature, names


def test_language():
    rng = random.Random(7)
    parts = {"aa": ("ba", "no", "ri"), "bb": ("sch", "au", "ei"), "cc": ("ção", "ri", "est")}
    langs = [rng.choice(list(parts)) for _ in range(64)]
    texts = [" ".join("".join(rng.choice(parts[k]) for _ in range(2)) for _ in range(rng.randint(1, 12))) for k in langs]
    how = {"bits": 12, "orders": (1, 2, 3), "alpha": 0.5, "beta": 1.0, "l1": 0.2, "l2": 0.1, "epochs": 2}
    model = fit_language(texts, langs, **how)
    logits, temperature, names = slow_language(texts, langs, **how)
    assert model.languages == names and abs(model.temperature - temperature) < 1e-6
    tests = [*texts[:10], "", "Riba schau", "ção"]
    assert np.allclose(model.logits(tests), [logits(t) for t in tests], atol=1e-4)


def slow_passages(text, words):
    padded = f"\n{text}\n"
    kind = [int(_CLASS[min(ord(c), 0x250)]) for c in padded]
    begins = [i for i in range(1, len(padded)) if kind[i] > 1 and kind[i - 1] <= 1]
    ends = [i for i in range(1, len(padded)) if kind[i] <= 1 and kind[i - 1] > 1]
    found = [padded[a:b] for a, b in zip(begins, ends)]
    n = max(-(-len(found) // words), 1)
    pairs, rows = [[0] * CLASSES**2 for _ in range(n)], []
    for i in range(len(padded)):
        started = sum(b <= i for b in begins)
        at = max(started - 1, 0) // words
        pairs[at][kind[i] * CLASSES + (kind[i + 1] if i + 1 < len(padded) else 0)] += 1
    for p in range(n):
        mine = range(p * words, min((p + 1) * words, len(found)))
        size = max(len(mine), 1)
        row = [math.sqrt(c / max(sum(pairs[p]), 1)) for c in pairs[p]]
        row += [sum(k >= lag and found[k] == found[k - lag] for k in mine) / size for lag in LAGS]
        rows.append([*row, math.log1p(sum(len(found[k]) for k in mine) / size) / 4])
    return np.array(rows)


def slow_score(p, x):
    """Logit of one document, and what the gradient needs: passage by passage."""
    h = [np.tanh(r @ p["W"] + p["b"]) for r in x]
    v, u = [np.tanh(q @ p["V"]) for q in h], [1 / (1 + np.exp(-(q @ p["U"]))) for q in h]
    e = [float((a * b) @ p["w"]) for a, b in zip(v, u)]
    a = [math.exp(q - max(e)) for q in e]
    a = [q / sum(a) for q in a]
    z = sum(q * r for q, r in zip(a, h))
    return float(z @ p["c"] + p["d"][0]), h, v, u, a, z


def slow_quality(texts, labels, words, hidden, gate, epochs, l2):
    bags = [slow_passages(t, words) for t in texts]
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 0.02
    bags = [(b - mean) / scale for b in bags]
    width = every.shape[1]
    rng = np.random.default_rng(0)
    p = {"W": rng.normal(0, width**-0.5, (width, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, gate)), "U": rng.normal(0, hidden**-0.5, (hidden, gate))}
    p |= {"w": rng.normal(0, 0.1, gate), "c": rng.normal(0, hidden**-0.5, hidden), "d": np.zeros(1)}
    m1, m2, step = {k: 0 * q for k, q in p.items()}, {k: 0 * q for k, q in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 64):
            docs = order[at : at + 64]
            grads = {k: l2 * q for k, q in p.items()}
            for d in docs:
                logit, h, v, u, a, z = slow_score(p, bags[d])
                g = (logistic(logit) - labels[d]) / len(docs)
                grads["c"] = grads["c"] + g * z
                grads["d"] = grads["d"] + g
                pull = [g * float(q @ p["c"]) for q in h]
                middle = sum(q * r for q, r in zip(a, pull))
                for k in range(len(h)):
                    ge = a[k] * (pull[k] - middle)
                    gv, gu = ge * p["w"] * u[k] * (1 - v[k] ** 2), ge * p["w"] * v[k] * u[k] * (1 - u[k])
                    grads["w"] = grads["w"] + ge * v[k] * u[k]
                    grads["V"], grads["U"] = grads["V"] + np.outer(h[k], gv), grads["U"] + np.outer(h[k], gu)
                    gh = (a[k] * g * p["c"] + p["V"] @ gv + p["U"] @ gu) * (1 - h[k] ** 2)
                    grads["W"], grads["b"] = grads["W"] + np.outer(bags[d][k], gh), grads["b"] + gh
            step += 1
            for k, q in grads.items():
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * q, 0.99 * m2[k] + 0.01 * q * q
                p[k] = p[k] - 0.01 * (1 - 0.9 * epoch / epochs) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return lambda t: logistic(slow_score(p, (slow_passages(t, words) - mean) / scale)[0])


def test_passages():
    texts = ["", "One two, two!\n\nthree 4", "a a a b a b " * 5, " \n ", "Ünïcode | x=1; ... ' ' ' ' end", *prose(3, 6)]
    for words in (3, 8):
        x, first = passages(texts, words)
        for i, t in enumerate(texts):
            assert np.allclose(x[first[i] : first[i + 1]], slow_passages(t, words), atol=1e-6)


def test_quality():
    texts = prose(4, 40)
    texts = [t if i % 2 else " ".join(f"{w} {w}" for w in t.split()) + " ###" for i, t in enumerate(texts)]
    labels = [i % 2 for i in range(len(texts))]
    how = {"words": 6, "hidden": 5, "gate": 3, "epochs": 4, "l2": 1e-4}
    model = fit_quality(texts, np.array(labels), **how)
    slow = slow_quality(texts, labels, **how)
    tests = [*texts, *prose(5, 10), ""]
    assert isinstance(model, QualityModel) and np.allclose(model.scores(tests), [slow(t) for t in tests], atol=5e-3)
