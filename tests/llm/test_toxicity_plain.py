"""The whole toxicity score against plain Python: counts, prior, weights, lambda, K, evidence, out-of-fold map."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecscore.llm import toxicity

BAD = ["vile", "horrid", "rotten", "nasty", "wretched", "loathsome"]


def corpus():
    rng = np.random.default_rng(8)
    plain = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    docs, labels = [], []
    for k in range(900):
        words = rng.choice(plain, rng.integers(0, 80)).tolist()
        bad = k % 3 == 0
        for _ in range(int(rng.integers(3, 9)) if bad else int(rng.random() < 0.04)):
            words.insert(int(rng.integers(0, len(words) + 1)), str(rng.choice(BAD)))
        docs.append((k, " ".join(words).capitalize() if words else None))
        if k % 10 < 8:
            labels.append((k, int(bad) if k % 29 else 1 - int(bad)))
    return docs, [*labels, (5000, 1), (3, None), (4, 7)]


def tokens(word):
    return [word, *(word[:n] + "*" for n in (5, 7) if len(word) > n)]


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())


def learn(train, seen, n_docs, several):
    """weights, weight of other words, lambda; train: (tokens of a text, label); several: tokens of two training texts at least"""
    bad, every = Counter(), Counter()
    for own, y in train:
        every.update(own)
        bad.update(own if y else ())
    n1 = sum(y for _, y in train)
    n0 = len(train) - n1
    clean_total = sum(every[w] - bad[w] for w in every if w in several)
    weights, share = {}, {}
    for w in every:
        a = 200 * seen[w] / n_docs + 0.01
        y1, y0 = bad[w] + a, every[w] - bad[w] + a
        odds = math.log(y1 / (n1 + 200 + 1 - y1)) - math.log(y0 / (n0 + 200 + 1 - y0))
        if every[w] > 1 and abs(odds / math.sqrt(1 / y1 + 1 / y0)) >= 3 and abs(odds) >= 1.5:
            weights[w], share[w] = odds, (every[w] - bad[w]) / clean_total
    rest = max(0.05, 1 - sum(share.values()))
    other = -max(0.15, 2 * sum(max(weights[w], 0) * share[w] for w in weights) / rest)
    mass = [(weights[w], max(share[w], 0.5 / clean_total)) for w in weights] + [(other, rest)]
    whole = sum(m for _, m in mass)
    lo, hi = 1e-6, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(m * math.exp(min(700, mid * s)) for s, m in mass) / whole < 1 else (lo, mid)
    return weights, other, lo


def segments(s):
    """All maximal scoring segments: the best one, then those of what is left and right of it."""
    best, at = 0.0, None
    for i in range(len(s)):
        total = 0.0
        for j in range(i, len(s)):
            total += s[j]
            if total > best + 1e-12:
                best, at = total, (i, j + 1)
    return [] if at is None else [*segments(s[: at[0]]), best, *segments(s[at[1] :])]


def evidence(model, k, text):
    weights, other, lam = model
    words = words_of(text)
    if not words:
        return -20.0, 0
    own = [lam * s - math.log(k * len(words)) for s in segments([max((weights[t] for t in tokens(w) if t in weights), default=other) for w in words])]
    strong = [x for x in own if x >= -math.log(0.05)]
    return (sum(strong) if strong else max(own, default=-20.0)), len(strong)


def chance(model, texts):
    found = [x for x, n in (evidence(model, 1.0, t) for t in texts) if n <= 1 and x > -20]
    return min(1e3, max(1e-6, len(found) / sum(math.exp(-x) for x in found)))


def place(x):
    low, high = math.asinh(-20), math.asinh(1e6)
    return min(2047, max(0, math.floor((math.asinh(x) - low) / ((high - low) / 2048))))


def test_scores_are_those_of_plain_python(spark):
    docs, labels = corpus()
    df, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, marks).collect()}
    known = toxicity.known_labels(marks)
    fold = {r["doc_id"]: (r["y"], r["fold"]) for r in known.collect()}
    held = {r["doc_id"] for r in df.filter(toxicity.held_out(F.col("doc_id"))).collect()}
    assert set(fold) == {i for i, y in labels if y in (0, 1)} - held - ({5000} if 5000 not in fold else set())
    own = {i: {t for w in words_of(x) for t in tokens(w)} for i, x in docs}
    seen = Counter(t for x in own.values() for t in x)
    rows = [(i, own[i], *fold[i]) for i, _ in docs if i in fold]
    text = dict(docs)
    several = {w for w, n in Counter(t for _, x, _, _ in rows for t in x).items() if n > 1}
    models = {None: learn([(x, y) for _, x, y, _ in rows], seen, len(docs), several)}
    models |= {f: learn([(x, y) for _, x, y, g in rows if g != f], seen, len(docs), several) for f in range(4)}
    k = {None: chance(models[None], [text[i] for i, _, y, _ in rows if not y])}
    k |= {f: chance(models[f], [text[i] for i, _, y, g in rows if not y and g == f]) for f in range(4)}
    bins = defaultdict(lambda: [0, 0])
    for i, _, y, f in rows:
        bins[place(evidence(models[f], k[f], text[i])[0])][y] += 1
    # isotonic: the largest over beginnings of the smallest over ends of the mean between them
    at = sorted(bins)
    good, every = [bins[b][1] for b in at], [sum(bins[b]) for b in at]
    rising = [max(min(sum(good[a : z + 1]) / sum(every[a : z + 1]) for z in range(m, len(at))) for a in range(m + 1)) for m in range(len(at))]
    wrong = 0
    for i, x in docs:
        e, n = evidence(models[None], k[None], x)
        assert got[i]["evidence"] == pytest.approx(e, abs=1e-6) and got[i]["n_passages"] == n
        b = place(e)
        # a bin without labelled rows goes with the block that it lies in or between
        below = max((rising[m] for m in range(len(at)) if at[m] <= b), default=0.0)
        above = min((rising[m] for m in range(len(at)) if at[m] >= b), default=1.0)
        low, high = below * 0.999 + 0.001 * (b + 1) / 2049, above * 0.999 + 0.001 * (b + 1) / 2049
        assert low - 1e-9 <= got[i]["score"] <= high + 1e-9 or got[i]["score"] == pytest.approx(0.001 * (b + 1) / 2049)
        wrong += got[i]["score"] < low - 1e-9
    assert wrong <= len(docs) // 100
    assert set(models[None][0]) >= set(BAD)


def test_the_sample_is_bounded(spark):
    """Whatever the number of labels: what is broadcast has no more rows than the bound, the same on every run."""
    marks = spark.range(5000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    some = {r["doc_id"] for r in toxicity.known_labels(marks, bound=300).collect()}
    assert len(some) == 300 and some == {r["doc_id"] for r in toxicity.known_labels(marks.repartition(7), bound=300).collect()}
    assert not {r["doc_id"] for r in marks.filter(toxicity.held_out(F.col("doc_id"))).collect()} & some
