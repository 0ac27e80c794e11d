"""The classifier chain against plain loops: choice of words, optimum of each model, out-of-fold feed, probabilities."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from filingdelta.llm import toxicity


def plain_features(text):
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    return words | {w[:k] + "*" for w in words for k in (3, 4, 5, 6) if len(w) > k}


def plain_probability(z):
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def gradient(x, y, weights, intercept, ridge=0.3):
    """Of the penalised loss, row by row."""
    out = [ridge * w for w in weights] + [1e-6 * intercept]
    for row, target in zip(x, y, strict=True):
        p = plain_probability(sum(a * b for a, b in zip(row, weights, strict=True)) + intercept)
        for j, value in enumerate([*row, 1.0]):
            out[j] += (p - target) * value
    return max(map(abs, out))


def test_chain_against_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    chain = toxicity.fit(docs, labels, max_words=25)
    texts = {r["doc_id"]: plain_features(r["text"]) for r in docs.collect()}
    rows = sorted((r["doc_id"], r["quality"] == 0, r["toxic"] == 1) for r in labels.collect() if r["doc_id"] in texts)
    chosen = set()
    for k in (1, 2):
        n, p = len(rows), sum(r[k] for r in rows)
        count, hits = {}, {}
        for r in rows:
            for f in texts[r[0]]:
                count[f] = count.get(f, 0) + 1
                hits[f] = hits.get(f, 0) + r[k]
        scored = []
        for f, c in count.items():
            if c >= 5:
                rate = c / n
                z = abs(hits[f] / p - (c - hits[f]) / (n - p)) / math.sqrt(rate * (1 - rate + 1e-9) * (1 / p + 1 / (n - p)))
                scored += [(-z, f)] * (z >= 4)
        chosen |= {f for _, f in sorted(scored)[:25]}
    assert chain.words == sorted(chosen) and len(chosen) > 5
    x = [[float(w in texts[r[0]]) for w in chain.words] for r in rows]
    folds = {r["doc_id"]: r["f"] for r in labels.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)).alias("f")).collect()}
    fold, poor, toxic = np.array([folds[r[0]] for r in rows]), [float(r[1]) for r in rows], [float(r[2]) for r in rows]
    assert gradient(x, poor, *chain.models[0]) < 1e-4
    fed = [0.0] * len(rows)
    for k in range(5):  # models that have not seen the row
        w, b = toxicity.logistic(np.array(x)[fold != k], np.array(poor)[fold != k])
        for i in np.flatnonzero(fold == k):
            fed[i] = plain_probability(sum(a * c for a, c in zip(x[i], w, strict=True)) + b)
    assert gradient([[*a, f] for a, f in zip(x, fed, strict=True)], toxic, *chain.models[1]) < 1e-3
    for r in toxicity.predict(docs, chain).collect():
        present = [float(w in texts[r["doc_id"]]) for w in chain.words]
        out = []
        for weights, intercept in chain.models:
            out.append(plain_probability(sum(a * b for a, b in zip([*present, *out], weights, strict=True)) + intercept))
        assert abs(r["probabilities"]["poor"] - out[0]) < 1e-9 and abs(r["score"] - out[1]) < 1e-9 and r["toxic"] == (out[1] >= 0.5)


def test_repeated_rows_are_bounded(spark):
    """Many rows of one labelled doc_id count as one document; odd rows get the intercepts' probabilities."""
    docs = spark.createDataFrame([(i % 20, f"word{chr(97 + i % 20)} {'vile' if i % 2 else 'kind'} text") for i in range(400)] + [(None, "vile"), (50, None), (51, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)] + [(3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels, min_docs=2)
    found = toxicity.predict(docs, chain).collect()
    assert len(found) == 403 and all(r["toxic"] == (r["doc_id"] % 2 == 1) for r in found if r["doc_id"] is not None and r["doc_id"] < 20)
    blank = {(r["score"], r["toxic"]) for r in found if r["doc_id"] in (50, 51)}
    assert len(blank) == 1 and abs(next(iter(blank))[0] - chain.probabilities([])[-1]) < 1e-12
