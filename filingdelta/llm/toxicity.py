"""Toxicity by a classifier chain.

Categories are predicted one after another. Each has a linear model over the presence of informative words and word
beginnings and over the probabilities of the categories before it. While training, those probabilities come from out-of-fold models, so a
later model sees them as inaccurate as they will be on new documents.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingdelta.llm.common import map_columns, share

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6)


def features_of(word: str) -> list[str]:
    """The word and its beginnings, which are marked by a star."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


def distinct(text: bytes | None) -> set[str]:
    return set(WORD.findall(text.decode("utf-8", "replace").lower())) if text else set()


def default_categories() -> list[tuple[str, Column]]:
    """(name, condition on labels): poor quality first, then toxicity, which may use it."""
    return [("poor", F.col("quality") == 0), ("toxic", F.col("toxic") == 1)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 40) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression by Newton steps; the intercept is not penalised. One class only: a constant."""
    n, d = x.shape
    share = (y.sum() + 0.5) / (n + 1.0)
    w, b = np.zeros(d), float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return w, b
    full = np.hstack([x, np.ones((n, 1))])
    penalty = np.full(d + 1, ridge)
    penalty[-1] = 1e-6
    theta = np.append(w, b)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ theta, -30, 30)))
        gradient = full.T @ (p - y) + penalty * theta
        hessian = (full * (p * (1 - p) + 1e-6)[:, None]).T @ full + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - step
        if np.abs(step).max() < 1e-6:
            break
    return theta[:-1], float(theta[-1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Chain:
    """names in order; for each a weight vector over the words, then over the earlier categories, and an intercept."""

    def __init__(self, names: list[str], words: list[str], models: list[tuple[np.ndarray, float]]):
        self.names, self.words, self.models = names, words, models
        self.index = {w: i for i, w in enumerate(words)}

    def probabilities(self, present: Sequence[int]) -> list[float]:
        out: list[float] = []
        for weights, intercept in self.models:
            z = intercept + weights[list(present)].sum() + float(np.dot(weights[len(self.words) :], out))
            out.append(float(sigmoid(np.array(z))))
        return out


def train_chain(x: np.ndarray, ys: list[np.ndarray], fold: np.ndarray, names: list[str], words: list[str]) -> Chain:
    """Fit the chain; fold says which rows a model for out-of-fold predictions leaves out."""
    feed, models = np.zeros((len(x), 0)), []
    for k, y in enumerate(ys):
        features = np.hstack([x, feed])
        models.append(logistic(features, y))
        if k + 1 < len(ys):
            unseen = np.zeros(len(x))
            for f in np.unique(fold):
                w, b = logistic(features[fold != f], y[fold != f])
                unseen[fold == f] = sigmoid(features[fold == f] @ w + b)
            feed = np.hstack([feed, unseen[:, None]])
    return Chain(names, words, models)


def fit(docs: DataFrame, labels: DataFrame, categories: list[tuple[str, Column]] | None = None, max_labelled: int = 10_000, max_words: int = 300, min_docs: int = 5, folds: int = 5) -> Chain:
    """Train on the labelled documents.

    max_labelled bounds the labelled rows that are used, those whose hashed doc_id falls below the share that meets it;
    max_words bounds the words and word beginnings a category may choose, by the size of the z statistic between its two classes, which must
    be at least 4. Labels with a null doc_id or flag and labels without a document are left out; of several labels of one
    document a set flag wins; of several rows of documents with one labelled doc_id the text of the smallest hash counts, so
    what comes to the driver is bounded by labels. Folds are by hash of doc_id."""
    categories = categories or default_categories()
    names = [n for n, _ in categories]
    flags = labels.filter(F.col("doc_id").isNotNull()).select("doc_id", *[c.alias(f"y{k}") for k, (_, c) in enumerate(categories)]).dropna()
    flags = flags.groupBy("doc_id").agg(*[F.max(f"y{k}").alias(f"y{k}") for k in range(len(names))])
    share = min(1.0, max_labelled / max(1, flags.count()))
    drawn = flags.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # at most about max_labelled rows
    once = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = once.join(F.broadcast(drawn), "doc_id")

    def distinct_words():
        def body(*columns):
            found = [sorted({f for w in distinct(t) for f in features_of(w)}) for t in columns[1]]
            return [columns[0], found, *columns[2:]]

        return body

    ys = ", ".join(f"y{k} boolean" for k in range(len(names)))
    rows = map_columns(texts, distinct_words, f"doc_id long, words array<string>, {ys}").checkpoint()
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(F.col(f"y{k}").cast("long")).alias(f"p{k}") for k in range(len(names))]).first()
    n, positive = sums["n"], [sums[f"p{k}"] or 0 for k in range(len(names))]
    per_word = rows.select(F.explode("words").alias("word"), *[f"y{k}" for k in range(len(names))]).groupBy("word").agg(F.count("*").alias("n"), *[F.sum(F.col(f"y{k}").cast("long")).alias(f"a{k}") for k in range(len(names))]).filter(F.col("n") >= min_docs)
    vocabulary: set[str] = set()
    for k, p in enumerate(positive):
        if 0 < p < n:
            rate = F.col("n") / n
            z = (F.col(f"a{k}") / p - (F.col("n") - F.col(f"a{k}")) / (n - p)) / F.sqrt(rate * (1 - rate + 1e-9) * (1 / p + 1 / (n - p)))
            best = per_word.select("word", F.abs(z).alias("z")).filter("z >= 4").orderBy(F.desc("z"), "word").limit(max_words)
            vocabulary |= {r["word"] for r in best.collect()}
    words = sorted(vocabulary)
    index = {w: i for i, w in enumerate(words)}
    chosen = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    data = rows.select("doc_id", F.array_intersect("words", chosen).alias("words"), *[f"y{k}" for k in range(len(names))], F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(folds)).alias("fold")).orderBy("doc_id").collect()
    x = np.zeros((len(data), len(words)))
    for i, r in enumerate(data):
        x[i, [index[w] for w in r["words"]]] = 1.0
    targets = [np.array([float(r[f"y{k}"]) for r in data]) for k in range(len(names))]
    return train_chain(x, targets, np.array([r["fold"] for r in data]), names, words)


def predict(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """Rows (doc_id, probabilities map<string,double>, score, toxic), one per row of docs.

    score is the probability of the chain's last category, toxic whether it reaches threshold. Whole texts are read; null
    and empty texts have no words and get the intercepts' probabilities. Repeated rows are scored each."""
    shared = share(docs.sparkSession, chain)

    def maker():
        own = shared.value
        memo: dict[str, tuple[int, ...]] = {}

        def body(ids, texts):
            maps, scores, flags = [], [], []
            for t in texts:
                words = distinct(t)
                if len(memo) > 500_000:
                    memo.clear()
                present: set[int] = set()
                for w in words:
                    at = memo.get(w)
                    if at is None:
                        at = memo[w] = tuple(own.index[f] for f in features_of(w) if f in own.index)
                    present.update(at)
                p = own.probabilities(sorted(present))
                maps.append(list(zip(own.names, p, strict=True)))
                scores.append(p[-1])
                flags.append(p[-1] >= threshold)
            return [ids, maps, scores, flags]

        return body

    return map_columns(docs.select("doc_id", "text"), maker, "doc_id long, probabilities map<string,double>, score double, toxic boolean")
