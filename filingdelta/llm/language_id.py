"""Language identification with word-first backoff.

A word that the model knows is scored by its log frequency in each language; any other word falls back to its
character n-grams, the longest length of which at least one n-gram is known, from four characters down to one.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingdelta.llm.common import free_tables, map_columns, share, unpack, whole_row

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 4


def letters_of(text: str) -> list[str]:
    """Runs of letters, lower-cased. Numbers that are no digits, such as fractions and Roman numerals, are not letters."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in ([x] if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]


def words_of(text: bytes | None) -> list[str]:
    return letters_of(text.decode("utf-8", "replace")) if text else []


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


class Model:
    """Log frequencies: a row of one value per language for each known word, and for each known n-gram, by its length less
    one. Rows are found by dictionary and summed by array."""

    def __init__(self, langs: list[str], words: tuple[list[str], np.ndarray], grams: list[tuple[list[str], np.ndarray]]):
        self.langs = langs
        self.index = {w: i for i, w in enumerate(words[0])}
        self.table = np.asarray(words[1], dtype=np.float64).reshape(len(words[0]), len(langs))
        self.grams: list[dict[str, int]] = []
        at = 0
        for names, _ in grams:
            self.grams.append({g: at + i for i, g in enumerate(names)})
            at += len(names)
        self.gram_table = np.concatenate([np.asarray(rows, dtype=np.float64).reshape(len(names), len(langs)) for names, rows in grams])

    def unseen(self, word: str) -> list[int]:
        """Rows of the word's n-grams of the longest length of which one is known."""
        for n in range(LONGEST, 0, -1):
            known = self.grams[n - 1]
            if rows := [known[g] for g in grams_of(word, n) if g in known]:
                return rows
        return []

    def score(self, words: list[str]) -> np.ndarray:
        """The summed log frequency of words in each language; an unseen word counts as the mean of its n-grams."""
        found = list(map(self.index.get, words))
        total = np.zeros(len(self.langs))
        if None in found:
            rows: list[int] = []
            weights: list[float] = []
            for w, i in zip(words, found, strict=True):
                if i is None and (own := self.unseen(w)):
                    rows += own
                    weights += [1 / len(own)] * len(own)
            found = [i for i in found if i is not None]
            if rows:
                total += np.array(weights) @ self.gram_table[rows]
        return total + self.table[found].sum(axis=0) if found else total


def log_rows(names: list[str], counts: np.ndarray, totals: np.ndarray, prior: float = 0.5) -> tuple[list[str], np.ndarray]:
    return names, np.log((counts + prior) / (totals + prior * (len(names) + 1)))


def fit(labelled: DataFrame, docs_per_lang: int = 4_000, max_words: int = 200_000, max_grams: int = 100_000) -> Model:
    """Learn from rows (doc_id, text, lang) with a lang.

    docs_per_lang bounds the labelled rows that are read for a language (those whose hashed doc_id falls below the
    share that meets the bound); max_words and max_grams bound the model that is sent to the executors, the most
    frequent entries staying. What is not kept as a word is still scored through its n-grams."""
    rows = labelled.filter(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], ([], np.zeros((0, 0))), [([], np.zeros((0, 0)))] * LONGEST)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, docs_per_lang / n)))])
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def count_words():
        def body(texts, names):
            counts: dict[bytes, Counter] = {}
            for text, name in zip(texts, names, strict=True):
                counts.setdefault(name, Counter()).update(words_of(text))
            found = [(k.decode(), w, n) for k, c in counts.items() for w, n in c.items()]
            return list(zip(*found, strict=True)) or [[], [], []]

        return body

    def count_grams():
        def body(names, words, ns):
            counts: dict[tuple, int] = {}
            for name, word, n in zip(names, words, ns, strict=True):
                for size in range(1, LONGEST + 1):
                    for g in grams_of(word.decode(), size):
                        counts[name, size, g] = counts.get((name, size, g), 0) + n
            return list(zip(*[(k.decode(), size, g, n) for (k, size, g), n in counts.items()], strict=True)) or [[], [], [], []]

        return body

    per_word = map_columns(drawn.select("text", "lang"), count_words, "lang string, token string, n long").groupBy("lang", "token").agg(F.sum("n").alias("n")).checkpoint()
    per_gram = map_columns(per_word, count_grams, "lang string, size int, token string, n long").groupBy("lang", "size", "token").agg(F.sum("n").alias("n")).checkpoint()

    by_lang = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{k}") for k, lang in enumerate(langs)]

    def top(rows: DataFrame, limit: int) -> tuple[list[str], np.ndarray]:
        found = rows.groupBy("token").agg(F.sum("n").alias("total"), *by_lang).orderBy(F.desc("total"), "token").limit(limit).toArrow()
        counts = [found.column(f"n{k}").to_numpy() for k in range(len(langs))]
        return found.column("token").to_pylist(), np.stack(counts, axis=1).astype(np.float64)

    def totals(rows: DataFrame) -> np.ndarray:
        return np.array([x or 0 for x in rows.agg(*by_lang).first()], dtype=np.float64)

    levels = [per_gram.filter(F.col("size") == n) for n in range(1, LONGEST + 1)]
    return Model(langs, log_rows(*top(per_word, max_words), totals(per_word)), [log_rows(*top(level, max_grams // LONGEST), totals(level)) for level in levels])


def language_of(model: Model, spark: SparkSession):
    """A function of a text column that gives struct(lang_pred, score)."""
    shared = share(spark, model)

    @F.pandas_udf("lang_pred string, score double")
    def told(texts: pd.Series) -> pd.DataFrame:
        free_tables()
        own = shared.value
        names, shares = [], []
        for text in texts:
            words = letters_of(text) if text else []
            if not words or not own.langs:
                names.append("und")
                shares.append(0.0)
                continue
            total = own.score(words) / math.sqrt(len(words))
            best = int(np.argmax(total))
            names.append(own.langs[best])
            shares.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
        return pd.DataFrame({"lang_pred": names, "score": np.array(shares, dtype=float)})

    return told


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, lang_pred, score), one per row of docs, from the text alone.

    Null and letterless texts get `und` and score 0, as does every text if nothing was learned. Whole texts are read.
    score is the winner's share of the softmax over the summed log frequencies divided by the root of the number of
    words; ties go to the alphabetically first language. Repeated rows are predicted each, other columns are ignored."""
    return docs.select("doc_id", language_of(model, docs.sparkSession)("text").alias("p")).select("doc_id", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.3) -> DataFrame:
    """docs, all columns, without the rows whose language cannot be told (`und`) or is told with a score under min_score."""
    told = whole_row(docs, language_of(model, docs.sparkSession)("text").alias("p"))
    return unpack(told.filter((F.col("p.lang_pred") != "und") & (F.col("p.score") >= min_score)))


def identify(docs: DataFrame, **bounds: int) -> DataFrame:
    """The contract of op10: learn from labelled rows that are not held out, predict every row."""
    model = fit(docs.filter(~held_out()), **bounds)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
