"""Benchmark decontamination by SimHash windows.

Windows as long as a benchmark item are fingerprinted at the places of a document that hold enough benchmark shingles, of
whatever item, for the wanted similarity; no other window can reach it. A multi-index over the items' fingerprints, cut
into blocks, gives every item whose fingerprint is within the radius of a window's: it is where items meet windows. The
exact similarity of the weighted shingles then decides.

A fingerprint has 128 bits. Windows and items of a similarity of 0.8 differ in 26 bits on average with a deviation of 4.6,
so a radius of 40 loses about one such pair in a thousand and hardly any of more similarity; two texts that share nothing
differ in 64 and are within 40 once in 70,000. Eight blocks of 16 bits have radii 4 and once 5, which add up, with one for
each block, to more than the radius: some block of every fingerprint within it is found. A ball of that radius is met half
way: items are stored with all values two bits from their block's, and a window asks for all values two (or three) bits
from its own.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingdelta.llm.common import map_columns, share, unpack, whole_row

#: ASCII other than digits and letters separates words; the text is lower-cased before.
WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
FACTOR = np.uint64(0x9E3779B97F4A7C15)
BITS, BLOCK, STORED = 128, 16, 2


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(WORDS).split() if text else []


def weighted(words: list[bytes], k: int) -> Counter:
    """Shingles with their multiplicity; fewer than k words are one shingle."""
    return Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else Counter()


def similarity(a: Counter, b: Counter) -> float:
    """Twice the shared weight over the whole weight."""
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())) if a and b else 0.0


def balls(radius: int) -> np.ndarray:
    """The masks of up to radius bits of a block."""
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(BLOCK), r)], dtype=np.uint16)


def signs(words: list[bytes], k: int) -> np.ndarray:
    """A row of 128 times 1 or -1 for the shingle at each place, by its XXH3 hash."""
    n = max(1, len(words) - k + 1)
    digests = b"".join(xxhash.xxh3_128_digest(b" ".join(words[i : i + k])) for i in range(n))
    return np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(n, 16), axis=1).astype(np.int8) * 2 - 1


def packed_prints(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of summed signs, as rows of eight blocks."""
    return np.packbits(sums > 0, axis=1).view(">u2").astype(np.uint16)


class Benchmark:
    """The items' shingles, fingerprints and block tables."""

    def __init__(self, items: list[tuple[int, str]], k: int = 5, at_least: float = 0.8, radius: int = 40):
        self.k, self.at_least, self.radius = k, at_least, radius
        found = [(i, w) for i, t in items if (w := words_of(t))]
        self.ids = [i for i, _ in found]
        self.words = [w for _, w in found]
        self.number = {w: n for n, w in enumerate(sorted({x for w in self.words for x in w}), 1)}
        owners: dict[int, set[int]] = {}
        self.short: dict[int, list[int]] = {}
        for n, words in enumerate(self.words):
            if len(words) < k:
                self.short.setdefault(self.number[words[0]], []).append(n)
                continue
            for code in self.codes(self.numbers(words)):
                owners.setdefault(int(code), set()).add(len(words))
        self.known = np.array(sorted(owners), dtype=np.uint64)
        self.sizes = [sorted(owners[int(c)]) for c in self.known]  # of the items that have the shingle
        # block radii plus one add up to more than the radius: some block of every fingerprint within it is in a ball
        blocks = BITS // BLOCK
        self.long = np.array([n for n, w in enumerate(self.words) if len(w) >= k], dtype=np.int64)
        self.prints = np.concatenate([np.zeros((0, blocks), np.uint16), *[packed_prints(signs(self.words[n], k).sum(axis=0, dtype=np.int32)[None, :]) for n in self.long]])
        self.asked = [balls(max(0, (radius + 1) // blocks + (b < (radius + 1) % blocks) - 1 - STORED)) for b in range(blocks)]
        self.tables = []
        for b in range(blocks):
            values = (self.prints[:, b][:, None] ^ balls(STORED)[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            starts = np.searchsorted(values[order], np.arange((1 << BLOCK) + 1))
            self.tables.append((starts.astype(np.int32), np.repeat(np.arange(len(self.long)), len(balls(STORED)))[order].astype(np.int32)))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words; 0 for those that no item has."""
        return np.fromiter(map(self.number.get, words, (0 for _ in words)), dtype=np.uint64, count=len(words))

    def codes(self, numbers: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """A number for the shingle at each place."""
        at = np.arange(len(numbers) - self.k + 1) if at is None else at
        c = numbers[at]
        for j in range(1, self.k):
            c = c * FACTOR + numbers[at + j]
        return c

    def near(self, prints: np.ndarray) -> list[np.ndarray]:
        """For each of some fingerprints the items whose own is within the radius: block balls, then the whole distance."""
        out = []
        for row in prints:
            hits = []
            for (starts, items), masks, value in zip(self.tables, self.asked, row, strict=True):
                asked = (masks ^ value).astype(np.int64)
                low, high = starts[asked], starts[asked + 1]
                full = high > low
                hits += [items[a:b] for a, b in zip(low[full].tolist(), high[full].tolist(), strict=True)]
            found = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int32)
            apart = np.bitwise_count(self.prints[found] ^ row).sum(axis=1)
            out.append(self.long[found[apart <= self.radius]])
        return out

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, words) of the most similar window of each item that one is similar to."""
        words = words_of(text)
        k, best = self.k, {}
        numbers = self.numbers(words)
        if self.short:
            for at in np.flatnonzero(np.isin(numbers, np.array(list(self.short), dtype=np.uint64))):
                for n in self.short[int(numbers[at])]:
                    if n not in best and words[at : at + len(self.words[n])] == self.words[n]:
                        best[n] = (1.0, int(at), len(self.words[n]))
        if len(words) >= k and len(self.known):
            inside = numbers > 0
            run = inside[: len(words) - k + 1].copy()
            for j in range(1, k):
                run &= inside[j : len(words) - k + 1 + j]
            at = np.flatnonzero(run)
            codes = self.codes(numbers, at)
            place = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
            real = self.known[place] == codes
            if real.any():
                known = np.zeros(len(words) - k + 2, dtype=np.int32)
                known[at[real] + 1] = 1
                np.cumsum(known, out=known)
                for size in sorted({z for c in np.unique(place[real]).tolist() for z in self.sizes[c]}):
                    self.windows(words, known, size, best)
        return sorted((self.ids[n], s, at, size) for n, (s, at, size) in best.items())

    def windows(self, words: list[bytes], known: np.ndarray, item_size: int, best: dict, block: int = 4_096) -> None:
        """Judge the windows for items of item_size words, known being the running number of benchmark shingles."""
        k, size = self.k, min(item_size, len(words))
        span, weight = size - k + 1, item_size - k + 1
        # 2 * shared / (span + weight) >= at_least, and a window shares no more than the benchmark shingles that it has
        starts = np.flatnonzero(known[span:] - known[:-span] >= self.at_least * (span + weight) / 2 - 1e-9)
        asked: dict[int, list[int]] = {}
        at = 0
        while at < len(starts):  # a stretch of the text at a time
            base = int(starts[at])
            some = starts[at : int(np.searchsorted(starts, base + block, "right"))]
            at += len(some)
            sums = np.zeros((int(some[-1]) - base + span + 1, BITS), dtype=np.int32)
            np.cumsum(signs(words[base : int(some[-1]) + size], k), axis=0, out=sums[1:])
            prints, of = np.unique(packed_prints(sums[some - base + span] - sums[some - base]), axis=0, return_inverse=True)
            near = self.near(prints)  # a text that repeats itself asks once
            for s, row in zip(some.tolist(), of.ravel().tolist(), strict=True):
                for n in near[row].tolist():
                    if len(self.words[n]) == item_size:
                        asked.setdefault(n, []).append(s)
        for n, places in asked.items():
            value, s = max(zip(self.exact(n, words, places, span), (-p for p in places), strict=True))
            if value >= self.at_least - 1e-12 and (n not in best or value > best[n][0]):
                best[n] = (value, -s, size)

    def exact(self, n: int, words: list[bytes], places: list[int], span: int) -> list[float]:
        """Similarities of item n and the windows of span shingles at places, which ascend: shingles come and go one by one."""
        k = self.k
        item = weighted(self.words[n], k)
        whole = span + sum(item.values())
        held: Counter = Counter()
        out, shared, begin, end = [], 0, 0, 0
        for p in places:
            if p >= end:
                held.clear()
                shared, begin, end = 0, p, p
            while end < p + span:
                x = tuple(words[end : end + k])
                held[x] += 1
                shared += held[x] <= item[x]
                end += 1
            while begin < p:
                x = tuple(words[begin : begin + k])
                shared -= held[x] <= item[x]
                held[x] -= 1
                begin += 1
            out.append(2 * shared / whole)
        return out


def benchmark_slices(benchmark: DataFrame, max_chars: int, **parameters):
    """Indexes over the benchmark's items, each of about max_chars characters of text at most, so that what is sent to
    the executors is bounded; a larger benchmark is used slice by slice."""
    items = benchmark.filter("text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, -(-total // max_chars))
    for n in range(slices):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(slices)) == n).orderBy("item_id", "text").collect()
        yield Benchmark([(r["item_id"], r["text"]) for r in rows], **parameters)


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_chars: int = 4_000_000, **parameters) -> DataFrame:
    """Rows (doc_id, item_id, similarity, first_word, n_words): for each row of docs and each item the most similar window
    of the item's size, where one reaches the similarity.

    Words are lower-cased runs of ASCII digits and letters and of other characters. Items and documents shorter than five
    words match only where all the item's words stand in a row. Null and empty texts and items match nothing. Items of
    equal text match each; a null item_id is returned as null; repeated rows are searched each."""
    spark, out = docs.sparkSession, None
    for index in benchmark_slices(benchmark, max_chars, **parameters):
        shared = share(spark, index)

        def maker(shared=shared):
            own = shared.value

            def body(ids, texts):
                rows = [(i, *m) for i, t in zip(ids, texts, strict=True) for m in own.matches(t.decode("utf-8", "replace") if t else None)]
                return list(zip(*rows, strict=True)) or [[], [], [], [], []]

            return body

        one = map_columns(docs.select("doc_id", "text"), maker, "doc_id long, item_id long, similarity double, first_word long, n_words long")
        out = one if out is None else out.unionByName(one)
    return out


def clean_text(index: Benchmark, spark: SparkSession):
    """A function of a text column: whether no item of the index is in it."""
    shared = share(spark, index)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series([not own.matches(t) for t in texts], dtype=bool)

    return clean


def drop_leaks(docs: DataFrame, benchmark: DataFrame, max_chars: int = 4_000_000, **parameters) -> DataFrame:
    """docs, all columns, without the rows whose text holds a benchmark item."""
    packed = whole_row(docs, F.col("text").alias("_t"))
    for index in benchmark_slices(benchmark, max_chars, **parameters):
        packed = packed.filter(clean_text(index, docs.sparkSession)("_t"))
    return unpack(packed)
