"""The near-copy stage against exact Jaccard components of five-word shingles."""

import random
from collections import Counter

import corpus_pipeline
import pytest

from filingdelta.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(sets, at_least=0.8):
    """The smallest member of each set's component."""
    root = list(range(len(sets)))
    owners = {}
    for i, s in enumerate(sets):
        for x in s:
            owners.setdefault(x, []).append(i)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in owners[x] if j < i}:
            if len(s & sets[j]) / len(s | sets[j]) >= at_least:
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return [top(i) for i in range(len(sets))]


def shingle_sets(texts):
    """Blank texts share one set, so they are copies of each other."""
    return [set(simhash.shingles(t.encode().translate(simhash.ASCII_LOWER).split(), 5)) or {b""} for t in texts]


def edited(rng, words, edits):
    copy = list(words)
    for at in rng.sample(range(len(copy)), edits):
        copy[at] = f"w{rng.randrange(5_000)}"
    return copy


def drawn(rng, size=200):
    return [f"w{rng.randrange(5_000)}" for _ in range(size)]


def found_and_wanted(spark, texts, **parameters):
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs, **parameters).collect()}
    return [found[i] for i in range(len(texts))], brute(shingle_sets([" ".join(t) for t in texts]))


@pytest.mark.parametrize("limit", [{}, {"bucket_limit": 2}])
def test_crowded_group_of_variants(spark, limit):
    """One template with 80 variants, of which some are similar to few others only."""
    rng = random.Random(5)
    template = drawn(rng)
    found, want = found_and_wanted(spark, [edited(rng, template, rng.randint(0, 9)) for _ in range(80)], **limit)
    assert found == want and 1 < len(set(want)) < 60


def test_every_pair_of_the_similarity(spark):
    """Pairs of a similarity of about 0.65 to 0.95."""
    rng = random.Random(6)
    texts = []
    for i in range(80):
        base = drawn(rng)
        texts += [base, edited(rng, base, 2 + i % 8)]
    found, want = found_and_wanted(spark, texts)
    assert not [i for i, c in enumerate(want) if c != i and found[i] == i]
    assert 20 < sum(i != c for i, c in enumerate(want)) < 75


def test_no_pair_below_the_similarity(spark):
    """Pairs a little below 0.8 are no copies."""
    rng = random.Random(8)
    texts = []
    for i in range(80):
        base = drawn(rng)
        texts += [base, edited(rng, base, 5 + i % 3)]
    found, want = found_and_wanted(spark, texts)
    assert not [i for i, c in enumerate(found) if c != i and want[i] == i]
    assert sum(i == c for i, c in enumerate(want)) > 100


def test_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    want = brute(shingle_sets([t for _, t in rows]))
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()}
    assert kept == {rows[c][0] for c in want}


def test_all_pairs_of_the_largest_table(spark):
    """Every pair of distinct sets of five-word shingles of similarity 0.8 or more, over 10,000 raw documents, is in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    group = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        if found := frozenset(simhash.shingle_set((r["text"] or "").encode(), 5).tolist()):
            sets.setdefault(found, r["doc_id"])
    items, owners = list(sets.items()), {}
    for n, (s, _) in enumerate(items):
        for x in s:
            owners.setdefault(x, []).append(n)
    pairs = []
    for n, (s, i) in enumerate(items):
        shared = Counter(m for x in s for m in owners[x] if m < n)
        pairs += [(i, items[m][1]) for m, k in shared.items() if k >= 0.8 * (len(s) + len(items[m][0]) - k)]
    assert len(pairs) > 40 and all(group[i] == group[j] for i, j in pairs)


def test_texts_are_joined_for_near_pairs_only(spark, monkeypatch):
    """Texts that share a frequent phrase by chance make a crowded bucket; their sketches keep them apart, pair by pair."""
    rng = random.Random(9)
    none = simhash.np.zeros(0, dtype=simhash.np.uint64)
    monkeypatch.setattr(simhash, "common_shingles", lambda *_: (none, none.astype(int)))
    judged, keep = [], simhash.Scratch.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        if name.startswith("judged"):
            judged.append(out.count())
        return out

    monkeypatch.setattr(simhash.Scratch, "keep", counted)
    phrases = [drawn(rng, 5) for _ in range(4)]
    texts = [drawn(rng, 30) + [w for p in phrases for w in p] for _ in range(120)]
    texts += [edited(rng, drawn(rng, 60) + phrases[0], 1) for _ in range(3)]
    texts += [[*texts[0], "end"]]
    found, want = found_and_wanted(spark, texts)
    assert found == want and want[-1] == 0
    assert 1 <= sum(judged) < 20


def test_sketches_lose_no_pair(spark):
    rng = random.Random(10)
    rows, want = [], []
    for n in (1, 5, 60, 64, 65, 300, 2_000):
        for share in (0.5, 0.7, 0.8, 0.85, 0.95, 1.0):
            whole = [rng.getrandbits(64) for _ in range(2 * n)]
            both = round(2 * n * share / (1 + share))
            half = (2 * n - both) // 2
            a, b = (simhash.np.unique(simhash.np.array(x, dtype=simhash.np.uint64)) for x in (whole[: both + half] or whole[:1], whole[:both] + whole[both + half :] or whole[:1]))
            shared = len(simhash.np.intersect1d(a, b))
            want.append(shared / (len(a) + len(b) - shared))
            rows.append((len(want) - 1, *({"size": len(s), "sketch": simhash.sketch(s).tolist()} for s in (a, b))))
    pairs = spark.createDataFrame(rows, "i int, x struct<size:int,sketch:array<long>>, y struct<size:int,sketch:array<long>>")
    left = {r["i"] for r in pairs.filter(simhash.may_be_similar(pairs["x"], pairs["y"], 0.8)).collect()}
    assert {i for i, s in enumerate(want) if s >= 0.8} <= left and not {i for i, s in enumerate(want) if s < 0.6 and rows[i][1]["size"] > 200} & left


def test_multi_index_finds_near_fingerprints(spark, monkeypatch):
    """Without the join by shingles, the pairs within four bits whose texts are similar are joined, and no others."""
    rng = random.Random(11)
    monkeypatch.setattr(simhash, "similar_links", lambda *_, **__: spark.createDataFrame([], "a long, b long"))
    texts = []
    for i in range(60):
        base = drawn(rng, 300)
        texts += [base, base[: 300 - i % 6], edited(rng, base, 1 + i % 4)]
    texts += [["one", "two"], ["two", "one"], [], []]
    sets = shingle_sets([" ".join(t) for t in texts])
    sims = [simhash.majority(simhash.shingle_set(" ".join(t).encode(), 5)) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for i in range(len(texts)):
        for j in range(i):
            if bin((sims[i] ^ sims[j]) & (1 << 64) - 1).count("1") <= 4 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((top(i), top(j)))
                root[high] = low
    found, _ = found_and_wanted(spark, texts)
    assert found == [top(i) for i in range(len(texts))] and sum(top(i) != i for i in range(len(texts))) > 40
