import random
import re

import pytest
import xxhash

from filingdelta.llm import simhash


def brute_print(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    items = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in items]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


def test_fingerprint_is_spark_hash(spark):
    assert spark.sql("select xxhash64('a b c d') x").first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_whole_table_against_brute_force(spark, documents):
    rows = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    prints = [brute_print(t, 4) for _, t in rows]
    roots = brute_components(prints, 4)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents, words=4).select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id").collect()}
    assert found == {i: (f"{p:016x}", rows[r][0]) for (i, _), p, r in zip(rows, prints, roots, strict=True)}


@pytest.mark.parametrize(("segments", "limit"), [(3, 64), (2, 64), (3, 1), (4, 3)])
def test_links_against_brute_force(spark, segments, limit):
    rng = random.Random(segments * 100 + limit)
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(12)})
    signed = [simhash.signed(p) for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, segments, limit)
    label = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    got = {}
    for i, p in enumerate(signed):
        got.setdefault(label.get(p, p), set()).add(i)
    want = {}
    for i, r in enumerate(brute_components(prints, 4)):
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_odd_rows(spark, odd, empty):
    found = simhash.near_duplicates(odd, words=4).collect()
    assert len(found) == odd.count()
    by = {r["doc_id"]: r["component_id"] for r in found}
    assert by[5] == by[6] == 5 and by[1] == by[2] == by[3] == 1 and by[4] == 4 and by[7] == 7 and by[8] == 8
    assert sorted(str(r['component_id']) for r in found if r['doc_id'] is None) == ['1', 'None']
    blank = [r for r in found if r["fp"] == 0]
    assert {r["component_id"] for r in blank} == {1} and len(blank) == 4
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(odd).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == sorted([1, 4, 5, 7, 8, None, None], key=str)
    assert simhash.drop_near_duplicates(odd).columns == odd.columns
    assert simhash.drop_near_duplicates(odd.filter("doc_id < 7")).select("doc_id").orderBy("doc_id").collect() == [(1,), (4,), (5,)]


def similar(a, b):
    return len(a & b) / len(a | b)


def test_near_copies_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(5_000)]
    texts, clean = [], 30
    for _ in range(clean):
        texts.append([rng.choice(vocabulary) for _ in range(rng.randint(150, 400))])
    for i in range(60):
        copy = list(texts[i % 15])
        for at in rng.sample(range(len(copy)), max(1, len(copy) * (i % 4) // 100)):
            copy[at] = rng.choice(vocabulary)
        texts.append(copy)
    for i in range(15, 30):  # half of another document: not a near copy
        texts.append(texts[i][: len(texts[i]) // 2] + [rng.choice(vocabulary) for _ in range(len(texts[i]) // 2)])
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in enumerate(texts)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    want = [(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j]) >= 0.8]
    assert len(want) > 60 and sum(found[i] == found[j] for i, j in want) >= 0.97 * len(want)
    group = {}
    for i, c in found.items():
        group.setdefault(c, []).append(i)
    for members in group.values():  # nothing joins a group without a near relation in it
        assert all(any(similar(sets[i], sets[j]) >= 0.55 for j in members if j != i) for i in members if len(members) > 1)
    assert all(found[i] == i for i in range(90, 105))


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500)], "a long, b long")
    label = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    assert label == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_hex(spark):
    assert spark.createDataFrame([(-1,), (0,), (10,)], "fp long").select(simhash.hex_of()).collect() == [("f" * 16,), ("0" * 16,), ("0" * 15 + "a",)]
