"""Labels, spans and scores of the licence scan against a search of every place."""

import math
import random
import re

from filingdelta.llm import license_scan

DOCS = "doc_id long, text string"


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_scan(texts, coverage=0.7, slack=4, rare=6):
    """Every notice at every start: two of its rare words in place, enough words in place, all phrases near."""
    split = {i: plain_words(t) for i, t in texts.items()}
    df = {}
    for words in split.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    idf = lambda w: math.log((1 + len(texts)) / (1 + df.get(w, 0)))
    has = lambda words, phrase: any(words[k : k + len(phrase)] == phrase for k in range(len(words) - len(phrase) + 1))
    out = {}
    for i, words in split.items():
        base = {label for phrase, label in license_scan.BASE.items() if has(words, phrase.split())}
        found, spans = {}, set()
        for label, notice, must in license_scan.NOTICES:
            own = notice.split()
            posted = sorted(set(own), key=lambda w: (-idf(w), w))[:rare]
            for start in range(-len(own) + 1, len(words)):
                equal = [0 <= start + q < len(words) and words[start + q] == w for q, w in enumerate(own)]
                near = words[max(0, start - slack) : start + len(own) + slack]
                if sum(e and w in posted for e, w in zip(equal, own, strict=True)) >= 2 and sum(equal) >= coverage * len(own) and all(has(near, m.split()) for m in must):
                    found[label] = max(found.get(label, 0), sum(equal) / len(own))
                    spans.add((label, max(0, start), min(len(words), start + len(own))))
        out[i] = (",".join(sorted(base | set(found))), 1.0 if base else max(found.values(), default=0.0), spans)
    return out


def same_as_plain(found, want):
    for i, (labels, score, spans) in want.items():
        r = found[i]
        assert r["labels"] == labels and abs(r["score"] - score) < 1e-12, (i, labels, r["labels"])
        assert spans <= {tuple(s) for s in r["spans"]}


def test_file_with_every_notice(spark):
    """A file of several licence texts has the labels and places of each of them."""
    texts = [text for _, text, _ in license_scan.NOTICES]
    filler = " and further words about nothing "
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, filler.join(texts))]
    found = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, DOCS)).collect()}
    at, want = 0, set()
    for label, text, _ in license_scan.NOTICES:
        size = len(text.split())
        want.add((label, at, at + size))
        at += size + len(filler.split())
    assert want <= {tuple(s) for s in found[100]["spans"]}
    assert set(found[100]["labels"].split(",")) == {label for label, _, _ in license_scan.NOTICES}
    for i, (label, _, _) in enumerate(license_scan.NOTICES):
        assert label in found[i]["labels"].split(",")
    same_as_plain(found, plain_scan(dict(rows)))


def test_changed_notices_against_plain_search(spark):
    """Notices with words changed, dropped and put in, some cut off at the start or end of the file."""
    rng = random.Random(4)
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(1, 3)):
            own = rng.choice(license_scan.NOTICES)[1].split()
            for _ in range(rng.randint(0, len(own) // 3)):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice([[], ["changed"], [own[k], "more"], [own[k].upper()]])
            words += [f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 6))] + own[rng.choice([0, 0, 2]) :]
        rows.append((i, " ".join(words)))
    found = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, DOCS)).collect()}
    want = plain_scan(dict(rows))
    same_as_plain(found, want)
    assert len({labels for labels, _, _ in want.values()}) > 10 and any(0 < score < 1 for _, score, _ in want.values()) and any(not labels for labels, _, _ in want.values())


def test_table_against_plain_search(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect() if len(r["text"] or "") < 20_000}
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    same_as_plain({r["doc_id"]: r for r in license_scan.scan(docs).collect()}, plain_scan(texts))


def test_odd_rows_by_value(spark, odd):
    found = [r for r in license_scan.scan(odd).collect() if r["doc_id"] in (1, 2, 3, 7)]
    assert len(found) == 5 and {(r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) for r in found} == {(0, None, None, "", "", 0.0)}
    assert [r["n_words"] for r in found if r["doc_id"] != 7] == [0, 0, 0]
