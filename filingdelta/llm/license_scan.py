"""Licence scan with a positional index of rare words.

A notice is posted under its words of the highest inverse document frequency, and a file is looked up by all posted words
that are in it. Their postings (template, offset) are intersected by relative position: occurrences that put a template at
the same start support each other. A template counts if enough of it stands at that start and its mandatory phrases stand
there too.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingdelta.llm.common import map_columns, share

#: A-Z to a-z, other ASCII except digits and letters to a space, bytes of other characters as they are.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Opening words of well-known licence notices: label, text, mandatory phrases.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3", ["gnu general public license", "either version 3"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["distribute this software for any purpose"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0", "creative commons zero 1 0 universal public domain dedication", ["creative commons zero"]),
]


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORDS).split() if text else []


def find_all(words: list[bytes], phrase: list[bytes], start: int, end: int) -> bool:
    """Whether phrase stands somewhere in words[start:end]."""
    n = len(phrase)
    return any(words[i] == phrase[0] and words[i : i + n] == phrase for i in range(max(0, start), min(end, len(words)) - n + 1))


def document_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[int, Counter]:
    """(number of documents, documents that hold each word), over all of docs."""

    def maker():
        def body(texts):
            counts: Counter = Counter()
            for t in texts:
                counts.update(vocabulary.intersection(words_of(t)))
            counts[b""] = len(texts)
            return [[w.decode() for w in counts], list(counts.values())]

        return body

    rows = map_columns(docs.select("text"), maker, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = Counter({r["word"].encode(): r["n"] for r in rows})
    return found.pop(b"", 0), found


class Index:
    """Postings of the rarest words of every phrase and notice."""

    def __init__(self, n_docs: int, df: Counter, rare: int = 6, notices: list | None = None):
        notices = NOTICES if notices is None else notices
        self.idf = {}
        split = [(label, words_of(text.encode()), [words_of(p.encode()) for p in must]) for label, text, must in notices]
        self.phrases = [(label, words_of(p.encode())) for p, label in BASE.items()]
        for words in [w for _, w, _ in split] + [w for _, w in self.phrases]:
            self.idf |= {w: math.log((1 + n_docs) / (1 + df[w])) for w in words}
        rank = lambda w: (-self.idf[w], w)
        self.notices = split
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, (_, words, _) in enumerate(split):
            for w in sorted(set(words), key=rank)[:rare]:
                self.postings.setdefault(w, []).extend((t, q) for q, x in enumerate(words) if x == w)
        self.anchors: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(self.phrases):
            w = min(words, key=rank)
            self.anchors.setdefault(w, []).append((k, words.index(w)))
        self.known = frozenset(self.postings) | frozenset(self.anchors)

    def scan(self, text: bytes | None, coverage: float, slack: int):
        words = words_of(text)
        base: list[tuple[int, str]] = []
        labels: dict[str, float] = {}
        spans: list[tuple[str, int, int]] = []
        if not self.known.isdisjoint(words):
            places: dict[bytes, list[int]] = {}
            for i, w in enumerate(words):
                if w in self.known:
                    places.setdefault(w, []).append(i)
            for w, hits in self.anchors.items():
                for k, q in hits:
                    label, phrase = self.phrases[k]
                    for p in places.get(w, ()):
                        if p >= q and words[p - q : p - q + len(phrase)] == phrase:
                            base.append((p - q, label))
                            spans.append((label, p - q, p - q + len(phrase)))
            votes: Counter = Counter()
            for w, found in places.items():
                for t, q in self.postings.get(w, ()):
                    for p in found:
                        votes[t, p - q] += 1
            for (t, start), n in votes.items():
                label, notice, must = self.notices[t]
                if n < 2:
                    continue
                share = sum(0 <= start + q < len(words) and words[start + q] == w for q, w in enumerate(notice)) / len(notice)
                if share >= coverage and all(find_all(words, m, start - slack, start + len(notice) + slack) for m in must):
                    labels[label] = max(labels.get(label, 0.0), share)
                    spans.append((label, max(0, start), min(len(words), start + len(notice))))
        return len(words), base, labels, spans


def scan(docs: DataFrame, coverage: float = 0.7, slack: int = 4, rare: int = 6, notices: list | None = None) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one per row of docs.

    Inverse document frequencies count every document. Each notice is posted under its `rare` words of the highest
    IDF, and a file is looked up by all posted words in it; a notice needs two of its own at one relative position,
    `coverage` of its words there and every mandatory phrase within `slack` words. The base phrases are anchored at their rarest word, all of whose places are looked up, so every base
    place is found. score is 1 with a base place, else the largest covered share, else 0. Null and empty texts have no
    words, empty label strings, null places and score 0; repeated rows are scanned each; spans are (label, from, to)."""
    texts = [text for _, text, _ in (NOTICES if notices is None else notices)] + list(BASE)
    vocabulary = {w for t in texts for w in words_of(t.encode())}
    index = share(docs.sparkSession, Index(*document_frequencies(docs, vocabulary), rare=rare, notices=notices))

    def maker():
        own = index.value

        def body(ids, column):
            out: list[list] = [ids, [], [], [], [], [], [], [], []]
            for text in column:
                n, base, labels, spans = own.scan(text, coverage, slack)
                found = sorted({label for _, label in base})
                values = (n, len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(found), ",".join(sorted({*found, *labels})), 1.0 if base else max(labels.values(), default=0.0), [{"label": a, "start": b, "end": c} for a, b, c in sorted(set(spans))])
                for o, v in zip(out[1:], values, strict=True):
                    o.append(v)
            return out

        return body

    return map_columns(docs.select("doc_id", "text"), maker, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long>>")
