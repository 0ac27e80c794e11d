"""Quality rules as a short-circuit cascade.

A rule rejects a document. The cost of each rule and the share it rejects are estimated on a bounded sample; the rules
then run in the order of rejection per cost, and a document meets no further rule once one has rejected it. The order
decides how much work is done, never what is kept.

Cost is counted, not timed, so that the same sample always gives the same order: a step for each 64 bytes of a pass over
the text by one library call, and a step for each word or line that Python handles. What a caller asks for of every
document anyway (`statistics`) costs a rule nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingdelta.llm.common import map_columns

SYMBOLS = b"#*$%&|<>"
CONTINUES = bytes(range(0x80, 0xC0))  # UTF-8 continuation bytes: what a byte count has over a count of code points


#: What is left of a word after these bytes go has a letter in it.
NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())


class Doc:
    """A text and what rules ask about it, each worked out once, when it is first asked for. spent counts the steps."""

    def __init__(self, text: bytes | None):
        self.text = text or b""
        self.spent = 0.0

    def scan(self, passes: int = 1) -> None:
        self.spent += passes * len(self.text) / 64

    @cached_property
    def words(self) -> list[bytes]:
        self.scan(4)  # makes an object for each word
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        self.scan(2)
        return len(b"".join(self.words).translate(None, CONTINUES))

    @cached_property
    def n_symbols(self) -> int:
        self.scan()
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        out = self.text.split(b"\n")
        self.scan()
        self.spent += len(out)
        return [x for x in out if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        self.spent += len(self.lines)
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        self.spent += 3 * n
        if n < 4:
            return 0
        number: dict[bytes, int] = {}
        at = number.setdefault
        ids = np.fromiter((at(w, len(number)) for w in self.words), dtype=np.int64, count=n)
        pairs = ids[:-1] * len(number) + ids[1:]
        if len(number) > 2_000_000:  # else three factors fit in 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * len(number) + ids[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        again = np.zeros(n - 2, dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        return int(covered.sum())

    @cached_property
    def n_letter_words(self) -> int:
        """Words with a letter A-Z, a-z or a character beyond ASCII."""
        self.spent += 2 * self.n_words
        return sum(1 for w in self.words if w.translate(None, NO_LETTERS))

    @cached_property
    def n_top_word(self) -> int:
        """Places of the most frequent word."""
        self.spent += 2 * self.n_words
        return max(Counter(self.words).values(), default=0)

    @cached_property
    def n_cut_lines(self) -> int:
        """Lines that end in an ellipsis, white space aside."""
        self.spent += 2 * len(self.lines)
        return sum(1 for x in self.lines if x.rstrip().endswith((b"...", b"\xe2\x80\xa6")))

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


Rule = tuple[str, Callable[[Doc], bool]]

#: (name, whether it rejects).
RULES: list[Rule] = [
    ("too_short", lambda d: d.n_words < 50),
    ("repeats", lambda d: 100 * d.n_repeat_words > 50 * d.n_words),
    ("symbols", lambda d: d.n_symbols > d.n_words),
    ("duplicate_lines", lambda d: 2 * d.n_dup_lines > len(d.lines)),
    ("short_words", lambda d: d.word_chars < 2 * d.n_words),
    ("long_words", lambda d: d.word_chars > 20 * d.n_words),
    ("few_letters", lambda d: 10 * d.n_letter_words < 6 * d.n_words),
    ("one_word", lambda d: 10 * d.n_top_word > 3 * d.n_words),
    ("cut_lines", lambda d: 10 * d.n_cut_lines > 3 * len(d.lines)),
]
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def estimate(docs: DataFrame, rules: list[Rule], sample_size: int = 1_000, statistics: tuple[str, ...] = ()) -> dict[str, tuple[float, float]]:
    """{rule: (steps a document, share rejected)} over a sample of about sample_size documents, drawn by hash."""
    n = docs.count()
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < min(1.0, sample_size / max(1, n)) * 1_000_000)

    def maker():
        def body(texts):
            cost, hits = [0.0] * len(rules), [0] * len(rules)
            for text in texts:
                for k, (_, rejects) in enumerate(rules):
                    doc = Doc(text)
                    for name in statistics:
                        getattr(doc, name)
                    before = doc.spent
                    hits[k] += rejects(doc)
                    cost[k] += 1 + doc.spent - before
            return [[name for name, _ in rules], cost, hits, [len(texts)] * len(rules)]

        return body

    rows = map_columns(drawn.select("text"), maker, "rule string, cost double, hits long, n long").groupBy("rule").agg(F.sum(F.round("cost", 3)).alias("cost"), F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()
    found = {r["rule"]: (r["cost"] / r["n"], r["hits"] / r["n"]) for r in rows if r["n"]}
    return {name: found.get(name, (1.0, 0.0)) for name, _ in rules}


def ordered(rules: list[Rule], estimates: dict[str, tuple[float, float]]) -> list[Rule]:
    """By rejection per cost, the largest first; of those that rejected nothing the cheapest; ties by name."""
    return sorted(rules, key=lambda r: (-round(estimates[r[0]][1] / estimates[r[0]][0], 9), round(estimates[r[0]][0], 6), r[0]))


def cascade(docs: DataFrame, rules: list[Rule] | None = None, sample_size: int = 1_000, statistics: tuple[str, ...] = (), order: list[Rule] | None = None) -> DataFrame:
    """Rows (doc_id, kept, rejected_by, steps) and the statistics asked for, one row per row of docs.

    kept is false if a rule rejects; rejected_by names the first that did in the order that the sample gave (or in
    `order`), and the rules after it were not tried; steps counts the work on the document. statistics are columns of
    STATISTICS that every row gets. Whole texts are read. A null or empty text has no words and fails too_short. Repeated
    rows are judged each."""
    rules = RULES if rules is None else rules
    order = ordered(rules, estimate(docs, rules, sample_size, statistics)) if order is None else order

    def maker():
        def body(ids, texts):
            kept, by, steps, asked = [], [], [], [[] for _ in statistics]
            for text in texts:
                doc = Doc(text)
                for values, name in zip(asked, statistics, strict=True):
                    values.append(getattr(doc, name))
                found = next((name for name, rejects in order if rejects(doc)), None)
                kept.append(found is None)
                by.append(found)
                steps.append(doc.spent)
            return [ids, *asked, kept, by, steps]

        return body

    kinds = ", ".join(f"{name} {'boolean' if name == 'base_failed' else 'long'}" for name in statistics)
    return map_columns(docs.select("doc_id", "text"), maker, f"doc_id long, {kinds + ', ' if kinds else ''}kept boolean, rejected_by string, steps double")
