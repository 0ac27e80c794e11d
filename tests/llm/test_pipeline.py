import os
import re

import corpus_pipeline
import numpy as np
import sentencepiece

from filingdelta.llm import decontamination, language_id, simhash
from filingdelta.llm.queries import TOKENIZERS, oracle_sql, queries
from filingdelta.storage import work_folder

from test_near_copies import brute, shingle_sets
from test_text_operators import brute_language, brute_leaks, brute_lines


def texts_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_stages_against_brute_force(spark, sf, tmp_path):
    """Every stage of the whole small table against a version without its operator."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before, seen = docs.columns, docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert sorted(after.columns) == sorted(columns)
        seen[name], before = (before, after), after
    given, kept = (texts_of(x) for x in seen["language_id"])
    languages = {r["doc_id"]: r["lang"] for r in docs.collect()}
    import zlib

    rows = [(i, language_id.words_of((t or "").encode()), languages[i], zlib.crc32(str(i).encode()) % 4 == 2) for i, t in given.items()]
    told = brute_language(rows)
    assert {i for i in given if told[i] == "und"} & set(kept) == set() and all(given[i] == t for i, t in kept.items())
    assert {i for i, t in given.items() if len(re.findall(r"[A-Za-z]{3,}", t or "")) >= 20} <= set(kept)  # clean prose stays
    given, kept = (texts_of(x) for x in seen["line_dedup"])
    want = brute_lines(list(given.items()), 40, 5)
    assert {i: t or "" for i, t in kept.items()} == {i: w[2] for i, w in want.items()}
    given, kept = (texts_of(x) for x in seen["near_dedup"])
    ids = sorted(given)
    assert set(kept) == {ids[c] for c in brute(shingle_sets([given[i] or "" for i in ids]))} and all(given[i] == t for i, t in kept.items())
    given, kept = (texts_of(x) for x in seen["decontamination"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    shorter = {i: t for i, t in given.items() if len(t or "") < 3_000}
    leaked = {i for i, _ in brute_leaks(list(shorter.items()), items)}
    assert set(shorter) - set(kept) == leaked and leaked
    found = {r["doc_id"] for r in decontamination.find_leaks(seen["decontamination"][0], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert set(kept) == set(given) - found
    given, made = texts_of(seen["sentencepiece"][0]), {r["doc_id"]: r for r in seen["sentencepiece"][1].collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    import hashlib

    for i, t in given.items():
        ids = np.array(sp.encode(t) if t else [], dtype="<u2")
        assert made[i]["n_tokens"] == len(ids) and made[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest() and made[i]["round_trip"]
    before = set(os.listdir(work_folder(spark))) if os.path.isdir(work_folder(spark)) else set()
    whole = {tuple(r) for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {tuple(r) for r in made.values()}
    left = {n.rpartition("-")[0] for n in set(os.listdir(work_folder(spark))) - before}
    assert not {n for n in left if n.startswith("stage-")}


def run_on(spark, docs, tmp_path, name):
    folder = tmp_path / name
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(folder / "benchmark.parquet"))
    return corpus_pipeline.run(spark, str(folder))


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    found = sorted(((r["doc_id"] is None, r["doc_id"]), r["n_tokens"], r["round_trip"]) for r in run_on(spark, odd, tmp_path, "odd").collect())
    # blank and letterless texts go, of the two copies 5 and 6 the first stays, and one of the repeated rows 7
    assert [i for (_, i), _, _ in found] == [4, 5, 7, 8, None] and all(n > 0 for _, n, _ in found)
    assert [ok for (_, i), _, ok in found if i == 8] == [False] and all(ok for (_, i), _, ok in found if i != 8)  # U+2581 comes back as a space
    assert run_on(spark, empty, tmp_path, "empty").count() == 0


def test_near_copies_of_a_larger_table(spark):
    """Exact components of 1,000 documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(texts_of(docs).items())
    want = brute(shingle_sets([t or "" for _, t in rows]))
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    assert found == {rows[i][0]: rows[c][0] for i, c in enumerate(want)} and len(set(want)) < len(rows)


def test_names():
    assert set(oracle_sql()) <= set(queries()) and "pipeline" in queries() and len(queries()) == 11
