"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingdelta.llm import decontamination, language_id, license_scan, line_dedup, packing, quality, sentencepiece_lattice, simhash, toxicity, warc
from filingdelta.llm.common import Scratch, materialize

#: Where the vocabulary files are; a parameter of the environment they run in.
TOKENIZERS = os.environ.get("FILINGDELTA_TOKENIZERS", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "toxic", F.round("score", 6).alias("score"), F.round(F.col("probabilities")["poor"], 6).alias("poor_score"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "round_trip")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as tmp:
        path = tmp.path("archives")
        warc.write_archives(table(spark, sf_dir, "pages"), path, min_bytes=0)
        return materialize(warc.read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "digests")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.matrices(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return made.select("shard", "block", "matrix", "n_rows", "n_tokens", "cu_seqlens", F.col("segments.doc_id").alias("doc_ids"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return rows.select(F.col("_row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cascade(table(spark, sf_dir, "documents"), statistics=quality.STATISTICS).drop("rejected_by", "steps")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 6))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = (op1_toxicity, op2_sentencepiece, op3_simhash, op4_license_scan, op5_warc, op6_packing, op7_line_dedup, op8_quality, op9_decontamination, op10_language_id)
    return {f.__name__: f for f in named} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
            d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
            b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda k:
                    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                      ((('0x' || substr(hex, (5 * (k // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
                    max(page_id) OVER (PARTITION BY hex, payload_bytes) AS keeper FROM d)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to FROM b""",
        "op7_line_dedup": r"""
            WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                              generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
            k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
            r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
            m AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key)
            SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
            FROM m GROUP BY doc_id""",
        "op8_quality": r"""
            WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
            w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
            g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS pos, words FROM w WHERE len(words) >= 3),
            h AS (SELECT doc_id, pos, words[pos] || ' ' || words[pos + 1] || ' ' || words[pos + 2] AS gram FROM g),
            c AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM h),
            e AS (SELECT DISTINCT doc_id, pos + s AS place FROM (SELECT doc_id, pos, unnest([0, 1, 2]) AS s FROM c WHERE n >= 2)),
            q AS (SELECT doc_id, count(*)::BIGINT AS n FROM e GROUP BY doc_id),
            s AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(q.n, 0)::BIGINT AS n_repeat_words,
                         len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words,
                         coalesce(list_max(map_values(list_histogram(words))), 0) AS n_top_word,
                         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut_lines,
                         len(lines) AS n_lines FROM w LEFT JOIN q ON w.doc_id = q.doc_id),
            v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
            SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
                   NOT base_failed AND n_symbols <= n_words AND 2 * n_dup_lines <= n_lines
                   AND word_chars >= 2 * n_words AND word_chars <= 20 * n_words AND 10 * n_letter_words >= 6 * n_words
                   AND 10 * n_top_word <= 3 * n_words AND 10 * n_cut_lines <= 3 * n_lines AS kept FROM v""",
    }
