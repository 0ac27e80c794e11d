"""A training corpus from `documents`: language ID, line deduplication, near-deduplication, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingdelta.llm import decontamination, language_id, line_dedup, sentencepiece_lattice, simhash
from filingdelta.llm.queries import TOKENIZERS
from filingdelta.storage import Scratch, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, learned from the labelled ones among them that are not held out. Null, empty
    and letterless texts go; of equal scores the alphabetically first language counts, which keeps the document as well;
    repeated rows are judged each; without a label nothing is learned and all go."""
    return language_id.keep_identified(docs, language_id.fit(docs.filter(~language_id.held_out())))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more of them share, but for the last to hold one. No row goes: null texts
    stay null, a text of such lines only becomes empty. Rows of one doc_id are one document, those without a doc_id stay."""
    return line_dedup.drop_repeated_lines(docs, min_chars=40, min_docs=5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: links are pairs whose five-word shingles have a Jaccard of 0.8 or more. The
    multi-index over SimHashes finds those near to each other, a join by shingles those further apart.
    The smallest doc_id stays; blank texts are copies of each other; rows without a doc_id stay; of repeated rows one does."""
    return simhash.drop_near_duplicates(docs, words=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts and items hold nothing; repeated rows are judged each."""
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids, as a digest. Null and empty texts have no ids; repeated rows are encoded each."""
    found = sentencepiece_lattice.encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "round_trip")


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", decontaminate), ("sentencepiece", encode)]

#: Language models, fingerprints and merges are not SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, stored; the tables between the stages are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as tmp:
        for k, (name, stage) in enumerate(STAGES[:-1]):
            docs = tmp.keep(stage(spark, docs, sf_dir), f"stage-{name}")
            if k:
                tmp.drop(f"stage-{STAGES[k - 1][0]}")
        return materialize(STAGES[-1][1](spark, docs, sf_dir), "corpus")
