"""Incremental term counts of a stream of documents: each micro-batch appends its own counts, by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from filingdelta.operators.similarity import term_counts


def append_term_counts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes (doc_id, term, tf) of each micro-batch under path/batch=N; a batch that is replayed replaces its own files, so
    every document counts once."""

    def write(batch: DataFrame, number: int) -> None:
        term_counts(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
