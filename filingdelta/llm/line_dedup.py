"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of line hashes, dealt into buckets and sorted in them. Each batch of documents merges its own sorted
hashes with the runs: the anti-join gives the lines that no run holds, which become a run of level 0 with the largest
doc_id of the batch that holds them; for the others only the number of their documents is added. Batches go from the
largest doc_ids down, so the run that holds a line first names the document that keeps it. When a level has `fanout` runs,
they are compacted into one run of the next level, so a hash is rewritten a logarithmic number of times. Runs are
bucketed tables: a batch is dealt out once, and no run is shuffled again.
"""

from __future__ import annotations

import struct
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingdelta.llm.common import ASCII_LOWER, Scratch, delete_path, freed_shuffles, map_columns, materialize, new_path, share, whole_row

SPACE = b" \t\n\x0b\x0c\r"
CONTINUES = bytes(range(0x80, 0xC0))
RUN = "h1 long, h2 long, n_docs long, last_doc long"


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).translate(ASCII_LOWER)


def line_hash(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """128-bit hash of a line's key as two longs; None if the key is shorter than min_chars code points."""
    if len(line) < min_chars:
        return None
    key = line_key(line)
    if len(key) < min_chars or len(key.translate(None, CONTINUES)) < min_chars:
        return None
    return struct.unpack("<qq", xxhash.xxh3_128_digest(key))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Rows (doc_id, h1, h2): the distinct keys of each row of docs that has a doc_id."""

    def maker():
        def body(ids, texts):
            owners, first, second = [], [], []
            for i, text in zip(ids, texts, strict=True):
                for h in {h for line in (text or b"").split(b"\n") if (h := line_hash(line, min_chars))}:
                    owners.append(i)
                    first.append(h[0])
                    second.append(h[1])
            return owners, first, second

        return body

    return map_columns(docs.filter("doc_id is not null").select("doc_id", "text"), maker, "doc_id long, h1 long, h2 long")


class Runs:
    """The levelled runs, in the shared folder and known to the session's catalog until the block ends. A run has the lines
    that were new in its batch (fresh) and, apart from them, counts of lines that an older run holds. Old runs are deleted
    once a compaction has replaced them."""

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.made: dict[str, str] = {}
        self.compactions = 0

    def __enter__(self) -> Runs:
        return self

    def __exit__(self, *_) -> None:
        for name in list(self.made):
            self.drop(name)

    def drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        delete_path(self.spark, self.made.pop(name))

    def write(self, rows: DataFrame) -> str:
        path = new_path(self.spark, "run")
        name = "run_" + path.rpartition("-")[2]
        self.made[name] = path
        with freed_shuffles(self.spark):
            dealt = rows.repartition(self.buckets, "h1", "h2")
            dealt.write.partitionBy("fresh").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name

    @property
    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def fresh(self, name: str) -> DataFrame:
        return self.spark.table(name).filter("fresh = 1").select("h1", "h2", "n_docs", "last_doc")

    def new_lines(self, lines: DataFrame) -> DataFrame:
        """The rows of a batch (h1, h2, ...) whose line no run holds: merge anti-joins with the runs."""
        for name in self.names:
            lines = lines.hint("merge").join(self.fresh(name).select("h1", "h2"), ["h1", "h2"], "left_anti")
        return lines

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (doc_id, h1, h2), distinct, whose doc_ids are smaller than those of the batches before."""
        counted = lines.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        held = None
        for name in self.names:  # at most fanout - 1 a level
            counted = counted.hint("merge").join(self.fresh(name).select("h1", "h2", F.lit(1).alias("old")), ["h1", "h2"], "left")
            held = F.col("old").isNotNull() if held is None else F.col("held") | F.col("old").isNotNull()
            counted = counted.withColumn("held", held).drop("old")
        fresh = F.lit(1) if held is None else F.when(F.col("held"), 0).otherwise(1)
        path, level = self.write(counted.select("h1", "h2", "n_docs", "last_doc", fresh.alias("fresh"))), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(path)
            if len(self.levels[level]) < self.fanout:
                return
            old, self.levels[level] = self.levels[level], []
            path, level = self.write(self.merged(old)), level + 1
            self.compactions += 1
            for name in old:
                self.drop(name)

    def merged(self, names: list[str]) -> DataFrame:
        """One row for each line of these runs; a line that one of them has as fresh is fresh."""
        each = [self.spark.read.schema(RUN + ", fresh int").parquet(self.made[name]) for name in names]
        rows = reduce(DataFrame.unionByName, each)
        return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max_by("last_doc", F.struct("fresh", "last_doc")).alias("last_doc"), F.max("fresh").alias("fresh"))

    def all(self) -> DataFrame:
        """Rows (h1, h2, n_docs, last_doc): one for each line of all batches, with its documents and the largest doc_id."""
        if not self.names:
            return self.spark.createDataFrame([], RUN)
        return self.merged(self.names).select("h1", "h2", "n_docs", "last_doc")


def batches_of(docs: DataFrame, batches: int) -> list[int]:
    """The doc_ids at which a batch ends, but for the last: about `batches` equal parts by doc_id."""
    cuts = docs.filter("doc_id is not null").agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    return sorted(set(cuts or []))


def distinct_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """hashed_lines, rows of one doc_id being one document."""
    lines = hashed_lines(docs, min_chars)
    several = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    return lines if several.isEmpty() else lines.distinct()


def repeated_lines(lines: DataFrame, docs: DataFrame, min_docs: int, batches: int, fanout: int, tmp: Scratch) -> DataFrame:
    """Rows (h1, h2, n_docs, last_doc) of the lines that min_docs documents hold, kept in tmp: every batch merges with the
    runs of those before it and adds its own."""
    spark = docs.sparkSession
    cuts = batches_of(docs.select("doc_id"), batches)
    batch = sum(((F.col("doc_id") <= c).cast("int") for c in cuts), F.lit(0))  # 0: the largest doc_ids
    table = tmp.path("lines")
    with freed_shuffles(spark):
        lines.withColumn("batch", batch).write.partitionBy("batch").parquet(table)
    stored = spark.read.schema("doc_id long, h1 long, h2 long, batch int").parquet(table)
    with Runs(spark, fanout) as runs:
        for b in range(len(cuts) + 1):
            runs.add(stored.filter(F.col("batch") == b).select("doc_id", "h1", "h2"))
        often = tmp.keep(runs.all().filter(F.col("n_docs") >= min_docs), "often")
    tmp.drop("lines")
    return often


class Repeated:
    """The repeated lines, sorted, with the document that keeps each."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, keeper: np.ndarray):
        order = np.lexsort((h2, h1))
        self.h1, self.h2, self.keeper = h1[order], h2[order], keeper[order]

    def goes(self, owners: list[int], hashes: list[tuple[int, int]]) -> np.ndarray:
        """Whether the line of each (owner, hash) goes from its owner."""
        out = np.zeros(len(hashes), dtype=bool)
        if len(hashes) and len(self.h1):
            own, (a, b) = np.array(owners), np.array(hashes, dtype=np.int64).T
            at = np.searchsorted(self.h1, a)
            while (open_ := np.flatnonzero((at < len(self.h1)) & ~out)).size:  # equal h1 but for another h2: hardly ever twice
                open_ = open_[self.h1[at[open_]] == a[open_]]
                out[open_] = (self.h2[at[open_]] == b[open_]) & (self.keeper[at[open_]] != own[open_])
                at = np.where(np.isin(np.arange(len(at)), open_), at + 1, len(self.h1))
        return out


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 6, fanout: int = 4, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Rows (_row, n_lines, n_dropped, kept), one per row of docs, _row being the whole row.

    A text is split at \\n; a line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at
    least min_chars code points that at least min_docs documents hold lose all their lines except in the largest doc_id.
    Null and empty texts are one empty line, which stays. Rows with a null doc_id neither count as holders nor lose
    lines; rows of one doc_id are one document. The documents are taken in `batches` parts, whatever their number, so the
    number of jobs is fixed. Up to broadcast_rows repeated lines (24 bytes each) are sent to all executors, and every
    document is cleaned where it is read; beyond, what each document loses is joined by line and then by doc_id."""
    spark = docs.sparkSession
    packed = whole_row(docs, F.col("doc_id").alias("_k"), F.col("text").alias("_t"))

    def cleaned(texts, lost) -> pd.DataFrame:
        """lost(texts): for each text the lines to drop, as booleans, or None."""
        out = []
        for text, drop in zip(texts, lost, strict=True):
            lines = text.split("\n")
            kept = lines if drop is None else [x for x, gone in zip(lines, drop, strict=True) if not gone]
            out.append((len(lines), len(lines) - len(kept), text if drop is None else "\n".join(kept)))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])

    with Scratch(spark) as tmp:
        lines = distinct_lines(docs, min_chars)
        often = repeated_lines(lines, docs, min_docs, batches, fanout, tmp)
        if often.count() <= broadcast_rows:
            found = often.select("h1", "h2", "last_doc").toArrow()
            shared = share(spark, Repeated(*(found.column(k).to_numpy() for k in range(3))))

            @F.pandas_udf("n_lines long, n_dropped long, kept string")
            def keep(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
                texts = [t or "" for t in texts]
                owners, hashes, places = [], [], []
                for row, (i, text) in enumerate(zip(ids, texts, strict=True)):
                    if not pd.isna(i) and len(text) >= min_chars:
                        for at, line in enumerate(text.split("\n")):
                            if len(line) >= min_chars and (h := line_hash(line.encode(), min_chars)):
                                owners.append(int(i))
                                hashes.append(h)
                                places.append((row, at))
                lost: list[np.ndarray | None] = [None] * len(texts)
                for k in np.flatnonzero(shared.value.goes(owners, hashes)).tolist():
                    row, at = places[k]
                    if lost[row] is None:
                        lost[row] = np.zeros(texts[row].count("\n") + 1, dtype=bool)
                    lost[row][at] = True
                return cleaned(texts, lost)

            # a double would lose the last digits of a large doc_id next to a null
            return packed.select("_row", keep(F.col("_k").cast("string"), "_t").alias("_o")).select("_row", "_o.n_lines", "_o.n_dropped", "_o.kept")
        gone = lines.join(often.select("h1", "h2", "last_doc"), ["h1", "h2"]).filter("doc_id <> last_doc")
        gone = materialize(gone.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("hashes")), "dropped")

    @F.pandas_udf("n_lines long, n_dropped long, kept string")
    def drop(texts: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        texts, lost = [t or "" for t in texts], []
        for text, own in zip(texts, hashes, strict=True):
            bad = {(h["h1"], h["h2"]) for h in own} if own is not None else set()
            lost.append([line_hash(x.encode(), min_chars) in bad for x in text.split("\n")] if bad else None)
        return cleaned(texts, lost)

    joined = packed.join(gone.select(F.col("doc_id").alias("_g"), "hashes"), F.col("_k") == F.col("_g"), "left")
    return joined.select("_row", drop("_t", "hashes").alias("_o")).select("_row", "_o.n_lines", "_o.n_dropped", "_o.kept")


def drop_repeated_lines(docs: DataFrame, **parameters: int) -> DataFrame:
    """docs, all columns, with the repeated lines gone from text (null stays null) and n_chars, where there is one, set
    to the new length."""
    rows = dedup_lines(docs, **parameters)
    text = F.when(F.col("_row.text").isNotNull(), F.col("kept")).alias("text")
    size = F.when(F.col("_row.text").isNotNull(), F.length("kept")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None
    types = dict(docs.dtypes)
    return rows.select(*[text if c == "text" else size.cast(types[c]).alias(c) if c == "n_chars" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
