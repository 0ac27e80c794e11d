"""WARC archives, written and read by Spark alone.

Writing: each task joins its records to volumes of a bounded number of bytes, and the text writer makes a file of each.
Payloads that repeat become revisit records.

Reading: a task offers, for every place that looks like the start of a record, the offset of the record that would
follow. Payloads may hold such places too. Only what pointer jumping reaches from the start of a file is a record, and only
of those are the headers read and the digests taken.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from filingdelta.llm.common import Scratch, freed_shuffles, materialize, small, work_folder
from filingdelta.session import ship

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
LENGTH = re.compile(rb"\r\nContent-Length: (\d{1,18})\r\n")
RECORD = "file string, at long, next long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sha1_base32(payload: Column) -> Column:
    """Base32 of the SHA-1 of a column: five hex digits are four characters."""
    digest = F.sha1(payload)
    out = []
    for k in range(0, 40, 5):
        n = F.conv(F.substring(digest, k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def records(pages: DataFrame, tmp: Scratch, min_bytes: int = 0, broadcast_rows: int = 200_000) -> DataFrame:
    """Rows (record string), one per row of pages (page_id, url, html); a null html is an empty payload.

    Of the records with equal payloads of at least min_bytes, that with the largest page_id is a response and the others
    revisit it; all other records are responses. Rows that repeat the largest page_id are responses each; a null page_id
    revisits its group's response if there is one. Only payloads that repeat are joined back; that side is sent to all
    executors up to broadcast_rows of it."""
    html = F.coalesce("html", F.lit(""))
    size = F.octet_length(html).cast("long")
    slim = pages.select("page_id", size.alias("n"), sha1_base32(html).alias("digest"))
    groups = slim.filter(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("keeper"), F.count("*").alias("k"))
    repeated = small(tmp.keep(groups.filter("k > 1 and keeper is not null").select("digest", F.col("n").alias("gn"), "keeper"), "payloads"), broadcast_rows)
    full = pages.select("page_id", F.regexp_replace("url", r"[\x00-\x20]", "%20").alias("url"), html.alias("body"), size.alias("n"), sha1_base32(html).alias("d"))
    joined = full.join(repeated, (F.col("d") == F.col("digest")) & (F.col("n") == F.col("gn")), "left")
    joined = joined.withColumn("revisit", F.col("keeper").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("keeper"), F.lit(False)))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("d")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("keeper").cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Original-Length: "), F.col("n").cast("string"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(F.col("revisit"), F.lit("0")).otherwise(F.col("n").cast("string"))),
    )
    return joined.select(F.concat(head, F.lit(END), F.when(F.col("revisit"), F.lit("")).otherwise(F.col("body"))).alias("record"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, volume_bytes: int = 32 << 20) -> None:
    """Write pages to WARC files under path, of volume_bytes and one record at most."""
    spark = pages.sparkSession
    ship(spark)

    def volumes(batches):
        held, size = [], 0
        for batch in batches:
            for record in batch.column(0).cast(pa.binary()):
                held.append(record.as_py())
                size += len(held[-1]) + len(END)
                if size >= volume_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([END.encode().join(held)]).cast(pa.string())], names=["record"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([END.encode().join(held)]).cast(pa.string())], names=["record"])

    with Scratch(spark) as tmp, freed_shuffles(spark):
        joined = records(pages, tmp, min_bytes).mapInArrow(volumes, "record string")
        joined.write.option("lineSep", END).option("maxRecordsPerFile", 1).text(path)


def header(block: bytes, name: bytes) -> bytes | None:
    at = block.find(b"\r\n" + name + b": ")
    return None if at < 0 else block[at + len(name) + 4 : (end if (end := block.find(b"\r\n", at + 2)) >= 0 else None)]


def number(urn: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d{1,19})>", urn or b"")
    return int(m[1]) if m else None


def candidates(content: bytes):
    """(offset, offset of the successor) of everything in a file that could be a record. The places of header ends and of
    lengths only move on, so a file is read once however many such places it has."""
    at, end, length = content.find(MAGIC), -1, None
    while at >= 0:
        if end < at and (end := content.find(b"\r\n\r\n", at)) < 0:
            return
        if length is None or length.start() < at:
            if (length := LENGTH.search(content, at)) is None:
                return
        if length.start() < end:
            following = end + 4 + int(length[1]) + 4
            if following <= len(content) and content[following - 4 : following] == b"\r\n\r\n":
                yield at, following
        at = content.find(MAGIC, at + 1)


def parsed(content: bytes, at: int, following: int):
    """(fields, payload) of the record from at to following."""
    end = content.index(b"\r\n\r\n", at)
    block, payload = content[at : end + 2], content[end + 4 : following - 4]
    kind = (header(block, b"WARC-Type") or b"").decode("latin-1")
    if kind == "revisit":
        size, digest = int(header(block, b"WARC-Original-Length") or 0), (header(block, b"WARC-Payload-Digest") or b"").removeprefix(b"sha1:").decode("latin-1")
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    url = header(block, b"WARC-Target-URI")
    return (number(header(block, b"WARC-Record-ID")), url.decode("utf-8", "replace") if url is not None else None, size, digest, kind, number(header(block, b"WARC-Refers-To"))), payload


def reachable(chain: DataFrame) -> DataFrame:
    """Rows (file, at) that are reached from offset 0 of a file, of chain (file, at, next).

    Pointer jumping: each round adds what one jump leads to from all that is reached, and doubles the jumps, so a chain
    of n records takes about log2 n rounds."""
    work_folder(chain.sparkSession)
    jump = chain.select("file", "at", "next").checkpoint()
    reached = jump.filter("at = 0").select("file", "at").checkpoint()
    while True:
        onward = reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        reached = reached.union(onward).distinct().checkpoint()
        then = jump.select("file", F.col("at").alias("next"), F.col("next").alias("then"))
        jump = jump.join(then, ["file", "next"]).select("file", "at", F.col("then").alias("next")).checkpoint()
        if jump.isEmpty():
            return reached


def read_archives(spark: SparkSession, path: str, payloads: bool = True, broadcast_files: int = 20_000) -> DataFrame:
    """The records of all WARC files under path: file, at, next, page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and, with payloads, payload (empty for revisits). Digests of responses are taken from what was read. A file
    without a record at its start has none; what a damaged record cuts off is not returned. A file is read as one row, so
    it must be smaller than 2 GB.

    The offsets of the records found are sent to all executors for up to broadcast_files files; beyond, they and the files
    are dealt by file."""
    ship(spark)
    schema = T._parse_datatype_string(RECORD + ", payload binary" * payloads)
    offsets = T._parse_datatype_string("file string, at long, next long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def offer(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = list(candidates(content.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), *(pa.array([x[k] for x in found], pa.int64()) for k in range(2))], schema=to_arrow_schema(offsets))

    def read(batches):
        out = to_arrow_schema(schema)
        for batch in batches:
            for file, content, ats, nexts in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in range(1, 4)), strict=True):
                content, rows, size = content.as_py(), [], 0
                for at, following in zip(ats.as_py(), nexts.as_py(), strict=True):
                    fields, payload = parsed(content, at, following)
                    rows.append((file, at, following, *fields, *([payload] if payloads else [])))
                    size += len(payload) * payloads
                    if size > 8 << 20 or len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    with Scratch(spark) as tmp:
        offered = tmp.keep(files.mapInArrow(offer, offsets), "candidates")
        chain = offered.join(reachable(offered), ["file", "at"], "left_semi")
        of_file = chain.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("at", "next"))).alias("r"))  # as many as a file holds
        of_file = materialize(of_file.select("file", F.col("r.at").alias("ats"), F.col("r.next").alias("nexts")), "records")
    joined = files.join(small(of_file, broadcast_files), F.col("path") == F.col("file")).select("path", "content", "ats", "nexts")
    return joined.mapInArrow(read, schema)
