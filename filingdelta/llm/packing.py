"""Token ids packed into fixed rows by best-fit decreasing.

Documents are dealt to shards by a hash of doc_id and text, as many shards as the bytes of text call for, and each shard to
a task of its own. A shard is read in the order of doc_id and packed in blocks of a bounded number of tokens, so memory
does not depend on the shard. Within a block, segments go longest first into the
fullest row that still takes them, which a segment tree over the free room finds in logarithmic time.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from filingdelta.llm.common import parts_of, share

#: Fixed value: the published split pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEGMENTS = "segments array<struct<doc_id:long,first:long,length:int>>"
ROW = f"shard int, block int, row int, n_tokens int, input_ids binary, cu_seqlens array<int>, position_ids binary, {SEGMENTS}"
MATRIX = f"shard int, block int, matrix int, n_rows int, n_tokens long, ids binary, positions binary, cu_seqlens array<long>, {SEGMENTS}"


class Encoder:
    """Byte-level BPE to two-byte little-endian ids, with a bounded memo of the ids of what stands between spaces.

    The split pattern always ends a piece before a space that follows a non-space, so such chunks encode apart. Texts with
    two spaces in a row, or a space at the start, are encoded whole."""

    def __init__(self, ranks: bytes, memo_size: int = 300_000):
        pairs = (line.split() for line in ranks.splitlines() if line)
        table = {base64.b64decode(a): int(b) for a, b in pairs}
        if max(table.values()) >= 65_535:
            raise ValueError("ids must fit two bytes")
        self.end = max(table.values()) + 1
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.memo: dict[str, bytes] = {}
        self.memo_size = memo_size

    def raw(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), dtype="<u2").tobytes()

    def encode(self, text: str) -> bytes:
        if not text or text[0] == " " or "  " in text:
            return self.raw(text)
        first, *rest = text.split(" ")
        memo = self.memo
        if len(memo) > self.memo_size:
            memo.clear()
        found = list(map(memo.get, rest))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    w = rest[i]
                    found[i] = memo[w] = memo.get(w) or self.raw(" " + w)
        return self.raw(first) + b"".join(found)

    def decode(self, ids: bytes) -> str:
        return self.bpe.decode([int(i) for i in np.frombuffer(ids, dtype="<u2") if i != self.end])


class Rooms:
    """Rows by free room 0..size: a segment tree over the room marks where there is a row."""

    def __init__(self, size: int):
        self.base = 1
        while self.base <= size:
            self.base *= 2
        self.any = bytearray(2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.base
        while i and not self.any[i]:
            self.any[i] = 1
            i //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, its room) of the row with the least room of at least need; None if there is none."""
        i = need + self.base
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.base
        row = self.rows[room].pop()
        if not self.rows[room]:
            while i and not (i < self.base and (self.any[2 * i] or self.any[2 * i + 1])):
                self.any[i] = 0
                i //= 2
        return row, room


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of indices of lengths (each from 1 to size), at most `size` in sum; ties go in the order given."""
    rooms, rows = Rooms(size), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        if (found := rooms.take(lengths[k])) is None:
            rows.append([])
            found = len(rows) - 1, size
        rows[found[0]].append(k)
        rooms.put(found[1] - lengths[k], found[0])
    return rows


class Packer:
    """Packs the documents of a shard, given in order, block by block."""

    def __init__(self, ranks: bytes, row_length: int, block_tokens: int):
        self.encoder = Encoder(ranks)
        self.end = np.array([self.encoder.end], dtype="<u2").tobytes()
        self.row_length, self.block_tokens = row_length, block_tokens

    def blocks(self, rows):
        """(shard, block, packed rows) from (doc_id, text, shard): each packed row is a list of (doc_id, first, ids)."""
        shard, block, held, segments = None, 0, 0, []
        step = 2 * self.row_length
        for doc, text, s in rows:
            if segments and (s != shard or held >= self.block_tokens):
                yield shard, block, self.packed(segments)
                block, held, segments = block + 1, 0, []
            if s != shard:
                shard, block = s, 0
            ids = self.encoder.encode(text or "") + self.end
            segments += [(doc, at // 2, ids[at : at + step]) for at in range(0, len(ids), step)]
            held += len(ids) // 2
        if segments:
            yield shard, block, self.packed(segments)

    def packed(self, segments):
        return [[segments[k] for k in members] for members in best_fit_decreasing([len(x) // 2 for _, _, x in segments], self.row_length)]


def positions_of(sizes: list[int]) -> bytes:
    """0, 1, ... for each segment anew."""
    return np.concatenate([np.arange(n, dtype="<u2") for n in sizes]).tobytes()


def as_row(shard: int, block: int, at: int, parts: list) -> tuple:
    sizes = [len(x) // 2 for _, _, x in parts]
    cu = [0, *np.cumsum(sizes).tolist()]
    return shard, block, at, cu[-1], b"".join(x for _, _, x in parts), cu, positions_of(sizes), [{"doc_id": d, "first": f, "length": n} for (d, f, _), n in zip(parts, sizes, strict=True)]


def as_matrix(shard: int, block: int, at: int, rows: list[list], row_length: int, pad: int) -> tuple:
    """Rows stacked to n_rows x row_length ids; the padding of a row is a segment of positions and cu_seqlens without a
    document."""
    ids, sizes, segments = [], [], []
    fill = np.array([pad], dtype="<u2").tobytes()
    tokens = 0
    for parts in rows:
        own = [len(x) // 2 for _, _, x in parts]
        gap = row_length - sum(own)
        ids += [*(x for _, _, x in parts), fill * gap]
        sizes += own + [gap] * (gap > 0)
        tokens += sum(own)
        segments += [{"doc_id": d, "first": f, "length": n} for (d, f, _), n in zip(parts, own, strict=True)]
    return shard, block, at, len(rows), tokens, b"".join(ids), positions_of(sizes), [0, *np.cumsum(sizes).tolist()], segments


def shards_of(docs: DataFrame, vocabulary: str, row_length: int, shard_bytes: int, block_tokens: int, made, schema: str, batch_rows: int) -> DataFrame:
    """made(shard, block, rows of the block) gives the result's rows. Shards are dealt by their number, one to a task."""
    spark = docs.sparkSession
    if not 1 <= row_length <= 65_535:
        raise ValueError("row_length must be from 1 to 65535")
    ranks = share(spark, read_file(spark, vocabulary))
    size = docs.agg(F.sum(F.octet_length("text") + 8), F.count("*")).first()
    shards = max(1, -(-max(size[0] or 0, 8 * size[1]) // shard_bytes))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int")
    dealt = docs.select("doc_id", "text", place.alias("shard")).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", F.xxhash64("text"))
    kind = T._parse_datatype_string(schema)

    def run(batches):
        types = to_arrow_schema(kind)
        out = []

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)

        rows = (r for batch in parts_of(batches) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for shard, block, packed in Packer(ranks.value, row_length, block_tokens).blocks(rows):
            for x in made(shard, block, packed):
                out.append(x)
                if len(out) >= batch_rows:
                    yield batch_of()
                    out.clear()
        if out:
            yield batch_of()

    return dealt.mapInArrow(run, kind)


def pack(docs: DataFrame, vocabulary: str, row_length: int = 2048, shard_bytes: int = 16 << 20, block_tokens: int = 2_000_000) -> DataFrame:
    """Packed rows of the whole texts of docs, each document followed by the end id.

    Documents of more than row_length ids are split into segments that tile them, without loss. A result row has
    input_ids and position_ids (two-byte little-endian, n_tokens each; positions start at 0 in each segment), cu_seqlens
    (0 and the cumulative segment lengths) and segments (doc_id, index of its first id in the document, length). Null and
    empty texts are the end id alone. Repeated rows and null doc_ids are packed like any other row."""

    def made(shard, block, packed):
        return (as_row(shard, block, at, parts) for at, parts in enumerate(packed))

    return shards_of(docs, vocabulary, row_length, shard_bytes, block_tokens, made, ROW, 1_000)


def matrices(docs: DataFrame, vocabulary: str, row_length: int = 2048, rows_per_matrix: int = 512, pad: int = 0, shard_bytes: int = 16 << 20, block_tokens: int = 2_000_000) -> DataFrame:
    """The rows of pack() stacked to id matrices, of rows_per_matrix rows at most: ids (n_rows x row_length two-byte ids,
    filled up with pad), positions (0 starts a segment or the padding), cu_seqlens (flat cumulative segment lengths, the
    padding of a row counting as one) and the segments of documents in order; n_tokens without padding."""

    def made(shard, block, packed):
        return (as_matrix(shard, block, at // rows_per_matrix, packed[at : at + rows_per_matrix], row_length, pad) for at in range(0, len(packed), rows_per_matrix))

    return shards_of(docs, vocabulary, row_length, shard_bytes, block_tokens, made, MATRIX, 1)


def write_packed(docs: DataFrame, vocabulary: str, path: str, **parameters: int) -> None:
    """Write the matrices of docs, one Parquet row each."""
    matrices(docs, vocabulary, **parameters).write.parquet(path)


def read_file(spark: SparkSession, path: str) -> bytes:
    """A small file: from the driver's disk, or from any store that Spark reads if the path has a scheme."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()
