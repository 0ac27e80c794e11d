"""SentencePiece encoding as a relational lattice, and decoding.

A text may be cut between two characters that no piece has side by side: nothing spans such a place. All such cuts are
made, so a document is a sequence of chunks, and equal chunks are segmented once. Every chunk's substrings up to the
longest piece are exploded and joined to the piece table; the matches are the edges of the chunk's lattice, grouped by
chunk; and Viterbi is folded over them with `aggregate`: each place keeps the one edge that its best path ends with.

* unigram models: the best path has the largest sum of scores.
* BPE models: scores are merge ranks, and the largest sum of them is not the encoding. An encoding is the path of which
  BPE leaves every two neighbours apart, and each place has exactly one edge that its path can end with. So the fold
  keeps, of the edges that end at a place, the one that may follow the edge kept at its start: no piece across the border
  between the two would have been merged while its parts stood there.

Chunks that are frequent in a sample (a bounded number) are segmented first and sent to all executors. A document is encoded
where it is read, with holes for its other chunks. Those are segmented once for the whole corpus, joined by chunk, and fill
the holes by doc_id.
"""

from __future__ import annotations

import struct
from collections import Counter
from dataclasses import dataclass
from functools import cached_property
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from filingdelta.llm.common import HOLDERS, Scratch, free_tables, map_columns, materialize, share
from filingdelta.llm.packing import read_file

SPACE = "▁"
#: Chunks of at most this many characters keep an edge of a BPE lattice in one long: its end (6 bits), WIDEST less its
#: length (4), the place where its last merge joined its two parts (6), its rank (16), and the lengths, from two characters
#: to the whole, of the beginnings and of the ends that its merges passed through (15 bits each). No piece may be longer
#: than WIDEST.
SHORT = 60
WIDEST, RANKS, STEPS = 16, 16, 15
#: Longer chunks of BPE models, such as a run of one letter, are merged in Python by themselves: a lattice of theirs would be
#: a row without bound.
LONG = 2_000


def bytes_of(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, where each string starts and, last, where all end)."""
    ends = np.frombuffer(strings.buffers()[1], dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return np.frombuffer(strings.buffers()[2] or b"", dtype=np.uint8), ends


def runs_from(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of sizes[0] numbers, then the same of the next."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


#: An odd base, whose powers have inverses modulo 2^64.
BASE = 0x5851F42D4C957F2D


def powers_of(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


#: Powers by byte place of a block of strings, and their inverses; longer blocks make their own.
POWERS, INVERSES = powers_of(BASE, 1 << 18), powers_of(pow(BASE, -1, 1 << 64), 1 << 18)


def hashes_of(data: np.ndarray, ends: np.ndarray, block: int = 20_000) -> np.ndarray:
    """A 64-bit hash of each string: a polynomial of its bytes, as a difference of sums over its block, taken back to place 0.
    Blocks of strings are taken one by one, as a byte takes many in between."""
    out = np.empty(len(ends) - 1, dtype=np.uint64)
    for at in range(0, len(out), block):
        own = ends[at : at + block + 1] - ends[at]
        n = int(own[-1]) + 1
        up, down = (POWERS, INVERSES) if n <= len(POWERS) else (powers_of(BASE, n), powers_of(pow(BASE, -1, 1 << 64), n))
        sums = np.zeros(n, dtype=np.uint64)
        np.cumsum((data[ends[at] : ends[at] + n - 1].astype(np.uint64) + np.uint64(1)) * up[: n - 1], out=sums[1:])
        out[at : at + block] = (sums[own[1:]] - sums[own[:-1]]) * down[own[:-1]]
    h = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Known:
    """The frequent chunks, sent as Arrow arrays: where each has its ids in one long array. A worker makes its tables once
    for all its tasks, and drops those of the call before. Chunks are looked up by hash, many at once, and compared."""

    TOP = 20

    def __init__(self, chunks: pa.Array, ids: pa.Array, ok: pa.Array, width: int):
        self.chunks, self.ids, self.ok, self.width = chunks, ids, ok, width

    def ready(self) -> Known:
        free_tables(but=self)
        if self not in HOLDERS:
            HOLDERS.append(self)
        return self

    def free(self) -> None:
        for made in ("sorted", "own_bytes", "flat", "starts", "sizes", "wrong"):
            self.__dict__.pop(made, None)

    @cached_property
    def own_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        return bytes_of(self.chunks)

    @cached_property
    def sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes in order, their chunks, where the hashes of each beginning start)."""
        hashes = hashes_of(*self.own_bytes)
        order = np.argsort(hashes)
        tops = (hashes[order] >> np.uint64(64 - self.TOP)).astype(np.int64)
        return hashes[order], order, np.searchsorted(tops, np.arange((1 << self.TOP) + 1))

    def places(self, names: pa.StringArray) -> np.ndarray:
        """Where the chunks are here, -1 for those that are not."""
        out = np.full(len(names), -1, dtype=np.int64)
        if not len(names) or not len(self.chunks):
            return out
        data, ends = bytes_of(names)
        hashes, order, tops = self.sorted
        asked = hashes_of(data, ends)
        beginning = (asked >> np.uint64(64 - self.TOP)).astype(np.int64)
        at, last = tops[beginning], tops[beginning + 1]
        active = np.flatnonzero(at < last)
        while len(active):
            equal = hashes[at[active]] == asked[active]
            out[active[equal]] = order[at[active[equal]]]
            active = active[~equal]
            at[active] += 1
            active = active[at[active] < last[active]]
        found = np.flatnonzero(out >= 0)
        if len(found):
            same = pc.equal(names.take(pa.array(found)), self.chunks.take(pa.array(out[found])))
            out[found[~same.to_numpy(zero_copy_only=False)]] = -1
        return out

    @cached_property
    def flat(self) -> np.ndarray:
        return np.frombuffer(b"".join(self.ids.to_pylist()), dtype=f"<u{self.width}")

    @cached_property
    def sizes(self) -> np.ndarray:
        """The number of ids of each chunk; the last entry is for a chunk that is not here."""
        return np.append(pc.binary_length(self.ids).to_numpy(zero_copy_only=False) // self.width, 0).astype(np.int64)

    @cached_property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    @cached_property
    def wrong(self) -> np.ndarray:
        """Whether the chunk does not decode to itself; the last entry is for a chunk that is not here."""
        return np.append(~self.ok.to_numpy(zero_copy_only=False).astype(bool), False)

    def spell(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of a sequence of chunks by their places, where the ids of each end)."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(sizes.sum())
        return self.flat[runs_from(self.starts[at], sizes)] if total else self.flat[:0], ends


@dataclass
class Pieces:
    """A piece table: names and scores by id, the ids of normal pieces, of the 256 byte pieces, of the unknown piece."""

    names: list[str]
    scores: list[float]
    normal: list[int]
    bytes_at: list[int]
    unknown: int
    bpe: bool

    def __post_init__(self):
        self.ids = {self.names[i]: i for i in reversed(self.normal)}
        self.longest = max((len(self.names[i]) for i in self.normal), default=1)
        order = sorted(self.normal, key=lambda i: (-self.scores[i], i))
        self.rank = {self.names[i]: r for r, i in enumerate(order)}
        self.width = 2 if len(self.names) <= 65_536 else 4
        self.joined = {n[k : k + 2] for n in self.ids for k in range(len(n) - 1)}
        #: Whether edges of BPE chunks fit one long.
        formed = {p: r if len(p) > 1 else -1 for p, r in self.rank.items()}  # characters are there from the start
        self.fits = self.bpe and self.longest <= WIDEST and len(order) < 1 << RANKS and all(r > max(formed.get(p[:k], -1), formed.get(p[k:], -1)) for p, k in self.merges().items() for r in [formed[p]])

    def merges(self) -> dict[str, int]:
        """{piece: length of the left part of its last merge}, of the pieces that BPE makes of their own characters."""
        rank, out = self.rank, {}
        for piece in self.ids:
            parts = list(piece)
            while len(parts) > 1:
                ways = [(r, k) for k in range(len(parts) - 1) if (r := rank.get(parts[k] + parts[k + 1])) is not None]
                if not ways:
                    break
                k = min(ways)[1]
                out_of = len(parts[k])
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                if len(parts) == 1:
                    out[piece] = out_of
        return out

    def cut_long(self, text: str) -> list[int]:
        """Boundaries that BPE leaves in a text of any length: the best pair of neighbours is merged until none is a piece.
        Memory and time grow with the text, the latter by a logarithm more."""
        n = len(text)
        size, before = [1] * n, list(range(-1, n - 1))
        ways: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = i + size[i]
            if j < n and (r := self.rank.get(text[i : j + size[j]])) is not None:
                heappush(ways, (r, i, size[i], size[j]))

        for i in range(n):
            offer(i)
        while ways:
            _, i, a, b = heappop(ways)
            if size[i] == a and i + a < n and size[i + a] == b:
                size[i], size[i + a] = a + b, 0
                if i + a + b < n:
                    before[i + a + b] = i
                offer(i)
                if before[i] >= 0:
                    offer(before[i])
        return [i for i in range(n) if size[i]] + [n]

    def codes(self) -> list[tuple[str, int, int]]:
        """(piece, length of the left part of its last merge, rank and steps as bits) of the pieces of two characters or
        more that BPE can give."""
        left = self.merges()
        first: dict[str, int] = {}
        last: dict[str, int] = {}
        for piece in sorted(left, key=len):
            k = left[piece]
            a, b = piece[:k], piece[k:]
            first[piece] = first.get(a, 0) | 1 << len(piece) - 2
            last[piece] = last.get(b, 0) | 1 << len(piece) - 2
        return [(p, k, self.rank[p] << 2 * STEPS | first[p] << STEPS | last[p]) for p, k in left.items()]

    def ids_of(self, piece: str) -> list[int]:
        """A piece's id; bytes, or the unknown id, for what is no piece."""
        if (i := self.ids.get(piece)) is not None:
            return [i]
        return [self.bytes_at[b] for b in piece.encode("utf-8", "replace")] if self.bytes_at else [self.unknown]

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def unpack(self, ids: bytes) -> list[int]:
        return np.frombuffer(ids, dtype=f"<u{self.width}").tolist()

    def decoder(self):
        """A function from packed ids to text. Byte pieces are joined before they are read as UTF-8."""
        table = [n.replace(SPACE, " ").encode() for n in self.names]
        for b, i in enumerate(self.bytes_at):
            table[i] = bytes([b])
        kind = f"<u{self.width}"

        def decode(ids: bytes, whole: bool = True) -> str:
            """Of a whole text, or of a part, which has no leading space to lose."""
            out = b"".join(map(table.__getitem__, np.frombuffer(ids, dtype=kind).tolist()))
            return (out[1:] if whole and out[:1] == b" " else out).decode("utf-8", "replace")

        return decode


def load_pieces(spark, path: str, bpe: bool | None = None) -> Pieces:
    """The pieces of a model file. Only models whose normalizer leaves text as it is, apart from the space put in front,
    are taken. Without bpe, a model whose scores fall by exactly one from piece to piece is taken for a BPE model."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=read_file(spark, path))
    if sp.normalize(" Ａ  x ") != f"{SPACE}{SPACE}Ａ{SPACE}{SPACE}x{SPACE}":
        raise ValueError("the model normalizes text; only an identity normalizer with a leading space is supported")
    n = sp.get_piece_size()
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
    normal = [i for i in range(n) if not special[i]]
    scores = [sp.get_score(i) for i in range(n)]
    steps = Counter(scores[a] - scores[b] for a, b in zip(normal, normal[1:], strict=False))
    guess = steps.most_common(1)[0][0] == 1.0 and steps[1.0] > 0.9 * len(normal)
    return Pieces([sp.id_to_piece(i) for i in range(n)], scores, normal, sorted(i for i in range(n) if sp.is_byte(i)), sp.unk_id(), guess if bpe is None else bpe)


class Cutter:
    """Cuts texts into chunks, many texts at once: characters become numbers and pairs are looked up in a table."""

    SEP, DOC = "\uffff", "\ufffe"  # noncharacters; a text that has one is cut by itself

    def __init__(self, pieces: Pieces, block: int = 200_000):
        letters = sorted({c for pair in pieces.joined for c in pair} - {self.SEP, self.DOC})
        self.number = np.zeros(0x110000, dtype=np.uint16)
        for n, c in enumerate(letters, 1):
            self.number[ord(c)] = n
        self.stays = np.zeros((len(letters) + 1, len(letters) + 1), dtype=bool)
        for a, b in pieces.joined:
            self.stays[self.number[ord(a)], self.number[ord(b)]] = True
        self.stays[0, :] = self.stays[:, 0] = False
        self.columns = self.number.astype(np.int32)
        self.rows = self.columns * len(self.stays)
        self.joined, self.block = pieces.joined, block

    def cut(self, texts: list[str]) -> list[list[str]]:
        """The chunks of each text. A text starts with one space more than it has; an empty one has no chunks."""
        out: list[list[str]] = []
        held: list[str] = []
        size = 0
        for text in [*texts, None]:
            if text is None or size > self.block:
                if held:
                    out += self.many(held)
                held, size = [], 0
            if text is not None:
                held.append(text)
                size += len(text)
        return out

    def many(self, texts: list[str]) -> list[list[str]]:
        whole = self.DOC.join([SPACE + t for t in texts]).replace(" ", SPACE)
        if self.SEP in whole or whole.count(self.DOC) >= len(texts):
            return [self.one(t) for t in texts]
        codes = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        numbers = self.number[codes]
        cuts = np.flatnonzero(~self.stays[numbers[:-1], numbers[1:]]) + 1
        marked = np.insert(codes, cuts, ord(self.SEP)).tobytes().decode("utf-32-le")
        found = marked.split(self.SEP + self.DOC + self.SEP)
        return [f.split(self.SEP) if t else [] for f, t in zip(found, texts, strict=True)]

    def spans(self, texts: list[str]) -> pa.Array | None:
        """The chunks of all texts, none of them empty, as one Arrow array with a DOC between texts; made from byte places,
        without an object for each. None if a text has a DOC."""
        whole = self.DOC.join([SPACE + t for t in texts]).replace(" ", SPACE)
        if whole.count(self.DOC) >= len(texts):
            return None
        codes = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        pairs = self.rows.take(codes[:-1])
        pairs += self.columns.take(codes[1:])
        cuts = np.flatnonzero(~self.stays.reshape(-1).take(pairs)) + 1
        data = whole.encode()
        if len(data) > len(codes):
            cuts = np.flatnonzero((np.frombuffer(data, dtype=np.int8) >= -64))[cuts]  # the bytes that begin a character
        offsets = np.concatenate(([0], cuts, [len(data)])).astype(np.int32)
        return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))

    def one(self, text: str) -> list[str]:
        whole = SPACE + text.replace(" ", SPACE)
        cuts = [k for k in range(1, len(whole)) if whole[k - 1 : k + 1] not in self.joined]
        return [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)], strict=True)] if text else []


def count_chunks(docs: DataFrame, pieces: Pieces, flush: int = 32_000_000) -> DataFrame:
    """Rows (chunk, n) over all texts, counted in each task, for every `flush` characters, before they are dealt out."""
    schema = T._parse_datatype_string("chunk string, n long")
    shared = share(docs.sparkSession, pieces)

    def run(batches):
        out = to_arrow_schema(schema)
        cutter = Cutter(shared.value)
        held: list[pa.Array] = []
        size = 0

        def emit():
            counts = pa.chunked_array(held, pa.string()).value_counts()
            chunk, n = counts.field("values"), counts.field("counts")
            real = pc.not_equal(chunk, Cutter.DOC)
            return pa.RecordBatch.from_arrays([chunk.filter(real), n.filter(real)], schema=out)

        def blocks(texts):
            part: list[str] = []
            chars = 0
            for t in texts:
                part.append(t)
                chars += len(t)
                if chars > cutter.block:
                    yield part, chars
                    part, chars = [], 0
            if part:
                yield part, chars

        for batch in batches:
            for part, chars in blocks(t for t in batch.column(0).to_pylist() if t):
                found = cutter.spans(part)
                if found is None:  # a text has the sign itself, which counts as a chunk then
                    counts = Counter(c for t in part for c in cutter.one(t))
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=out)
                    continue
                held.append(found)
                size += chars
                if size > flush:
                    yield emit()
                    held.clear()
                    size = 0
        if held:
            yield emit()

    return docs.select("text").mapInArrow(run, schema).groupBy("chunk").agg(F.sum("n").alias("n"))


def lattice(chunks: DataFrame, pieces: Pieces) -> DataFrame:
    """Rows (chunk, n, size, edges): for each chunk its matches with the piece table, a long each: rank, start (24 bits),
    length (8 bits), or the short form of a BPE edge (see SHORT) for chunks of that size.

    chunks must be dealt out by chunk; the join keeps that, so the edges are grouped without another exchange. The join is
    on the pieces' 64-bit hash alone, so that Spark looks up longs; the piece itself is compared afterwards, as two
    bounds, since an equality would join the key."""
    spark = chunks.sparkSession
    short = {p: (k, c) for p, k, c in pieces.codes()} if pieces.fits else {}
    rows = [(p, r, *short.get(p, (0, -1))) for p, r in pieces.rank.items() if len(p) > 1 or not pieces.bpe]
    rows.append(("", -1, 0, -1))  # keeps chunks without a match
    table = spark.createDataFrame(rows, "name string, rank long, left int, code long").withColumn("h", F.xxhash64("name"))  # as large as the model's vocabulary
    least = 2 if pieces.bpe else 1
    last = F.col("size") - (least - 1)
    starts = chunks.select("chunk", "n").withColumn("size", F.char_length("chunk"))
    starts = starts.select("*", F.explode(F.concat(F.array(F.lit(-1)), F.when((last >= 1) & ((F.col("size") <= LONG) | F.lit(not pieces.bpe)), F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>")))).alias("i"))
    longest = F.least(F.lit(pieces.longest), F.col("size") - F.col("i"))
    spans = starts.select("chunk", "n", "size", "i", F.explode(F.when(F.col("i") < 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(least), longest))).alias("l"))
    piece = F.substring("chunk", F.when(F.col("i") < 0, F.lit(1)).otherwise(F.col("i") + 1), F.col("l"))
    spans = spans.select("chunk", "n", "size", "i", "l", piece.alias("piece")).withColumn("of", F.xxhash64("piece"))
    matched = spans.join(F.broadcast(table), (F.col("of") == F.col("h")) & (F.col("piece") <= F.col("name")) & (F.col("piece") >= F.col("name")))
    edge = F.when(F.col("rank") >= 0, F.shiftleft("rank", 32).bitwiseOR(F.shiftleft(F.col("i").cast("long"), 8)).bitwiseOR(F.col("l").cast("long")))
    if pieces.fits:
        place = F.shiftleft((F.col("i") + F.col("l")).cast("long"), 4).bitwiseOR((F.lit(WIDEST) - F.col("l")).cast("long"))
        place = F.shiftleft(place, 6).bitwiseOR((F.col("i") + F.col("left")).cast("long"))
        brief = F.when(F.col("code") >= 0, F.shiftleft(place, RANKS + 2 * STEPS).bitwiseOR(F.col("code")))
        edge = F.when(F.col("size") <= SHORT, brief).otherwise(edge)
    grouped = matched.groupBy("chunk", "n").agg(F.collect_list(edge).alias("edges"))
    return grouped.select("chunk", "n", F.char_length("chunk").alias("size"), "edges")


def start_of(e):
    return F.shiftright(e, 8).bitwiseAND(F.lit(0xFFFFFF)).cast("int")


def length_of(e):
    return e.bitwiseAND(F.lit(0xFF)).cast("int")


def merge_viterbi(size: str, edges: str):
    """Lengths of the edges that Viterbi keeps at the places 0 to size of a BPE lattice in the short form.

    Edges are folded by their end, the longest first and a lone character last. The kept edge of a place is the only one
    of those that end there whose border with the edge kept at its start stands. It stands unless some piece across it was
    merged there: one whose last merge joins its parts at the border, whose parts are steps of the merges of the left and
    of the right edge, and whose rank comes before the step after the one and not after the step after the other. Ranks
    grow with every merge (Pieces.fits), so the two parts stood side by side until then."""
    head = RANKS + 2 * STEPS
    never = F.lit(1 << RANKS)

    def end(e):
        return F.shiftright(e, head + 10).cast("int")

    def length(e):
        return WIDEST - F.shiftright(e, head + 6).bitwiseAND(F.lit(15)).cast("int")

    def rank(e):
        return F.shiftright(e, 2 * STEPS).bitwiseAND(F.lit((1 << RANKS) - 1)).cast("int")

    def steps(e):
        """Bits by length, the first character's among them."""
        return F.shiftleft(e.bitwiseAND(F.lit((1 << STEPS) - 1)).cast("int"), 2).bitwiseOR(F.lit(2))

    def bound(value, then):
        """then(value), value being worked out once."""
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def going_on(own, whole, longer, n, ends):
        """Rank of the step after that of length n, longer being the steps beyond it as bits and ends(its length) its end:
        never after the last one, mostly that of the whole edge."""
        more = n + 1 + F.bit_count(longer.bitwiseAND(-longer) - 1).cast("int")
        at = F.array_position(own["places"], F.call_function("shiftleft", ends(more), F.lit(4)).bitwiseOR(WIDEST - more)).cast("int")
        return F.when(longer == 0, never).when(longer.bitwiseAND(longer - 1) == 0, rank(whole)).otherwise(rank(F.get(own["edges"], at - 1)))

    def stands(own, a, b):
        """Whether BPE leaves the edges a and b apart."""
        at = end(b) - length(b)
        known = F.struct(at.alias("at"), F.shiftleft(at.cast("long"), head).alias("joint"), a.alias("left"), b.alias("right"), steps(a).alias("a"), steps(F.shiftright(b, STEPS)).alias("b"))

        def merged(k, c, x, y):
            ends_a = going_on(own, k["left"], F.call_function("shiftright", k["a"], x + 1), x, lambda n: k["at"])
            ends_b = going_on(own, k["right"], F.call_function("shiftright", k["b"], y + 1), y, lambda n: k["at"] + n)
            return (F.call_function("getbit", k["a"], x) == 1) & (rank(c) <= ends_b) & (rank(c) < ends_a)

        def across(k, c):
            y = end(c) - k["at"]  # most edges fail one of the first two tests, so the cheaper ones come first
            return (c.bitwiseAND(F.lit(63 << head)) == k["joint"]) & (F.call_function("getbit", k["b"], y) == 1) & merged(k, c, length(c) - y, y)

        return bound(known, lambda k: ~F.exists(own["edges"], lambda c: across(k, c)))

    def place(own, kept, e):
        """Places are kept in order: e is looked at if its end is the next one."""
        fits = (length(e) == 1) | (length(e) == end(e)) | stands(own, F.get(kept, end(e) - length(e)), e)
        return F.when((F.size(kept) == end(e)) & fits, F.concat(kept, F.array(e))).otherwise(kept)

    characters = F.transform(F.sequence(F.lit(1), F.col(size)), lambda i: F.call_function("shiftleft", F.call_function("shiftleft", i.cast("long"), F.lit(4)).bitwiseOR(F.lit(WIDEST - 1)), F.lit(head + 6)))
    own = F.struct(F.col(edges).alias("edges"), F.transform(edges, lambda e: F.shiftright(e, head + 6).cast("int")).alias("places"), F.sort_array(F.concat(edges, characters)).alias("all"))
    return bound(own, lambda own: F.aggregate(own["all"], F.array(F.lit(0).cast("long")), lambda kept, e: place(own, kept, e), lambda kept: F.transform(kept, length)))


def merge_long(size: int, edges: list[int]) -> list[int]:
    """BPE of a chunk that is too long for the short form, over a linked list: its edges in the order of rank, then start;
    an edge is taken if both its ends still are boundaries and just one boundary is between them, which goes."""
    after = list(range(1, size + 2))
    alive = [True] * (size + 1)
    for e in sorted(edges):
        a = e >> 8 & 0xFFFFFF
        b = a + (e & 0xFF)
        if alive[a] and alive[b] and (k := after[a]) < b and after[k] == b:
            alive[k] = False
            after[a] = b
    return [k for k in range(size + 1) if alive[k]]


def viterbi_fold(size: str, edges: str, scores: list[float], unknown_score: float):
    """Boundaries of the best path: best scores and back pointers are folded place by place; a character that is no piece
    is an edge of unknown_score. Ties go to the longest last piece."""
    table = F.array(*[F.lit(float(s)) for s in scores])

    def place(acc, end):
        ending = F.filter(edges, lambda e: start_of(e) + length_of(e) == end)
        ways = F.transform(ending, lambda e: F.struct((F.get(acc["best"], start_of(e)) + F.get(table, F.shiftright(e, 32).cast("int"))).alias("score"), (-start_of(e)).alias("from")))
        one = F.struct((F.get(acc["best"], end - 1) + F.lit(unknown_score)).alias("score"), (F.lit(1) - end).alias("from"))
        top = F.array_max(F.when(F.exists(ending, lambda e: length_of(e) == 1), ways).otherwise(F.concat(ways, F.array(one))))
        return F.struct(F.concat(acc["best"], F.array(top["score"])).alias("best"), F.concat(acc["back"], F.array(-top["from"])).alias("back"))

    first = F.struct(F.array(F.lit(0.0)).alias("best"), F.array(F.lit(-1)).alias("back"))
    back = F.aggregate(F.sequence(F.lit(1), F.col(size)), first, place, lambda acc: acc["back"])
    walk = F.aggregate(F.sequence(F.lit(1), F.col(size)), F.array(F.col(size)), lambda cuts, _: F.when(F.element_at(cuts, -1) > 0, F.concat(cuts, F.array(F.get(back, F.element_at(cuts, -1))))).otherwise(cuts))
    return F.reverse(walk)


def segment(chunks: DataFrame, pieces: Pieces) -> DataFrame:
    """Rows (chunk, n, ids, ok): the packed ids of the chunk and whether they decode to it."""
    spark = chunks.sparkSession
    edges = lattice(chunks, pieces)
    if pieces.bpe:
        short = (F.col("size") <= SHORT) & F.lit(pieces.fits)
        cuts = edges.select("chunk", "n", "size", F.when(short, merge_viterbi("size", "edges")).alias("kept"), F.when(~short, F.col("edges")).alias("edges"))
    else:
        order = sorted(pieces.normal, key=lambda i: (-pieces.scores[i], i))
        lowest = min(pieces.scores[i] for i in pieces.normal) - 10.0
        cuts = edges.select("chunk", "n", "size", viterbi_fold("size", "edges", [pieces.scores[i] for i in order], lowest).alias("path"))
    shared = share(spark, pieces)

    def maker():
        own = shared.value
        decode, normal = own.decoder(), own.ids.get

        def body(names, ns, sizes, *rest):
            out, right = [], []
            for k, (name, size) in enumerate(zip(names, sizes, strict=True)):
                text = name.decode("utf-8", "replace")
                if not own.bpe:
                    at = rest[0][k]
                elif (kept := rest[0][k]) is not None:
                    at = [size]
                    while at[-1]:
                        at.append(at[-1] - kept[at[-1]])
                    at.reverse()
                else:
                    at = merge_long(size, rest[1][k]) if size <= LONG else own.cut_long(text)
                parts = [text[a:b] for a, b in zip(at, at[1:], strict=False)]
                ids = list(map(normal, parts))
                if None not in ids:  # pieces spell what they stand for
                    out.append(own.pack(ids))
                    right.append(True)
                else:
                    out.append(own.pack([i for x in parts for i in own.ids_of(x)]))
                    right.append(decode(out[-1], False) == text.replace(SPACE, " "))
            return [names, ns, out, right]

        return body

    return map_columns(cuts, maker, "chunk string, n long, ids binary, ok boolean")


def with_holes(ids: bytes, at: list[int], which: list[int]) -> bytes:
    """The ids of a text but for those of its unknown chunks: the number of these holes, their places in bytes and what
    fills each (an index into the text's distinct unknown chunks), then the ids."""
    return np.array([len(at), *at, *which], dtype="<u4").tobytes() + ids


def fill_holes(packed: bytes, values: list[bytes]) -> bytes:
    n = int.from_bytes(packed[:4], "little")
    numbers = np.frombuffer(packed, dtype="<u4", count=2 * n, offset=4).tolist()
    body, out, before = packed[4 + 8 * n :], [], 0
    for at, k in zip(numbers[:n], numbers[n:], strict=True):
        out += [body[before:at], values[k]]
        before = at
    return b"".join([*out, body[before:]])


def encode(docs: DataFrame, model: str, dictionary_size: int = 300_000, sample: int = 20_000, bpe: bool | None = None) -> DataFrame:
    """Rows (doc_id, ids, n_tokens, round_trip), one per row of docs: the packed ids of the whole text (little-endian, two
    bytes each up to 65,536 pieces, else four) and whether they decode to it.

    Null and empty texts have no ids. Texts with the space sign U+2581 decode to spaces there, as the library does, so
    round_trip is false. Repeated rows are encoded each; null doc_ids too. The most frequent chunks of about `sample`
    documents, dictionary_size of them at most, are sent to the executors; all other chunks of all documents are joined, so
    neither bound changes a result. Texts are never shuffled: what is dealt by document are its ids and those of its rare
    chunks."""
    spark = docs.sparkSession
    pieces = load_pieces(spark, model, bpe)
    shared = share(spark, pieces)
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    alone = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()  # else the text tells rows apart
    hashed = docs.select("doc_id", key.alias("k"), (F.lit(0).cast("long") if alone else F.xxhash64("text")).alias("p"), "text")

    def chunks_of(cutter: Cutter, texts: list[bytes | None]):
        """(rows, distinct chunks, the chunk of each place of the rows' sequence, where a row ends in it), of the texts that
        are not empty, some hundred thousand characters at a time. Between two rows the sequence has a sign of its own."""
        part: list[int] = []
        size = 0
        for k, t in enumerate([*texts, None]):
            if t:
                part.append(k)
                size += len(t)
            if part and (size > cutter.block or k == len(texts)):
                decoded = [texts[i].decode("utf-8", "replace") for i in part]
                if (found := cutter.spans(decoded)) is None:  # a text has the sign itself
                    for i, chunks in zip(part, cutter.cut(decoded), strict=True):
                        coded = pa.array(chunks, pa.string()).dictionary_encode()
                        yield [i], coded.dictionary, coded.indices.to_numpy(), np.array([len(chunks)])
                else:
                    coded = found.dictionary_encode()
                    of = coded.indices.to_numpy()
                    ends = np.flatnonzero(of == pc.index(coded.dictionary, Cutter.DOC).as_py()) if len(part) > 1 else np.zeros(0, np.int64)
                    yield part, coded.dictionary, of, np.append(ends, len(of))
                part, size = [], 0

    def unknown_in(known: Known, names: pa.StringArray, of: np.ndarray, ends: np.ndarray):
        """(places of the names, places in the sequence that no known chunk and no sign between rows takes, their rows)."""
        at = known.places(names)
        strange = at < 0
        if len(ends) > 1:
            strange[of[ends[0]]] = False
        holes = np.flatnonzero(strange[of])
        return at, holes, np.searchsorted(ends, holes, "right")

    def segmented(chunks: DataFrame, name: str, rows: int = 20_000) -> DataFrame:
        """segment() of so many chunks a task: they are few bytes and much work."""
        chunks = tmp.keep(chunks, f"{name}-given")
        chunks = chunks.repartition(max(1, -(-chunks.count() // rows)), "chunk")
        threshold = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
        before = spark.conf.get(threshold)
        spark.conf.set(threshold, "200000")  # chunks of bounded size, in one task
        try:
            return tmp.keep(segment(chunks, pieces), name)
        finally:
            spark.conf.set(threshold, before)

    with Scratch(spark) as tmp:
        part = docs.sample(min(1.0, sample / max(1, docs.count())), 42)
        often = count_chunks(part, pieces).filter(F.char_length("chunk") <= SHORT).orderBy(F.desc("n"), "chunk").limit(dictionary_size)
        frequent = segmented(often, "frequent").select("chunk", "ids", "ok").toArrow()
        known = share(spark, Known(*(frequent.column(k).combine_chunks() for k in range(3)), pieces.width))

        def rare_of():
            cutter, own = Cutter(shared.value), known.value.ready()

            def body(keys, prints, texts):
                out: list[list] = [[], [], [], []]
                for rows, names, of, ends in chunks_of(cutter, texts):
                    _, holes, whose = unknown_in(own, names, of, ends)
                    distinct = np.unique(of[holes])
                    strange = dict(zip(distinct.tolist(), names.take(pa.array(distinct)).to_pylist(), strict=True))
                    seen: dict[tuple[int, int], None] = dict.fromkeys(zip(whose.tolist(), of[holes].tolist(), strict=True))
                    place, before = 0, -1
                    for row, i in seen:  # the distinct ones of each row, in order
                        place = place + 1 if row == before else 0
                        before = row
                        out[0].append(keys[rows[row]])
                        out[1].append(prints[rows[row]])
                        out[2].append(place)
                        out[3].append(strange[i])
                return out

            return body

        pairs = map_columns(hashed.select("k", "p", "text"), rare_of, "k long, p long, at int, chunk string", keep_tables=True)
        pairs = tmp.keep(pairs if alone else pairs.distinct(), "pairs")  # equal rows have equal chunks
        table = segmented(pairs.groupBy("chunk").agg(F.count("*").alias("n")), "chunks")
        rare = pairs.join(table.select("chunk", "ids", "ok"), "chunk").groupBy(F.col("k").alias("rk"), F.col("p").alias("rp"))
        rare = materialize(rare.agg(F.sort_array(F.collect_list(F.struct("at", "ids")))["ids"].alias("ids"), F.min("ok").alias("ok")), "rare")

    def holed():
        own, cutter = known.value.ready(), Cutter(shared.value)
        press = zstandard.ZstdCompressor(level=1)
        nothing = press.compress(with_holes(b"", [], []))
        sign = SPACE.encode()

        def body(ids, keys, prints, texts):
            out, same = [nothing] * len(ids), [True] * len(ids)
            for rows, names, of, ends in chunks_of(cutter, texts):
                at, holes, whose = unknown_in(own, names, of, ends)
                spelt, ends_of = own.spell(at[of])
                last = np.append(0, ends_of)[ends]  # ids before the end of each row
                first = np.append(0, last[:-1])
                bad = np.append(0, np.cumsum(own.wrong[at[of]]))
                filled: dict[int, tuple[list[int], list[int], dict[int, int]]] = {}
                for hole, row, i in zip(np.append(0, ends_of)[holes].tolist(), whose.tolist(), of[holes].tolist(), strict=True):
                    places, which, order = filled.setdefault(row, ([], [], {}))
                    places.append((hole - int(first[row])) * own.width)
                    which.append(order.setdefault(i, len(order)))
                begin = np.append(0, ends[:-1])
                for row, k in enumerate(rows):
                    places, which, _ = filled.get(row, ([], [], {}))
                    out[k] = press.compress(with_holes(spelt[first[row] : last[row]].tobytes(), places, which))
                    # chunks never share a character, so a text decodes as its chunks do, but for a sign that stood for itself
                    same[k] = bad[ends[row]] == bad[begin[row]] and sign not in texts[k]
            return ids, keys, prints, out, [bool(x) for x in same]

        return body

    packed = map_columns(hashed, holed, "doc_id long, k long, p long, packed binary, same boolean", keep_tables=True)
    joined = packed.join(rare, (F.col("k") == F.col("rk")) & (F.col("p") == F.col("rp")), "left").select("doc_id", "packed", "same", "ids", "ok")

    def finish():
        width = shared.value.width
        open_up = zstandard.ZstdDecompressor()

        def body(ids, packed_ids, same, values, fine):
            rows = [fill_holes(open_up.decompress(x), v or []) for x, v in zip(packed_ids, values, strict=True)]
            return ids, rows, [len(r) // width for r in rows], [s and f is not False for s, f in zip(same, fine, strict=True)]

        return body

    return map_columns(joined, finish, "doc_id long, ids binary, n_tokens long, round_trip boolean", keep_tables=True)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Rows (doc_id, text) from rows (doc_id, ids); null ids give null."""
    spark = encoded.sparkSession
    shared = share(spark, load_pieces(spark, model))

    def maker():
        turn = shared.value.decoder()
        return lambda ids, rows: [ids, [turn(r) if r is not None else None for r in rows]]

    return map_columns(encoded.select("doc_id", "ids"), maker, "doc_id long, text string")
