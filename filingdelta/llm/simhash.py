"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. If two fingerprints differ in at most `radius` bits, some segment differs in at most
its own small share of them, so the ball of that size around a segment's value, looked up in the table of that segment,
finds every link; complete distances are then verified. A table bucket with many distinct fingerprints would pair all of
them, so the members of such buckets are linked by midpoints instead: two fingerprints are within an even radius of each
other exactly if some value lies within half of it of both, which costs a fixed number of rows a fingerprint.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingdelta.llm.common import ASCII_LOWER, Scratch, components, map_columns, materialize, share, small, unpack, whole_row
from filingdelta.session import ship

BITS = 64


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """k-word shingles, repeats included; all words as one where they are fewer; none of no words."""
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return [b" ".join(s) for s in zip(*[words[i:] for i in range(k)], strict=False)]


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of hashes: a bit is set if over half of them have it."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes | None, k: int) -> int:
    """SimHash of the XXH64 (seed 42) of the shingles, repeats included."""
    items = shingles(text.translate(ASCII_LOWER).split(), k) if text else []
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, 42) for s in items), dtype=np.uint64, count=len(items)))


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, fp), one per row of docs."""

    def maker():
        return lambda ids, texts: [ids, [fingerprint(t, k) for t in texts]]

    return map_columns(docs.select("doc_id", "text"), maker, "doc_id long, fp long")


def layout(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(offset, width, radius) of each segment. The segment radii plus one add up to radius + 1, the least that lets no
    pair through: were every segment further apart than its own radius, the whole would be further than `radius`."""
    out, at = [], 0
    for i in range(segments):
        width = BITS // segments + (i < BITS % segments)
        out.append((at, width, (radius + 1) // segments + (i < (radius + 1) % segments) - 1))
        at += width
    return [s for s in out if s[2] >= 0]


def ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, radius: int = 4, segments: int | None = None, bucket_limit: int = 64) -> DataFrame:
    """Edges (a, b) among the distinct values of fps.fp whose connected components are those of all links within radius.

    Buckets of up to bucket_limit fingerprints give every verified link. Larger ones give, for each midpoint, the links
    of its members to their smallest, so no group is paired out. radius must be even. Without `segments`, there are
    three up to 2^26 distinct fingerprints and two above, so that a bucket's expected load stays small."""
    if radius % 2:
        raise ValueError("radius must be even")
    if segments is None:
        segments = 3 if fps.count() <= 1 << 26 else 2
    parts = layout(radius, segments)

    def value(offset: int, width: int):
        return F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit((1 << width) - 1))

    def key(n: int, v):
        return v.bitwiseOR(F.lit(signed(n << 60)))

    table = fps.select("fp", F.explode(F.array(*[key(n, value(o, w)) for n, (o, w, _) in enumerate(parts)])).alias("key"))
    probes = None
    for n, (o, w, r) in enumerate(parts):
        one = fps.select("fp", value(o, w).alias("v"), F.explode(F.array(*[F.lit(m).cast("long") for m in ball(w, r)])).alias("mask"))
        # of two values that differ by the mask, only the one with a zero at the mask's lowest bit asks
        one = one.filter((F.col("mask") == 0) | (F.col("v").bitwiseAND(F.col("mask").bitwiseAND(-F.col("mask"))) == 0))
        one = one.select("fp", key(n, F.col("v").bitwiseXOR(F.col("mask"))).alias("key"), (F.col("mask") == 0).alias("same"))
        probes = one if probes is None else probes.unionByName(one)
    hot = table.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_limit).select("key").checkpoint()
    crowded = not hot.isEmpty()
    cold = table.join(hot, "key", "left_anti") if crowded else table
    probe, stored = probes.alias("p"), cold.select(F.col("fp").alias("other"), "key").alias("t")
    near = (F.col("p.key") == F.col("t.key")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius) & (~F.col("same") | (F.col("fp") < F.col("other")))
    edges = probe.join(stored, near).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    if crowded:
        members = table.join(hot, "key", "left_semi").select("fp").union(probes.join(hot, "key", "left_semi").select("fp")).distinct()
        masks = [signed(m) for m in ball(BITS, radius // 2)]
        middle = members.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("hub"))
        low = middle.withColumn("a", F.min("fp").over(Window.partitionBy("hub")))
        edges = edges.union(low.filter("fp <> a").select("a", F.col("fp").alias("b")))
    return edges.distinct()


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 4, segments: int | None = None, bucket_limit: int = 64) -> DataFrame:
    """Rows (doc_id, fp, component_id), one per row of docs: component_id is the smallest doc_id that links reach.

    Texts are read whole; null, empty and blank texts have fingerprint zero and are linked like any other. Equal
    fingerprints are one node, so copies are never paired. Null doc_ids take part but name a component only if nothing
    else does: then component_id is null. Repeated rows give repeated rows. Columns other than doc_id and text are not
    read."""
    rows = materialize(fingerprints(docs, words), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).checkpoint()
    return named(rows, grouped(nodes, components(links(nodes.select("fp"), radius, segments, bucket_limit))))


def grouped(nodes: DataFrame, label: DataFrame) -> DataFrame:
    """Rows (of, component_id): the nodes (fp, low, n) that are in a group of two rows or more, and its smallest doc_id."""
    shared = nodes.join(label, F.col("fp") == F.col("node"), "left").filter("node is not null or n > 1")
    shared = shared.select("fp", "low", F.coalesce("label", "fp").alias("root")).checkpoint()
    lowest = shared.groupBy("root").agg(F.min("low").alias("component_id"))
    return shared.join(lowest, "root").select(F.col("fp").alias("of"), "component_id").checkpoint()


def named(rows: DataFrame, groups: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows (doc_id, fp, component_id) from the documents' rows and the groups of grouped(). Those are sent to all
    executors up to broadcast_rows of them, so that a group of very many copies needs no shuffle; beyond, Spark splits it."""
    joined = rows.join(small(groups.withColumn("grouped", F.lit(True)), broadcast_rows), F.col("fp") == F.col("of"), "left")
    return joined.select("doc_id", "fp", F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The sorted distinct XXH64 (seed 42) of the text's shingles; empty for null, empty and blank texts."""
    items = shingles(text.translate(ASCII_LOWER).split(), k) if text else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in items), dtype=np.uint64, count=len(items)))


def set_name(items: np.ndarray) -> int:
    """Signed 64-bit name of a set of shingles; zero for the empty one."""
    return signed(xxhash.xxh64_intdigest(items.tobytes(), 42)) if len(items) else 0


def sketch(items: np.ndarray) -> np.ndarray:
    """Parities of a set of shingles, as longs: a bit is set if an odd number of the hashes fall on it. There are at least as
    many bits as shingles, and a power of two, so that a sketch folds to half its size by one exclusive or."""
    bits = 64 << max(0, (len(items) - 1).bit_length() - 6) if len(items) else 64
    odd = np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def may_be_similar(x: Column, y: Column, similarity: float, slack: float = 1e-9) -> Column:
    """Whether the sizes and sketches of two sets leave them a Jaccard similarity of at least `similarity`. No such pair is
    lost: sketches differ in at most as many bits as there are shingles that one set alone has."""
    a, b = x["size"], y["size"]
    n = F.least(F.size(x["sketch"]), F.size(y["sketch"]))

    def folded(z: Column) -> Column:  # sizes so near to each other differ by one fold at most
        return F.when(F.size(z) > n, F.zip_with(F.slice(z, 1, n), F.slice(z, n + 1, n), lambda p, q: p.bitwiseXOR(q))).otherwise(z)

    bits = F.zip_with(folded(x["sketch"]), folded(y["sketch"]), lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("int"))
    apart = F.aggregate(bits, F.lit(0), lambda total, k: total + k)
    return (F.least(a, b) >= similarity * F.greatest(a, b) - slack) & (apart <= (1 - similarity) / (1 + similarity) * (a + b) + slack)


def prefix(items: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the order of (count among the common ones, hash), as many as it cannot do without:
    a set of at least that Jaccard similarity to it has at least ceil(similarity * size) of its shingles, so the first
    size - ceil(similarity * size) + 1 of each hold a shared one, whatever the order is."""
    if not len(items):
        return items.view(np.int64)
    rank = np.zeros(len(items), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, items), len(common) - 1)
        rank = np.where(common[at] == items, counts[at], 0)
    length = len(items) - math.ceil(similarity * len(items) - 1e-9) + 1
    return items[np.lexsort((items, rank))[:length]].view(np.int64)


def common_shingles(docs: DataFrame, words: int, sample: int = 20_000, part: float = 0.08, at_most: int = 1_000_000, docs_per_task: int = 5_000) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of `sample` documents or so, or of that part of them where it is more, sorted, and their
    counts. They only set an order that keeps what many texts share out of the prefixes; no result depends on them. The
    sample grows with the documents, since the texts that hold a shingle by chance do."""
    n = max(1, docs.count())
    size = min(n, max(sample, int(part * n)))
    drawn = docs.select("text").sample(min(1.0, size / n), 42).repartition(max(4, -(-size // docs_per_task)))

    def run(batches):
        held, size = [], 0

        def counted():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000])], names=["h", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                held.append(shingle_set(text, words))
                size += len(held[-1])
                if size > 2_000_000:
                    yield from counted()
                    held, size = [], 0
        if held:
            yield from counted()

    ship(docs.sparkSession)
    found = drawn.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 2").orderBy(F.desc("n"), "h").limit(at_most).toArrow()
    common, counts = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(common)
    return common[order], counts[order]


class Judge:
    """Exact similarities of pairs of the distinct texts of docs. `sketches` has a row (fp, size, sketch) for each. Every text
    that a pair asks for is read once, packed, and kept under its name until the block of `tmp` ends."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, sketches: DataFrame, words: int, similarity: float, tmp: Scratch, broadcast_rows: int = 2_000_000):
        self.docs, self.nodes, self.sketches, self.words, self.similarity = docs, nodes, sketches, words, similarity
        self.tmp, self.broadcast_rows, self.calls = tmp, broadcast_rows, 0

    def beside(self, pairs: DataFrame, made: DataFrame, per_copy: int = 256) -> DataFrame:
        """Rows (a, b, x, y): x and y are the rows of `made`, which has a column fp, of each of pairs (a, b). A row that many
        pairs ask for as a is copied, so that no task gets all of them."""
        wanted = pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > per_copy)
        copies = wanted.select(F.col("a").alias("many"), F.ceil(F.col("n") / per_copy).cast("int").alias("copies")).checkpoint()
        copies = small(copies, self.broadcast_rows)
        dealt = pairs.join(copies, F.col("a") == F.col("many"), "left")
        dealt = dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("copies", F.lit(1))).cast("int").alias("copy"))
        packed = made.select("fp", F.struct(*[c for c in made.columns if c != "fp"]).alias("own"))
        first = packed.join(copies, F.col("fp") == F.col("many"), "left")
        first = first.select(F.col("fp").alias("fa"), F.col("own").alias("x"), F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("ca"))
        second = packed.select(F.col("fp").alias("fb"), F.col("own").alias("y"))
        return dealt.join(first, (F.col("a") == F.col("fa")) & (F.col("copy") == F.col("ca"))).join(second, F.col("b") == F.col("fb")).select("a", "b", "x", "y")

    def texts(self, pairs: DataFrame) -> DataFrame:
        """Rows (fp, text), text packed, of the nodes in pairs. The ids that choose the documents are sent to all executors
        up to broadcast_rows of them; beyond, the documents are dealt by doc_id."""
        words = self.words
        asked = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
        asked = self.tmp.keep(self.nodes.join(asked, "fp", "left_semi").select("fp", "low"), f"asked-{self.calls}")
        lows = small(asked.select("low").distinct(), self.broadcast_rows)
        texts = self.docs.select("doc_id", "text").join(lows, F.col("doc_id").eqNullSafe(F.col("low")), "left_semi").select("text")

        def named_texts():
            press = zstandard.ZstdCompressor(level=3)
            seen: set[int] = set()

            def body(column):
                names, packed = [], []
                for t in column:
                    if (name := set_name(shingle_set(t, words))) not in seen:
                        if len(seen) < 1_000_000:
                            seen.add(name)
                        names.append(name)
                        packed.append(press.compress(t or b""))
                return [names, packed]

            return body

        found = map_columns(texts, named_texts, "fp long, text binary").join(small(asked.select("fp"), self.broadcast_rows), "fp", "left_semi")
        return self.tmp.keep(found.dropDuplicates(["fp"]), f"texts-{self.calls}")

    def links(self, pairs: DataFrame, sketched: bool = False, slack: float = 1e-9) -> DataFrame:
        """Those of pairs (a, b) whose sets of shingles have an exact Jaccard similarity of at least self.similarity. Texts
        are joined only for pairs that the sketches leave; `sketched` says that these are such already."""
        self.calls += 1
        words = self.words
        if not sketched:
            left = self.beside(pairs, self.sketches).filter(may_be_similar(F.col("x"), F.col("y"), self.similarity))
            pairs = self.tmp.keep(left.select("a", "b"), f"left-{self.calls}")
        joined = self.beside(pairs, self.texts(pairs)).select("a", "b", F.col("x.text").alias("x"), F.col("y.text").alias("y"))

        def judge():
            open_up = zstandard.ZstdDecompressor()
            sets = lru_cache(64)(lambda text: shingle_set(open_up.decompress(text), words))

            def body(a, b, x, y):
                out = []
                for p, q in zip(map(sets, x), map(sets, y), strict=True):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    out.append(both / max(1, len(p) + len(q) - both))
                return [a, b, out]

            return body

        found = self.tmp.keep(map_columns(joined, judge, "a long, b long, similarity double"), f"judged-{self.calls}")
        self.tmp.drop(f"texts-{self.calls}", f"asked-{self.calls}", *([] if sketched else [f"left-{self.calls}"]))
        return found.filter(F.col("similarity") >= self.similarity - slack).select("a", "b")


def fingerprint_links(sims: DataFrame, judge: Judge, tmp: Scratch, radius: int = 4, segments: int | None = None, bucket_limit: int = 64) -> DataFrame:
    """Edges (a, b) among the distinct sets of sims (fp, sim), sim being their SimHash: the pairs that the multi-index finds
    within radius, of which those stay that the judge finds similar. Sets of one SimHash are paired with their least, which
    stands for them among the others."""
    first = tmp.keep(sims.groupBy("sim").agg(F.min("fp").alias("least")), "fingerprints")
    same = sims.join(first, "sim").filter("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    near = links(first.select(F.col("sim").alias("fp")), radius, segments, bucket_limit)
    near = near.join(first.select(F.col("sim").alias("a"), F.col("least").alias("x")), "a").join(first.select(F.col("sim").alias("b"), F.col("least").alias("y")), "b")
    pairs = tmp.keep(same.union(near.select(F.least("x", "y"), F.greatest("x", "y"))), "near-fingerprints")
    return judge.links(pairs)


def similar_links(entries: DataFrame, judge: Judge, similarity: float, tmp: Scratch, known: DataFrame, bucket_limit: int = 32) -> DataFrame:
    """Edges (a, b) among the distinct sets of entries (fp, size, pos, key) whose connected components, with those of
    `known`, are those of all pairs of a Jaccard similarity of at least `similarity`. Each edge is such a pair. `known` has
    rows (node, label) of sets that are known to be in one component: no two of them are compared.

    Two sets that similar share a shingle of their prefixes. At the first one in order, what follows must suffice for the
    overlap; sizes must allow it too. All pairs of a bucket that pass are compared, but a bucket of more than bucket_limit
    sets is first compared with one of its members, its hub. Those similar to the hub are one component already, so no two
    of them are compared; the other pairs meet with their sketches, and only those that these leave are written."""
    slack = 1e-9
    whole = similarity / (1 + similarity)
    known = small(known, 2_000_000)

    def apart(pairs: DataFrame) -> DataFrame:
        """pairs, and whether their ends are not known to be in one component."""
        one, other = known.select(F.col("node").alias("na"), F.col("label").alias("la")), known.select(F.col("node").alias("nb"), F.col("label").alias("lb"))
        both = pairs.join(one, F.col("a") == F.col("na"), "left").join(other, F.col("b") == F.col("nb"), "left")
        return both.select(*pairs.columns, F.coalesce(F.col("la") != F.col("lb"), F.lit(True)).alias("apart"))

    buckets = entries.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("pos", "fp"))["fp"].alias("hub"), F.min("size").alias("least")).filter("n > 1")
    # not even the smallest set of the bucket could share enough of what follows
    shared = entries.join(buckets, "key").filter(F.col("size") - F.col("pos") >= whole * (F.col("size") + F.greatest("least", similarity * F.col("size"))) - slack)
    shared = tmp.keep(shared.select("key", "fp", "size", "pos", "n", "hub"), "buckets")

    def may(x: Column, y: Column) -> Column:
        a, b, i, j = x["size"], y["size"], x["pos"], y["pos"]
        return (F.least(a, b) >= similarity * F.greatest(a, b) - slack) & (F.least(a - i, b - j) >= whole * (a + b) - slack)

    # a bucket of bucket_limit members at most is one row
    few = shared.filter(F.col("n") <= bucket_limit).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("fp", "size", "pos"))).alias("m"))
    few = few.select("m", F.explode("m").alias("x")).select("x", F.explode(F.filter("m", lambda y: (F.col("x.fp") < y["fp"]) & may(F.col("x"), y))).alias("y"))
    crowded = shared.filter(F.col("n") > bucket_limit)
    stars = crowded.filter("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    pairs = few.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).union(stars).distinct()
    pairs = tmp.keep(apart(pairs), "pairs")
    edges = judge.links(pairs.filter("apart").drop("apart"))
    if crowded.isEmpty():
        return edges
    to_hub = edges.union(pairs.filter("not apart").drop("apart")).select(F.col("a").alias("hub"), F.col("b").alias("fp"), F.lit(True).alias("linked"))
    member = crowded.filter("fp <> hub").join(to_hub, ["hub", "fp"], "left").select("key", "fp", "pos", F.coalesce("linked", F.lit(False)).alias("linked"))
    member = tmp.keep(member.join(judge.sketches, "fp"), "members")
    x, y = (F.struct(*[F.col(f"{side}.{c}") for c in ("size", "pos", "sketch")]) for side in "xy")
    near = (F.col("x.key") == F.col("y.key")) & may(x, y) & may_be_similar(x, y, similarity)
    alone = member.filter(~F.col("linked")).alias("x")
    more = alone.join(member.alias("y"), near & (F.col("y.linked") | (F.col("x.fp") < F.col("y.fp")))).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    more = tmp.keep(apart(more.distinct()).filter("apart").drop("apart"), "more-pairs")
    if more.isEmpty():
        return edges
    return edges.union(judge.links(more, sketched=True))


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, bucket_limit: int = 32, radius: int = 4) -> DataFrame:
    """Rows (doc_id, fp, component_id) as near_duplicates gives them, for links of shingle similarity: two texts are linked
    exactly if the Jaccard similarity of their sets of shingles is at least `similarity`.

    The multi-index over the SimHashes of the sets gives the pairs within `radius` bits, whose similarity is then worked out.
    A similar pair may differ in more bits than any radius that can be looked up; so texts that this leaves in different
    components are compared where they share a shingle that they cannot do without, which loses no pair.

    Shingles are told apart by 64-bit hashes, and fp is a 64-bit name of the set: equal sets are one node. Nulls, blank
    texts and repeated rows are as there. A prefix shingle that one row alone has goes before rows are dealt by shingle."""
    spark = docs.sparkSession
    shared = share(spark, common_shingles(docs, words))

    def maker():
        common, counts = shared.value
        seen: set[int] = set()

        def body(ids, texts):
            sets = [shingle_set(t, words) for t in texts]
            names = [set_name(s) for s in sets]
            keys: list[np.ndarray | None] = []
            for name, items in zip(names, sets, strict=True):  # copies in one task give their prefix once
                keys.append(None if name in seen else prefix(items, common, counts, similarity))
                if len(seen) < 1_000_000:
                    seen.add(name)
            fresh = [None if k is None else s for s, k in zip(sets, keys, strict=True)]
            return [ids, names, [len(s) for s in sets], keys, [None if s is None else sketch(s) for s in fresh], [None if s is None else majority(s) for s in fresh]]

        return body

    with Scratch(spark) as tmp:
        made = tmp.keep(map_columns(docs.select("doc_id", "text"), maker, "doc_id long, fp long, size int, keys array<long>, sketch array<long>, sim long"), "prefixes")
        rows = materialize(made.select("doc_id", "fp"), "names")
        nodes = tmp.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "nodes")
        sketches = tmp.keep(made.filter("keys is not null").select("fp", "size", "sketch", "sim").dropDuplicates(["fp"]), "sketches")
        entries = made.filter("keys is not null").select("fp", "size", F.posexplode("keys").alias("pos", "key"))
        often = tmp.keep(entries.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key"), "often")
        held = tmp.keep(entries.hint("merge").join(often, "key", "left_semi"), "held")
        tmp.drop("prefixes", "often")
        entries = tmp.keep(held.dropDuplicates(["key", "fp"]), "entries")
        tmp.drop("held")
        judge = Judge(docs, nodes, sketches.drop("sim"), words, similarity, tmp)
        edges = tmp.keep(fingerprint_links(sketches.select("fp", "sim"), judge, tmp, radius), "fingerprint-links")
        more = similar_links(entries, judge, similarity, tmp, components(edges), bucket_limit)
        return named(rows, grouped(nodes, components(edges.union(more))))


def hex_of(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs, all columns, with one row of each group of near_copies: that of the smallest doc_id.

    Rows with a null doc_id are kept, as nothing names them. Of repeated rows (equal doc_id and set of shingles) one stays.
    Decisions are by doc_id and set, so rows that share a doc_id but not a text are judged apart."""
    found = near_copies(docs, words, similarity).filter("doc_id is not null")
    gone = materialize(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_i"), F.col("fp").alias("_f")), "gone")

    if found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        # doc_id tells rows apart: it alone decides
        packed = whole_row(docs, F.col("doc_id").alias("_k"))
        return unpack(packed.join(small(gone.select("_i"), 2_000_000), F.col("_k") == F.col("_i"), "left_anti"))

    @F.pandas_udf("long")
    def again(texts: pd.Series) -> pd.Series:
        return pd.Series([set_name(shingle_set(t.encode() if t is not None else None, words)) for t in texts], dtype="int64")

    packed = whole_row(docs, F.col("doc_id").alias("_k"), again(F.col("text")).alias("_p"))
    kept = packed.join(gone, (F.col("_k") == F.col("_i")) & (F.col("_p") == F.col("_f")), "left_anti")
    named_rows, unnamed = kept.filter("_k is not null"), kept.filter("_k is null")
    return unpack(named_rows.dropDuplicates(["_k", "_p"]).unionByName(unnamed))
