"""Near-duplicates by SimHash with covering locality-sensitive hashing.

Fingerprints: 64 bits, each set where over half of a text's word-shingle hashes (XXH64, seed 42) have it set.

Search: every bit position gets a vector of RADIUS + 1 bits; for each non-zero vector v of that length one table keeps the
positions whose vector has an odd inner product with v. The at most RADIUS positions in which two fingerprints differ
span at most RADIUS dimensions, so some v is orthogonal to all of them: in that table the two agree in all kept bits and
collide. No pair within the radius is missed.

Equal fingerprints are grouped first, so copies cost nothing further. Buckets are compared in memory and give the edges of
a spanning forest, never all pairs. A bucket of more than BUCKET fingerprints is refined: its free bits are cut into
RADIUS + 1 parts, of which any pair within the radius agrees on one, and it is dealt out anew by each part. Every
refinement fixes a quarter of the free bits, so after a few at most 2^11 fingerprints can share a bucket.

Defined results: a text without words (or null) has fingerprint zero and is linked like any other; fewer words than a
shingle give one shingle; rows with null doc_id take part, a component without any doc_id has a null id; repeated rows are
kept; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, hot_keys, join_salted, map_texts, shuffle_partitions, space_words, stored, text_slices
from .components import components

RADIUS = 3
SHINGLE = 3
BITS = 64
#: Fingerprints that are compared in one task's memory at once.
BUCKET = 2048
#: How many of the most frequent fingerprints are dealt out where their rows meet.
HOT_PRINTS = 1000

FINGERPRINT = T.StructType([T.StructField("fp", T.LongType())])


def shingle_hashes(words: list[bytes], size: int) -> list[int]:
    from xxhash import xxh64_intdigest

    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words)))
    ends = [e + i for i, e in enumerate(ends)]
    if len(words) <= size:
        return [xxh64_intdigest(joined, 42)]
    starts = [0, *(e + 1 for e in ends)]
    return [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :])]


def majority(hashes: list[int] | np.ndarray) -> int:
    """Signed 64 bits, each set if over half of the hashes have it set."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(np.asarray(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) if len(bits) > 255 else np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones.astype(np.int64) > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """docs with fp, the signed 64-bit fingerprint of the whole text."""

    def make():
        def f(texts, _):
            words = (space_words(t) if t else [] for t in texts)
            return [[majority(shingle_hashes(w, shingle)) if w else 0 for w in words]]

        return f

    return map_texts(docs, text, FINGERPRINT, make, keep=keep)


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Masks of which, for any `radius` positions, at least one is zero at all of them; each keeps about half the bits."""
    dims = radius + 1
    vectors = [1 + i % (2**dims - 1) for i in range(bits)]  # every non-zero vector in turn
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) & (2**bits - 1) for v in range(1, 2**dims)
    ]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def child_masks(mask: int, radius: int, bits: int = BITS) -> list[int]:
    """mask with each of radius + 1 parts of its free bits added."""
    free = [i for i in range(bits) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[j :: radius + 1]) for j in range(radius + 1)]


def forest(prints: np.ndarray, radius: int, nearest: int = 0) -> list[tuple[int, int]]:
    """Pairs of positions that span the graph of fingerprints at `radius` or fewer differing bits.

    A spanning forest, and for each position its `nearest` closest within the radius besides: never all pairs.
    """
    u = prints.view(np.uint64)
    left = np.ones(len(u), bool)
    edges = []
    while True:
        seeds = np.flatnonzero(left)
        if len(seeds) < 1 + (not nearest):
            return edges
        left[seeds[0]] = False
        todo = [int(seeds[0])]
        while todo:
            x = todo.pop()
            far = np.bitwise_count(u ^ u[x])
            near = np.flatnonzero(left & (far <= radius))
            left[near] = False
            todo += near.tolist()
            edges += [(x, int(y)) for y in near]
            if nearest:
                far[x] = 255
                close = np.flatnonzero(far <= radius)
                edges += [(x, int(y)) for y in close[np.argsort(far[close], kind="stable")[:nearest]]]


#: Bits of a filter for each key, and the most that a filter has: 64 MB, however many the keys. A filter only spares the
#: join that follows it some rows; with more keys than it can tell apart more rows go into that join, none are lost.
FILTER_RATE, FILTER_BITS = 16, 1 << 29


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a filter for each 64-bit hash."""
    u = keys.view(np.uint64)
    return u % np.uint64(bits), (u * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(bits)


def key_filter(keys: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter over 64-bit hashes; so small that every task can have it. It may say yes to others, never no to these."""
    bits = min(FILTER_BITS, 1 << max(10, (FILTER_RATE * n - 1).bit_length()))

    def run(batches):
        made = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(made, at >> np.uint64(3), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8), dtype=np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([made.tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(bits // 8, np.uint8)
    for row in keys.repartition(4).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(bytes(row.bits), np.uint8)
    return out


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    a, b = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 for at in _places(keys, 8 * len(bits)))
    return (a & b).astype(bool)


def filtered(rows: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """Those rows whose 64-bit hash the filter may hold."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    place = rows.columns.index(column)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_filter(shared.value, batch.column(place).to_numpy(zero_copy_only=False))))

    return rows.mapInArrow(run, rows.schema)


#: Keys that a task packs before it hands them on.
PACKED = 1 << 20


def counted(rows: DataFrame, column: str, keys_of=None) -> DataFrame:
    """(key, n) of the 64-bit keys that occur more than once.

    The column holds the keys, or texts of which keys_of makes arrays of keys: in the same worker, as a second one for each
    task would have its own memory.
    Tasks sum up their keys and hand them on in one list for each target, so that a key costs little over its eight bytes.
    Spark may put small targets together: few keys are then few tasks and files.
    """
    parts = shuffle_partitions(rows)

    def pack(batches):
        held: list[np.ndarray] = []

        def lists():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            to = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            keys, n, to = keys[order], n[order].astype(np.int32), to[order]
            at = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            offsets = pa.array(np.append(at, len(to)), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(to[at]), pa.ListArray.from_arrays(offsets, pa.array(keys)), pa.ListArray.from_arrays(offsets, pa.array(n))], names=["part", "keys", "sums"]
            )

        def arrays(batch):
            if not keys_of:
                return [batch.column(0).drop_null().to_numpy(zero_copy_only=False)]
            return (keys_of(t) for _, texts in text_slices(batch, column) for t in texts)

        size = 0
        for batch in batches:
            for own in arrays(batch):
                if len(own):
                    held.append(own)
                    size += len(own)
                if size >= PACKED:
                    yield lists()
                    held, size = [], 0
        if held:
            yield lists()
            held = []
        give_back()

    def add(batches):
        got = [(b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()) for b in batches]
        if any(len(k) for k, _ in got):
            keys, n = (np.concatenate(x) for x in zip(*got))
            got.clear()
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys, n = keys[at], np.add.reduceat(n, at, dtype=np.int64)
            for a in range(0, len(keys), PACKED):
                k, m = keys[a : a + PACKED], n[a : a + PACKED]
                yield pa.RecordBatch.from_arrays([pa.array(k[m > 1]), pa.array(m[m > 1])], names=["key", "n"])
        give_back()

    packed = rows.select(column).mapInArrow(pack, "part int, keys array<bigint>, sums array<int>")
    return packed.repartition("part").mapInArrow(add, "key bigint, n bigint")


def first_half(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _forests(buckets: DataFrame, radius: int, nearest: int) -> DataFrame:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            members, offsets = lists.flatten(), lists.offsets.to_numpy()
            nodes, fps = (members.field(c).to_numpy(zero_copy_only=False) for c in ("node", "fp"))
            offsets = offsets - offsets[0]
            edges = []
            for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                order = np.argsort(nodes[i:j], kind="stable")  # so that buckets of the same texts give the same edges
                own, prints = nodes[i:j][order], fps[i:j][order]
                edges += [(own[x], own[y]) for x, y in forest(prints, radius, nearest)]
            a, b = zip(*edges) if edges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return buckets.select("members").mapInArrow(run, EDGES)


def near_edges(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, within: int | None = None, nearest: int = 0) -> DataFrame:
    """Edges (a, b) that connect nodes as do all pairs whose fingerprints of one family are within the radius.

    prints: (family, node, fp). Pairs that meet in a bucket are linked up to `within` bits (default: the radius); with
    `nearest`, every node is also joined to that many of its closest in each bucket. A bucket is named by a hash of family,
    mask and masked bits; two that shared a name would only be compared needlessly.
    """
    spark = prints.sparkSession
    within = radius if within is None else within
    masks = covering_masks(radius)
    # Of equal fingerprints the first node stands for all: so the bits that a bucket leaves free bound its size.
    heads = stored(prints.groupBy("family", "fp").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")), "heads")
    named = lambda df: df.withColumn("__fp", F.xxhash64("family", "fp"))
    many = named(heads.filter("n > 1").select("family", "fp", F.col("node").alias("b"), "n"))
    hot = many.orderBy(F.desc("n"), "__fp").limit(HOT_PRINTS).select("__fp").distinct()
    equal = join_salted(named(prints), many.withColumnsRenamed({"family": "f", "fp": "p"}), "__fp", hot).filter("family = f AND fp = p")
    out = equal.filter("node <> b").select(F.col("node").alias("a"), "b")
    dealt = heads.select("family", "node", "fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    while True:
        dealt = dealt.withColumn("bucket", F.xxhash64("family", "mask", F.col("fp").bitwiseAND(F.col("mask"))))
        sizes = stored(counted(dealt, "bucket").withColumnRenamed("key", "bucket"), "sizes")
        fit = sizes.filter(F.col("n") <= bucket).select("bucket")
        # A filter of bounded size first: rows that are alone in their bucket, by far the most, are not shuffled again.
        small = filtered(dealt.select("bucket", "node", "fp"), "bucket", key_filter(fit, fit.count()))
        small = small.join(fit.hint("merge"), "bucket")
        small = small.groupBy("bucket").agg(F.collect_list(F.struct("node", "fp")).alias("members"))
        edges = _forests(small, within, nearest)
        out = out.union(edges)
        large = sizes.filter(F.col("n") > bucket).select("bucket")
        if large.isEmpty():
            return out
        # At most (radius + 1) masks for each mask before; the list is bounded by the depth, not by the data.
        children = [(signed(m), signed(c)) for m in masks for c in child_masks(m, radius)]
        masks = sorted({c & (2**64 - 1) for _, c in children})
        hot = dealt.join(large, "bucket")
        children = F.broadcast(spark.createDataFrame(children, "mask long, child long"))
        # Two parents can share a child; a node then needs to be dealt once only.
        dealt = stored(hot.join(children, "mask").select("family", "node", "fp", F.col("child").alias("mask")).distinct(), "dealt")


def classes(prints: DataFrame, order: str = "doc_id", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(fp, component): for every fingerprint the least `order` of all rows connected with it. prints: rows (order, fp)."""
    own = stored(prints.groupBy("fp").agg(F.min(order).alias("least")), "prints")
    links = components(near_edges(own.select(F.lit(0).alias("family"), F.col("fp").alias("node"), "fp"), radius, bucket))
    rooted = own.join(links.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return rooted.join(least, "root").select("fp", "component")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links."""
    prints = stored(fingerprints(docs.select("doc_id", "text"), shingle=shingle, keep=["doc_id"]), "fingerprints")
    found = classes(prints, radius=radius, bucket=bucket)
    return join_salted(prints, found, "fp", hot_keys(prints, "fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


#: Families of fingerprints, and the differing bits up to which pairs that meet are verified.
FAMILIES, WITHIN = 6, 8
SIMILARITY = 0.8
COPY_SHINGLE = 5

#: Members of a shared shingle that are joined under one key at once; more are dealt out in blocks, each with each.
BLOCK = 1024
#: How many of the shingles before it a row of a text's prefix knows. More only spare pairs that meet again.
EARLIER = 32
#: Shingles are counted over all texts in 2^COUNT_BITS classes of hashes, a table of 16 MB in every task, which crosses the
#: shuffle in pieces. Counts only order shingles (rare ones first): any order gives the same pairs.
COUNT_BITS, COUNT_PIECE = 22, 1 << 14

SKETCH = T.StructType(
    [
        T.StructField("__same", T.BinaryType()),
        T.StructField("fps", T.ArrayType(T.LongType())),
        T.StructField("size", T.IntegerType()),
        T.StructField("prefix", T.ArrayType(T.LongType())),
        T.StructField("parity", T.BinaryType()),
    ]
)
_ODD = [np.uint64(2 * x + 1) for x in range(0x1E3779B97F4A7C15, 0x1E3779B97F4A7C15 + FAMILIES * 0x51ED270B, 0x51ED270B)]


def family_prints(hashes: np.ndarray) -> list[int]:
    """FAMILIES independent fingerprints of a set of 64-bit hashes."""
    out = []
    for odd in _ODD:
        h = hashes * odd
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        out.append(majority(h))
    return out


def shingle_set(words: list[bytes], shingle: int = COPY_SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    return np.unique(np.array(shingle_hashes(words, shingle) if words else [], np.uint64).view(np.int64))


def shingle_classes(own: np.ndarray) -> np.ndarray:
    return (own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def shingle_counts(docs: DataFrame, text: str) -> np.ndarray:
    """For each class of shingles how many times a text holds one of them, counted over all docs."""

    def count(batches):
        made = np.zeros(1 << COUNT_BITS, np.uint32)
        for batch in batches:
            for _, texts in text_slices(batch, text):
                for t in texts:
                    np.add.at(made, shingle_classes(shingle_set(space_words(t) if t else [])), np.uint32(1))
        pieces = made.reshape(-1, COUNT_PIECE)
        for i in np.flatnonzero(pieces.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(pieces[i], 1)])], names=["piece", "counts"])
        del made, pieces
        give_back()

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(zlib.decompress(packed.as_py()), np.uint32)
                sums[i] = sums.get(i, np.zeros(COUNT_PIECE, np.int64)) + own
        for i, own in sums.items():
            own = np.minimum(own, np.iinfo(np.uint32).max).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own.tobytes()])], names=["piece", "counts"])

    out = np.zeros(1 << COUNT_BITS, np.uint32).reshape(-1, COUNT_PIECE)
    got = docs.select(text).mapInArrow(count, "piece int, counts binary").repartition("piece").mapInArrow(add, "piece int, counts binary").toArrow()
    for i, own in zip(got.column("piece").to_pylist(), got.column("counts")):
        out[i] = np.frombuffer(own.as_py(), np.uint32)
    return out.reshape(-1)


def prefix(own: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles in an order common to all texts: two sets at least `similarity` alike share one of these."""
    order = np.lexsort((own, counts[shingle_classes(own)]))
    return own[order][: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]


#: The most bits of a set's parities: 4 KB.
PARITY_BITS = 1 << 15


def parities(own: np.ndarray) -> bytes:
    """For each of a power of two of classes of hashes (about as many as the set has), whether an odd number is in the set.

    Two sets differ in at least as many elements as their parities do in bits, so these show unlike sets at a glance.
    """
    bits = min(PARITY_BITS, 1 << max(6, (len(own) - 1).bit_length()))
    odd = np.bincount((own.view(np.uint64) >> np.uint64(7) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parity_distance(x: bytes, y: bytes) -> int:
    """In how many bits two parities differ; the longer is folded to the classes of the shorter."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    n = min(len(p), len(q))
    fold = lambda z: np.bitwise_xor.reduce(z.reshape(-1, n), axis=0) if len(z) > n else z
    return int(np.bitwise_count(fold(p) ^ fold(q)).sum())


def sketches(docs: DataFrame, text: str, keep: list[str], shared, maybe: bool, counts: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """Those docs whose sequence the shared filter may hold (or cannot, by `maybe`) with `__same`, equal for equal word sequences only, `fps`, fingerprints of the set of words, and the `size`,
    `prefix` and `parity` of the set of five-word shingles."""
    from xxhash import xxh64_intdigest, xxh128_digest

    known = docs.sparkSession.sparkContext.broadcast(counts)
    new = T.StructType([*SKETCH.fields, T.StructField("__asked", T.BooleanType())])

    def make():
        counts, bits = known.value, shared.value

        def f(texts, _):
            same = [xxh128_digest(b" ".join(space_words(t) if t else [])) for t in texts]
            asked = in_filter(bits, np.array([first_half(x) for x in same], np.int64)) == maybe
            prints, sizes, firsts, odd = [], [], [], []
            for t, wanted in zip(texts, asked):
                if not wanted:
                    for column in (prints, sizes, firsts, odd):
                        column.append(None)
                    continue
                words = space_words(t) if t else []
                prints.append(family_prints(np.array([xxh64_intdigest(w, 42) for w in set(words)], np.uint64)))
                own = shingle_set(words)
                sizes.append(len(own))
                firsts.append(prefix(own, counts, similarity))
                odd.append(parities(own))
            return [same, prints, sizes, firsts, odd, asked]

        return f

    return map_texts(docs, text, new, make, keep=keep).filter("__asked").drop("__asked")


def sequence_half(t: bytes | None) -> np.ndarray:
    """The first half of what names a text's word sequence."""
    from xxhash import xxh128_digest

    return np.array([first_half(xxh128_digest(b" ".join(space_words(t) if t else [])))])


def name_sequences(docs: DataFrame, text: str, shared) -> DataFrame:
    """docs with `__same`, equal for equal word sequences only, and `__maybe`, whether the shared filter may hold it."""
    from xxhash import xxh128_digest

    new = T.StructType([SKETCH["__same"], T.StructField("__maybe", T.BooleanType())])

    def make():
        bits = shared.value

        def f(texts, _):
            same = [xxh128_digest(b" ".join(space_words(t) if t else [])) for t in texts]
            return [same, in_filter(bits, np.array([first_half(x) for x in same], np.int64))]

        return f

    return map_texts(docs, text, new, make)


def shingle_sets(docs: DataFrame, text: str, keep: list[str], shingle: int = COPY_SHINGLE) -> DataFrame:
    """docs with `shingles`: the sorted distinct 64-bit hashes of all word shingles."""
    new = T.StructType([T.StructField("shingles", T.ArrayType(T.LongType()))])

    def make():
        def f(texts, _):
            return [[shingle_set(space_words(t) if t else [], shingle) for t in texts]]

        return f

    return map_texts(docs, text, new, make, keep=keep)


def verified(edges: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those edges (a, b) whose nodes' shingle sets (node, shingles) have at least this Jaccard similarity; two empty sets: 1."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            xo, yo = x.offsets.to_numpy(), y.offsets.to_numpy()
            xv, yv = x.flatten().to_numpy(zero_copy_only=False), y.flatten().to_numpy(zero_copy_only=False)
            keep = []
            for i in range(batch.num_rows):
                p, q = xv[xo[i] - xo[0] : xo[i + 1] - xo[0]], yv[yo[i] - yo[0] : yo[i + 1] - yo[0]]
                both = len(np.intersect1d(p, q, True)) if min(len(p), len(q)) >= similarity * max(len(p), len(q)) else 0
                keep.append(both >= similarity * (len(p) + len(q) - both))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], schema=schema)

    rows = edges.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a")
    rows = rows.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(run, EDGES)


def likely_pairs(edges: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those edges (a, b) whose nodes (node, size, parity) can have this similarity: sizes and parities allow it.

    Sets of m and n elements with Jaccard similarity s differ in at most (1 - s) / (1 + s) (m + n) elements.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    share = (1 - similarity) / (1 + similarity)

    def run(batches):
        for batch in batches:
            m, n, x, y = (batch.column(i).to_pylist() for i in range(2, 6))
            kept = [parity_distance(p, q) <= share * (i + j) + 1e-6 for i, j, p, q in zip(m, n, x, y)]
            kept = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], schema=schema)

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("parity").alias(f"parity_{c}"))
    rows = edges.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    rows = rows.filter(F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-6)
    return rows.select("a", "b", "size_a", "size_b", "parity_a", "parity_b").mapInArrow(run, EDGES)


def rare_pairs(nodes: DataFrame, links: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, known: int = EARLIER) -> DataFrame:
    """Every pair (a, b) of nodes not yet linked whose shingle sets can be `similarity` alike.

    nodes: (node, size, prefix). Two such sets share a shingle of their prefixes; at its places i and j in sets of m and n
    they have at most 1 + min(i, j) + min(m - i, n - j) - 1 in common. Pairs of one component need no look: of a shingle's
    nodes only those outside of its largest component are joined, with all, so that a group of copies costs no squares.

    A pair is taken at the first shingle that it shares, where it has at most min(m - i, n - j) in common: each row knows
    up to `known` of the shingles before it. Of a text with more, a pair may be taken again, by the weaker bound, never lost.
    """
    rows = nodes.select("node", "size", F.posexplode("prefix").alias("at", "shingle"))
    shared = stored(counted(rows, "shingle").select(F.col("key").alias("shingle")), "shared")
    rows = filtered(rows, "shingle", key_filter(shared, shared.count()))
    rows = rows.join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = stored(rows, "rare")
    roots = rows.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle")
    roots = roots.agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    parts = lambda n: F.ceil(n / block).cast("int")
    mixed = roots.filter("roots > 1").select(
        "shingle", F.col("main.root").alias("main"), parts(F.col("all")).alias("wide"), parts(F.col("all") - F.col("main.n")).alias("long")
    )
    rows = rows.join(stored(mixed, "mixed"), "shingle")
    # Shingles of one component alone are in no pair to be found, so those that are left tell the first one that is shared.
    before = Window.partitionBy("node").orderBy("at")
    rows = rows.withColumn("first", F.collect_list("shingle").over(before.rowsBetween(-known, -1)))
    rows = stored(rows.withColumn("whole", F.row_number().over(before) <= known + 1), "firsts")
    own = lambda n: F.pmod(F.xxhash64("node", "shingle"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    named = lambda s: [F.col(c).alias(c + s) for c in ("node", "size", "at", "root", "first", "whole")]
    x = rows.filter("root <> main").withColumn("i", own("long")).withColumn("j", every("wide")).select("shingle", "i", "j", *named("_x"))
    y = rows.withColumn("j", own("wide")).withColumn("i", every("long")).select("shingle", "i", "j", "main", *named("_y"))
    pairs = x.join(y.hint("merge"), ["shingle", "i", "j"]).filter("root_x <> root_y AND (root_y = main OR node_x < node_y)")
    pairs = pairs.filter(F.least("size_x", "size_y") >= similarity * F.greatest("size_x", "size_y") - 1e-6)
    most = F.when(F.col("whole_x") & F.col("whole_y"), 0).otherwise(F.least("at_x", "at_y"))
    most += F.least(F.col("size_x") - F.col("at_x"), F.col("size_y") - F.col("at_y"))
    pairs = pairs.filter(most >= similarity / (1 + similarity) * (F.col("size_x") + F.col("size_y")) - 1e-6)
    pairs = pairs.filter(~F.arrays_overlap("first_x", "first_y"))
    return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def keep_first(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """One row of docs for each group of copies: that of the smallest doc_id (null last; of equal rows: any one).

    Groups are the components of all pairs whose five-word shingle sets have at least this Jaccard similarity. Texts of
    equal words are grouped first. Then FAMILIES independent fingerprints of the word set go through the covering tables (a
    few changed words move a word set's fingerprint by a few bits, those of five-word shingles by three times as many);
    a bucket gives a spanning forest and each text's two nearest, and what is verified is linked. That finds most groups at
    little cost but is not complete; rare_pairs then gives every pair left between two components, and those are verified too.
    """
    spark = docs.sparkSession
    order = F.struct(F.col("doc_id").isNull(), "doc_id")
    # Sequences that stand once, by far the most, become nodes where they are; only the others are shuffled.
    repeated = stored(counted(docs, "text", sequence_half), "repeated")
    shared = spark.sparkContext.broadcast(key_filter(repeated.select("key"), repeated.count()))
    counts = shingle_counts(docs, "text")
    sketched = lambda maybe: sketches(docs, "text", ["doc_id"], shared, maybe, counts, similarity).withColumn("least", order)
    made = ["__same", "least", "fps", "size", "prefix", "parity"]
    alone = sketched(False).select(*made, F.lit(1).cast("long").alias("n"))
    many = sketched(True).groupBy("__same")
    many = many.agg(F.min("least").alias("least"), *[F.first(c).alias(c) for c in made[2:]], F.count(F.lit(1)).alias("n"))
    nodes = stored(alone.unionByName(many).withColumn("node", F.monotonically_increasing_id()), "nodes")
    prints = nodes.select("node", F.posexplode("fps").alias("family", "fp"))
    edges = near_edges(prints, radius, bucket, WITHIN, nearest=2)
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "candidates")
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("__id")
    half = F.conv(F.hex(F.substring("__same", 1, 8)), 16, -10).cast("long")  # as first_half

    def held(edges):
        edges = stored(likely_pairs(edges, nodes.select("node", "size", "parity"), similarity), "likely")
        asked = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
        firsts = stored(nodes.join(asked, "node").select("node", key("least.doc_id"), "__same"), "firsts")
        # Only rows that the filter of such keys lets through are shuffled with their texts; all others stand alone.
        shared = spark.sparkContext.broadcast(key_filter(firsts.select(half), firsts.count()))
        texts = name_sequences(docs.select("text", key("doc_id")), "text", shared).filter("__maybe").join(firsts.hint("merge"), ["__same", "__id"])
        texts = texts.dropDuplicates(["__same", "__id"]).select("node", "text")
        return verified(edges, stored(shingle_sets(texts, "text", ["node"]), "shingles"), similarity)

    links = stored(components(held(edges)), "links")
    more = stored(rare_pairs(nodes.select("node", "size", "prefix"), links, similarity), "pairs")
    more = stored(held(more), "found")
    if not more.isEmpty():
        links = stored(components(links.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), "links")
    rooted = nodes.join(links, "node", "left").select(F.coalesce("root", "node").alias("root"), "least", "__same", "n")
    groups = rooted.groupBy("root").agg(F.sum("n").alias("rows")).filter("rows > 1").select("root")
    many = stored(rooted.join(groups, "root").select("__same"), "copied")
    shared = spark.sparkContext.broadcast(key_filter(many.select(half), many.count()))
    named = name_sequences(docs.withColumn("__id", key("doc_id")), "text", shared)
    stay = rooted.groupBy("root").agg(F.min(F.struct("least", "__same")).alias("x"))
    stay = stay.select(key("x.least.doc_id"), F.col("x.__same").alias("__same"))
    left = named.filter("__maybe").join(stay, ["__same", "__id"], "left_semi")
    out = named.filter("NOT __maybe").unionByName(left.dropDuplicates(["__same", "__id"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
