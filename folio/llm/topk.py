"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length (logarithmic norm bins, read off a histogram); a bin of more than BLOCK vectors is dealt into
several blocks by a hash, so a length that many share is no hot group. The blocks of the longest bin are searched first and
give each query a threshold. Then every query meets the blocks of the bins that can reach it (a stated query set against
all rows, in blocks); the others are left out before anything is moved. In a block, a query's local cosine threshold is its threshold over the product of its own length and the block's
longest. Above one the block is skipped; where it is high, coordinates prune: a vector at that angle must have the query's
largest coordinates within certain bounds; where it is low, length prunes. What is left is verified by exact products.

Defined results: vectors null or with null, NaN or infinite components take no part; null vec_ids are candidates of no one
and no queries; shorter vectors count as padded with zeros; ties go to the smaller vec_id; rows repeated with one vec_id are
candidates each, and one query; an empty table gives an empty result. A finite vector whose quantised length is 2^31 or
more could have products beyond 64 bits: the search fails and names it, rather than give a wrapped score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

TOP, BLOCK, QUERIES = 5, 8192, 1024
#: Quantised vectors are shorter than this, so that no inner product leaves 64 bits.
LONGEST = 1 << 31
#: Local cosine threshold from which coordinates prune better than lengths; how many coordinates.
STEEP, COORDINATES = 0.6, 4

HIT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def quantised(table: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, vec, norm) of the rows that take part; vec: floor(scale * x), norm: the Euclidean length."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = table.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = rows.select(F.col("vec_id").cast("long"), vec.alias("vec")).withColumn("norm", norm)
    long = F.raise_error(F.concat(F.lit("vector too long for 64-bit products: vec_id "), F.col("vec_id").cast("string")))
    return rows.withColumn("norm", F.when(F.col("norm") < float(LONGEST), F.col("norm")).otherwise(long.cast("double")))


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows, padded with zeros."""
    offsets = vectors.offsets.to_numpy()
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(offsets)
    out = np.zeros((len(sizes), dims), np.int64)
    at = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


def products(q: np.ndarray, v: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products; in floating point while every partial sum is below 2^53."""
    return (q.astype(float) @ v.astype(float).T).astype(np.int64) if bound < 2**53 else q @ v.T


def best(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Positions of the `top` highest scores, ties to the smaller id."""
    if len(scores) > top:
        least = np.partition(scores, len(scores) - top)[len(scores) - top]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:top]]


def within(q: np.ndarray, unit: np.ndarray, sorted_by: tuple, cosine: float) -> np.ndarray:
    """Positions that can be at the cosine or above from unit vector q, by its largest coordinates."""
    order, columns = sorted_by
    count = np.zeros(len(unit), np.int8)
    top = np.argsort(-np.abs(q))[:COORDINATES]
    side = np.sqrt(max(0.0, 1 - cosine * cosine))
    for f in top:
        x, rest = q[f], np.sqrt(max(0.0, 1 - q[f] * q[f]))
        low = -1.0 if x * 1.0 < -cosine else x * cosine - rest * side
        high = 1.0 if x > cosine else x * cosine + rest * side
        a, b = np.searchsorted(columns[f], low - 1e-9), np.searchsorted(columns[f], high + 1e-9, "right")
        count[order[f][a:b]] += 1
    return np.flatnonzero(count == len(top))


def search(q_ids, q, least, v_ids, v, top: int) -> list[tuple[int, int, int]]:
    """(query, vector, score): for each query the best of one block that reach its threshold `least` (-inf: none yet)."""
    out = []
    qn, vn = np.sqrt((q.astype(float) ** 2).sum(1)), np.sqrt((v.astype(float) ** 2).sum(1))
    by_length = np.argsort(-vn, kind="stable")
    v, vn, v_ids = v[by_length], vn[by_length], v_ids[by_length]
    longest, bound = (vn[0] if len(vn) else 0.0), float((qn.max() if len(qn) else 0) * (vn[0] if len(vn) else 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(qn * longest > 0, least / (qn * longest), -np.inf)
    skip = least > qn * longest * (1 + 1e-9) + 1e-6
    steep = (local >= STEEP) & ~skip
    if steep.any():
        unit = v / np.maximum(vn, 1e-300)[:, None]
        columns = {}
        order = {}
        for f in np.unique(np.argsort(-np.abs(q[steep]), axis=1)[:, :COORDINATES]):
            order[f] = np.argsort(unit[:, f], kind="stable")
            columns[f] = unit[order[f], f]
        for i in np.flatnonzero(steep).tolist():
            at = within(q[i] / qn[i], unit, (order, columns), min(1.0, local[i]) - 1e-9)
            at = at[(v_ids[at] != q_ids[i]) & (vn[at] * qn[i] * (1 + 1e-9) + 1e-6 >= least[i])]
            s = products(q[i : i + 1], v[at], bound)[0]
            at, s = at[s >= least[i]], s[s >= least[i]]
            out += [(int(q_ids[i]), int(v_ids[at[j]]), int(s[j])) for j in best(s, v_ids[at], top)]
    flat = np.flatnonzero(~steep & ~skip)
    for a in range(0, len(flat), 64):
        own = flat[a : a + 64]
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(qn[own] > 0, least[own] / qn[own] * (1 - 1e-9) - 1e-6, -np.inf)
        n = int(np.searchsorted(-vn, -reach.min(), "right"))
        scores = products(q[own], v[:n], bound)
        for i, s in zip(own.tolist(), scores):
            at = np.flatnonzero((s >= least[i]) & (v_ids[:n] != q_ids[i])) if np.isfinite(least[i]) else np.flatnonzero(v_ids[:n] != q_ids[i])
            out += [(int(q_ids[i]), int(v_ids[at[j]]), int(s[at[j]])) for j in best(s[at], v_ids[at], top)]
    return out


def _search_pairs(pairs: DataFrame, top: int) -> DataFrame:
    """pairs: rows of (queries, rows), each a list of structs."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q, v = batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten()
                dims = max([0, *(pc.max(pc.list_value_length(x.field("vec"))).as_py() or 0 for x in (q, v))])
                least = q.field("least").to_numpy(zero_copy_only=False).astype(float)
                hits = search(
                    q.field("vec_id").to_numpy(), matrix(q.field("vec"), dims), np.where(np.isnan(least), -np.inf, least),
                    v.field("vec_id").to_numpy(), matrix(v.field("vec"), dims), top,
                )
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*hits) if hits else ((), (), ()))], schema=schema)

    return pairs.select("queries", "rows").mapInArrow(run, HIT)


def _lists(rows: DataFrame, keys: list[str], fields: list[str], name: str) -> DataFrame:
    """One row a key with its rows as a list of structs: by a sort that can spill, one key in memory at a time.

    collect_list would hold a task's whole share of the table on the heap: with few keys its hash map never spills.
    """
    typed = lambda names: [T.StructField(c, rows.schema[c].dataType) for c in names]
    schema = T.StructType([*typed(keys), T.StructField(name, T.ArrayType(T.StructType(typed(fields))))])

    def run(table: pa.Table) -> pa.Table:
        members = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in fields], names=fields)
        own = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), members)
        return pa.table([*(table.column(c).slice(0, 1).combine_chunks() for c in keys), own], names=[*keys, name])

    return rows.select(*keys, *fields).groupBy(*keys).applyInArrow(run, schema)


def _ranked(hits: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def top_k(table: DataFrame, query, top: int = TOP, scale: int = 256, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for every row where `query` holds, the `top` other rows of highest inner product."""
    rows = quantised(table, scale).withColumn("bin", F.floor(4 * F.log2(F.col("norm") + 1)).cast("int"))
    rows = stored(rows.withColumn("is_query", query), "vectors")
    sizes = sorted(((r["bin"], r["n"]) for r in rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()), reverse=True)
    spark = rows.sparkSession
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Blocks are numbered from the longest bin on.
    first, parts, total = {}, {}, 0
    for b, n in sizes:
        first[b], parts[b] = total, -(-n // block)
        total += parts[b]
    pick = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("bin"))
    spread = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), pick(parts))
    blocks = rows.withColumn("block", (pick(first) + spread).cast("int"))
    # Stored as single vectors: a reader takes thousands of rows at once, which must not be thousands of blocks.
    blocks = stored(blocks.select("block", "vec_id", "vec"), "blocks")
    listed = lambda b: _lists(b, ["block"], ["vec_id", "vec"], "rows")

    asked = rows.filter("is_query").select("vec_id", "vec", "norm").dropDuplicates(["vec_id"])
    asked = stored(asked, "queries")
    n_blocks = max(1, -(-asked.count() // queries))

    def grouped(q: DataFrame, *keys: str) -> DataFrame:
        q = q.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))
        return _lists(q, [*keys, "qb"], ["vec_id", "vec", "least"], "queries")

    # The longest vectors go to every block of queries.
    longest = listed(blocks.filter("block = 0")).select("rows", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("qb"))
    seeds = grouped(asked.withColumn("least", F.lit(float("nan")))).withColumn("qb", F.col("qb").cast("long"))
    found = stored(_search_pairs(seeds.join(longest.hint("merge"), "qb"), top), "seeds")
    if total == 1:
        return _ranked(found, top).select("query_id", "rank", "vec_id", "score")
    least = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least"))
    least = least.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= top, F.col("least")).otherwise(float("nan")).alias("least"))
    again = asked.join(least.hint("merge"), "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(float("nan"))))
    # A query goes to the blocks of bins whose longest vectors can reach its threshold: a prefix, as bins fall in length.
    reach = F.when(F.isnan("least") | (F.col("norm") == 0), F.lit(float("-inf"))).otherwise(F.col("least") / F.col("norm") * (1 - 1e-9) - 1e-6)
    last = F.lit(0)
    for b, _ in sizes:  # the bin b ends at 2^((b + 1) / 4) - 1
        last = F.when(F.lit(2.0 ** ((b + 1) / 4) - 1) >= F.col("reach"), first[b] + parts[b] - 1).otherwise(last)
    again = again.withColumn("reach", reach).withColumn("last", last)
    pairs = grouped(again.filter("last > 0"), "last")
    pairs = pairs.withColumn("block", F.explode(F.sequence(F.lit(1), F.col("last")))).repartition(total, "block")
    # Both sides grow with the table, and the planner knows neither's size: it sees the small file of queries, not that they
    # are repeated for every block, and would gather them on the driver for a broadcast.
    rest = _search_pairs(pairs.hint("merge").join(listed(blocks.filter("block > 0")).hint("merge"), "block"), top)
    return _ranked(found.union(rest), top).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, every: int = 50) -> DataFrame:
    """The 5 best of every embeddings row whose vec_id is divisible by `every`."""
    return top_k(embeddings, F.coalesce(F.col("vec_id") % every == 0, F.lit(False)))
