"""Semantic search: exact inner products with a query vector, the best few of each document, relevance bands."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
TOP, STRONG, MODERATE = 5, 0.60, 0.45
BATCH, DIM = 64, 768
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def band(score: Column) -> Column:
    return F.when(score >= STRONG, "strong").when(score >= MODERATE, "moderate").otherwise("weak")


def rank_chunks(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The `top` chunks of each document by score, then page, then chunk. Chunks that hold the query go before ranking."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "page", "chunk_index")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def hashed_encoder(dim: int = DIM) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a trained encoder: unit vectors of hashed words. It knows no synonyms."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts):
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def embed(chunks: DataFrame, make_encoder=hashed_encoder, text: str = "text") -> DataFrame:
    """chunks with `embedding`; the encoder is made once for each worker and gets batches of BATCH passages.

    A batch that fails has null embeddings, so that one bad passage fails no job.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for texts in batches:
            rows: list = []
            for i in range(0, len(texts), BATCH):
                own = list(texts[i : i + BATCH])
                try:
                    rows += list(np.asarray(encode(own), np.float32))
                except Exception:  # the contract: passages that cannot be encoded match nothing, the search goes on
                    rows += [None] * len(own)
            yield pd.Series(rows, index=texts.index)

    return chunks.withColumn("embedding", run(text))


def unavailable(make_encoder, dim: int | None = None) -> str | None:
    """Why an encoder cannot be used: it fails, or its vectors have other than `dim` numbers. Null if it can."""
    try:
        got = np.asarray(make_encoder()([QUERY_PREFIX]))
    except Exception as e:
        return f"unavailable: semantic search failed ({e})"
    if dim is not None and (got.ndim != 2 or got.shape[1] != dim):
        return f"unavailable: expected {dim}-dim embeddings, got {got.shape[-1] if got.ndim else 0}"
    return None


def search(chunks: DataFrame, query: str, pattern: str, make_encoder=hashed_encoder, top: int = TOP, least: float | None = None) -> DataFrame:
    """The best chunks of each document that do not hold the query itself: doc_id, page, chunk_index, score, relevance, rank."""
    vector = [float(x) for x in make_encoder()([QUERY_PREFIX + query])[0]]
    rows = embed(chunks.filter(~F.col("text").rlike(pattern)), make_encoder).filter("embedding IS NOT NULL")
    rows = rows.withColumn("score", dot(F.col("embedding"), F.array(*[F.lit(x) for x in vector])))
    rows = rows if least is None else rows.filter(F.col("score") >= least)
    return rank_chunks(rows, top).withColumn("relevance", band(F.col("score")))


def text_key(texts: Column) -> Column:
    """SHA-256 of a list of texts, each ended by a zero byte: names stored embeddings."""
    return F.sha2(F.concat(F.array_join(texts, "\0"), F.lit("\0")), 256)


#: Bytes of query vectors and of rows that one task holds; scores that it holds at once, and pairs that it verifies at once.
BLOCK_BYTES, TILE_BYTES, SCORES, PAIRS = 1 << 20, 16 << 20, 1 << 21, 1 << 16


def _vectors(table: pa.Table, name: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """size: (positions, matrix) of a column of lists; size -1 are those without a score."""
    sizes, lists, out = table["size"].to_numpy(), table[name].combine_chunks(), {}
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float)
        out[int(size)] = at, flat.reshape(len(at), max(int(size), 0))
    return out


def _first(qi: np.ndarray, vi: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `top` pairs of each query by score (NaN before all else), ties by the row's place."""
    nan = np.isnan(scores)
    order = np.lexsort((vi, -np.where(nan, 0.0, scores), ~nan, qi))
    own = qi[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    keep = order[np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)])) < top]
    return qi[keep], vi[keep], scores[keep]


def best_pairs(q: np.ndarray, v: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): the `top` rows of each query by inner product, ties to the first row.

    A matrix product finds the rows that can be among them, within its rounding; their scores are summed in order, as in SQL.
    """
    found, step, dims = [], max(1, SCORES // len(v)), v.shape[1]
    with np.errstate(all="ignore"):
        longest, lengths = np.sqrt((v * v).sum(1)).max(), np.sqrt((q * q).sum(1))
        for low in range(0, len(q), step):
            part = q[low : low + step]
            s = part @ v.T
            finite = np.isfinite(s)
            base = s if finite.all() else np.where(finite, s, -np.inf)
            k = max(0, len(v) - top)
            least = np.partition(base, k, axis=1)[:, k] - 8 * (dims + 2) * np.finfo(float).eps * lengths[low : low + step] * longest
            qi, vi = np.nonzero(~(s < least[:, None]) | ~finite)
            scores = np.zeros(len(qi))
            for at in range(0, len(qi), PAIRS):
                products = part[qi[at : at + PAIRS]] * v[vi[at : at + PAIRS]]
                for d in range(dims):
                    scores[at : at + PAIRS] += products[:, d]
            qi, vi, scores = _first(qi, vi, scores, top)
            found.append((qi + low, vi, scores))
    return tuple(np.concatenate(x) for x in zip(*found))


def best_of_labels(asked: pa.Table, rows: pa.Table, top: int) -> pa.Table:
    """query_id, label, vec_id, score: the `top` rows of each label other than the query's own; a null score comes last."""
    key = pc.fill_null(rows["vec_id"].cast("int64"), np.iinfo(np.int64).max).to_numpy()
    rows = rows.take(pa.array(np.lexsort((key, rows["label"].to_numpy()))))
    labels, own = rows["label"].to_numpy(), asked["own"].to_numpy()
    queries, out = _vectors(asked, "q"), []
    for size, (at, v) in _vectors(rows, "embedding").items():
        cuts = np.flatnonzero(np.r_[True, labels[at][1:] != labels[at][:-1], True])
        for low, high in zip(cuts[:-1], cuts[1:]):
            for other, (asks, q) in queries.items():
                mine = np.flatnonzero(own[asks] != labels[at[low]])
                if not len(mine):
                    continue
                if size == other and size >= 0:
                    qi, vi, scores = best_pairs(q[mine], v[low:high], top)
                    scores = pa.array(scores)
                else:
                    few = min(top, high - low)
                    qi, vi = np.repeat(np.arange(len(mine)), few), np.tile(np.arange(few), len(mine))
                    scores = pa.nulls(len(qi), pa.float64())
                took = rows.take(pa.array(at[low + vi]))
                ids = asked["query_id"].take(pa.array(asks[mine[qi]]))
                out.append(pa.table({"query_id": ids, "label": took["label"], "vec_id": took["vec_id"], "score": scores}))
    empty = {"query_id": asked["query_id"][:0], "label": rows["label"][:0], "vec_id": rows["vec_id"][:0], "score": pa.array([], pa.float64())}
    return pa.concat_tables(out) if out else pa.table(empty)


def label_search(embeddings: DataFrame, every: int = 20, top: int = TOP, broadcast_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each vector whose id is divisible by `every` as query, the best of every other label: query_id, doc_id (the label), vec_id, score, rank, relevance.

    Vectors of the query's own label count as holding the query. Queries are dealt into blocks of `broadcast_bytes` and rows
    into tiles of TILE_BYTES; each block meets each tile in a task, which gives the best of its tile alone. Vectors that are
    null, hold a null or have another size than the query have a null score and come last.
    """
    e = F.col("embedding")
    plain = e.isNotNull() & F.forall(e, lambda x: x.isNotNull())
    vectors = embeddings.filter("label IS NOT NULL").select(
        "vec_id", "label", F.when(plain, e).otherwise(F.slice(e, 1, 0)).alias("embedding"), F.when(plain, F.size(e)).otherwise(-1).alias("size")
    )
    vectors = vectors.withColumn("embedding", F.coalesce("embedding", F.array().cast(embeddings.schema["embedding"].dataType)))
    is_asked = F.col("vec_id") % every == 0
    n, asks, longest = vectors.agg(F.count(F.lit(1)), F.count_if(is_asked), F.coalesce(F.max("size"), F.lit(0))).first()
    blocks = max(1, -(-asks * (8 * longest + 64) // broadcast_bytes))
    tiles = max(1, -(-n * (8 * longest + 64) // TILE_BYTES))
    part = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    asked = vectors.filter(is_asked).select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"), F.col("embedding").alias("q"), "size", part("vec_id", blocks).alias("block"))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    rows = vectors.withColumn("tile", part("vec_id", tiles)).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    kinds = {f.name: f.dataType for f in embeddings.schema}
    made = T.StructType([T.StructField("query_id", kinds["vec_id"]), T.StructField("label", kinds["label"]), T.StructField("vec_id", kinds["vec_id"]), T.StructField("score", T.DoubleType())])
    met = asked.groupBy("block", "tile").cogroup(rows.groupBy("block", "tile"))
    pairs = met.applyInArrow(lambda a, b: best_of_labels(a, b, top), made)
    order = Window.partitionBy("query_id", "label").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    found = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return found.select("query_id", F.col("label").alias("doc_id"), "vec_id", F.round("score", 6).alias("score"), "rank", band(F.col("score")).alias("relevance"))
