"""Packing by optimal length buckets.

A global histogram of text lengths (in tokens) is aggregated; dynamic programming over it chooses the bucket boundaries
that minimise padding. Inside each bucket rows form batches of at most TOKENS padded tokens.

Histogram bins are exact up to FINE tokens and at most 1/256 wide beyond (rounded up), so the program's size is bounded by
the logarithm of the longest text; boundaries are then optimal over bin ends. Rows of a bucket are dealt into groups of
about GROUP rows by a hash of their number in the stored table of lengths, and batches form inside a group: only a group's last batch can stay short, and no task needs a
whole bucket.

Defined results: null or empty texts have 0 tokens and form batches in the smallest bucket; a text longer than TOKENS is a
batch of its own; repeated rows are all packed; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, space_words, stored

BUCKETS = 16
TOKENS = 65_536
FINE = 512
GROUP = 20_000

LENGTH = T.StructType([T.StructField("n_tokens", T.LongType())])


def token_lengths(docs: DataFrame, text: str = "text", keep: list[str] | None = None, count=None) -> DataFrame:
    """docs with n_tokens: count(bytes) of each text; by default the number of words between white space."""
    count = count or (lambda t: len(space_words(t)))
    return map_texts(docs, text, LENGTH, lambda: lambda texts, _: [[count(t) if t else 0 for t in texts]], keep=keep)


def bin_end(n: Column) -> Column:
    """The end of a length's bin: exact up to FINE, then the next multiple of a 256th of the power of two below."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(FINE)))) - 8)
    return F.when(n <= FINE, n).otherwise((F.ceil(n / step) * step).cast("long")).cast("long")


def boundaries(ends: np.ndarray, counts: np.ndarray, totals: np.ndarray, buckets: int) -> list[int]:
    """The at most `buckets` ends that minimise padding: rows of a bin are padded to the bucket's end.

    ends: ascending; counts: rows in each bin; totals: their tokens. cost(i, j): bins i..j-1 in one bucket.
    """
    n = len(ends)
    if not n:
        return []
    rows = np.concatenate(([0], np.cumsum(counts))).astype(float)
    tokens = np.concatenate(([0], np.cumsum(totals))).astype(float)
    best = np.concatenate(([0.0], ends * rows[1:] - tokens[1:]))
    back = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        new, came = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            cost = best[:j] + ends[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            i = int(cost.argmin())
            if cost[i] < new[j]:
                new[j], came[j] = cost[i], i
        best = new
        back.append(came)
    chosen, j, k = [], n, len(back) - 1
    while j > 0:
        while k > 0 and back[k][j] < 0:
            k -= 1
        chosen.append(int(ends[j - 1]))
        j, k = (int(back[k][j]), k - 1) if k > 0 else (0, 0)
    return chosen[::-1]


def choose_buckets(lengths: DataFrame, buckets: int = BUCKETS) -> list[tuple[int, int]]:
    """(end, rows) of each bucket, from the histogram of all rows; at most 512 + 256 a doubling bins reach the driver."""
    bins = lengths.groupBy(bin_end(F.col("n_tokens")).alias("end")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    bins = sorted(tuple(r) for r in bins.toLocalIterator())
    ends, counts, totals = (np.array(x, np.int64) for x in zip(*bins)) if bins else (np.zeros(0, np.int64),) * 3
    chosen = boundaries(ends, counts, totals, buckets)
    at = np.searchsorted(chosen, ends)
    return [(e, int(counts[at == i].sum())) for i, e in enumerate(chosen)]


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, tokens: int = TOKENS, group: int = GROUP, count=None
) -> DataFrame:
    """key, n_tokens, bucket (0 is the shortest), padded (its length), batch (its name) and slot (place in the batch)."""
    lengths = token_lengths(docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text)), text, [key], count)
    lengths = stored(lengths, "lengths")
    chosen = choose_buckets(lengths, buckets)
    bucket = sum((F.when(F.col("n_tokens") > end, 1).otherwise(0) for end, _ in chosen[:-1]), F.lit(0))
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("bucket") + 1)
    if not chosen:
        chosen = [(0, 0)]
    rows = lengths.withColumn("bucket", bucket.cast("int")).withColumn("padded", of([e for e, _ in chosen]).cast("long"))
    groups = of([max(1, -(-n // group)) for _, n in chosen])
    # Groups are dealt by the stored rows' numbers, so that neither equal keys nor equal rows meet in one.
    rows = rows.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), groups).cast("int"))
    place = F.row_number().over(Window.partitionBy("bucket", "__group").orderBy("n_tokens", key)) - 1
    fit = F.greatest(F.lit(1), (F.lit(tokens) / F.greatest(F.col("padded"), F.lit(1))).cast("int"))
    rows = rows.withColumn("__place", place).withColumn("__fit", fit)
    return rows.select(
        key,
        "n_tokens",
        "bucket",
        "padded",
        F.concat_ws("-", "bucket", "__group", (F.col("__place") / F.col("__fit")).cast("int")).alias("batch"),
        (F.col("__place") % F.col("__fit")).cast("int").alias("slot"),
    )
