"""Benchmark decontamination by winnowing.

Of every text the minimum hash of each sliding window of GAP k-gram hashes is kept, for documents and benchmark items
alike. Two texts that share WINDOW = GAP + K - 1 consecutive words share such a fingerprint at the same place, so joining
fingerprints finds every shared span of that length; each hit is then extended word by word along its alignment, which
makes the result exact whatever the hashes do. Items of fewer words than a window have no guaranteed fingerprint; they
are looked up whole.

Defined results: a null or wordless text has no words and no hits; repeated rows each get their own result; items of equal
text all count, an item_id given twice counts once; null item texts are no items, and so are null item_ids; an empty table
of either kind works. Input columns named like the new ones are replaced.
"""

from __future__ import annotations

import itertools
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, map_texts, stored

WINDOW = 8
K = 4
GAP = WINDOW - K + 1
#: Benchmark text that one broadcast index may hold; a larger benchmark is scanned in several such parts, one after another.
PART_BYTES = 32 << 20

_A = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", SPAN),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
)


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Mixed 64-bit hashes of all k-grams of word ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _A + ids[j : j + n].astype(np.uint64)
    h ^= h >> np.uint64(29)
    h *= _M
    h ^= h >> np.uint64(32)
    return h


def winnow(hashes: np.ndarray, gap: int) -> np.ndarray:
    """Positions of the minimum of each window of `gap` hashes (all of equal minima)."""
    n = len(hashes) - gap + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = hashes[:n].copy()
    for j in range(1, gap):
        np.minimum(least, hashes[j : j + n], out=least)
    chosen = np.zeros(len(hashes), bool)
    for j in range(gap):
        chosen[j : j + n] |= hashes[j : j + n] == least
    return np.flatnonzero(chosen)


def runs(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], equal.view(np.int8), [0]))))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= least]


class ItemIndex:
    """Winnowed fingerprints of a part of the benchmark; small enough for a broadcast."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, k: int = K):
        self.window, self.k, self.gap = window, k, window - k + 1
        self.vocab: dict[bytes, int] = {}
        self.names, self.ids = [], []
        for name, text in items:
            words = alnum_words(text)
            if words:
                self.names.append(name)
                self.ids.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int64))
        prints, where = [], []
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i, ids in enumerate(self.ids):
            if len(ids) >= window:
                h = gram_hashes(ids, k)
                at = winnow(h, self.gap)
                prints.append(h[at])
                where.append(np.stack([np.full(len(at), i), at], 1))
        for m in sorted({len(x) for x in self.ids if len(x) < window}):
            of = np.array([i for i, x in enumerate(self.ids) if len(x) == m])
            h = np.concatenate([gram_hashes(self.ids[i], m) for i in of])
            order = np.argsort(h, kind="stable")
            self.short[m] = (h[order], of[order])
        h = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.prints = h[order]
        self.where = (np.concatenate(where) if where else np.zeros((0, 2), np.int64))[order]

    def find(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, start, end) of all maximal spans of ids in which windows of items occur. ids: 0 for foreign words."""
        found, n = [], len(ids)
        known = ids > 0
        if len(self.prints) and n >= self.window:
            full = np.cumsum(np.concatenate(([0], known)))
            full = full[self.window :] - full[: -self.window] == self.window
            if full.any():
                h = gram_hashes(ids, self.k)
                alive = np.zeros(n + 1, np.int64)
                starts = np.flatnonzero(full)
                np.add.at(alive, starts, 1)
                np.add.at(alive, starts + self.gap, -1)
                at = winnow(h, self.gap)
                at = at[np.cumsum(alive)[at] > 0]
                lo, hi = np.searchsorted(self.prints, h[at]), np.searchsorted(self.prints, h[at], "right")
                seen = set()
                for p, a, b in zip(at[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist()):
                    for i, q in self.where[a:b].tolist():
                        if (i, p - q) in seen:
                            continue
                        seen.add((i, p - q))
                        found += [(i, s, e) for s, e in self._along(ids, i, p - q)]
        for m, (prints, of) in self.short.items():
            h = gram_hashes(ids, m)
            lo, hi = np.searchsorted(prints, h), np.searchsorted(prints, h, "right")
            for p in np.flatnonzero(lo < hi).tolist():
                found += [(int(i), p, p + m) for i in of[lo[p] : hi[p]] if np.array_equal(self.ids[i], ids[p : p + m])]
        return found

    def _along(self, ids: np.ndarray, item: int, shift: int) -> list[tuple[int, int]]:
        own = self.ids[item]
        a, b = max(0, shift), min(len(ids), shift + len(own))
        return [(a + s, a + e) for s, e in runs(ids[a:b] == own[a - shift : b - shift], self.window)]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_parts(benchmark: DataFrame, part_bytes: int = PART_BYTES):
    """The benchmark in parts of about part_bytes of text at most, one at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    items = items.filter("item IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // part_bytes)
    for i in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        yield sorted((r.item, bytes(r.text)) for r in part.toLocalIterator())


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    window: int = WINDOW,
    k: int = K,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """docs with n_words, hit_spans (merged word ranges inside occurrences of item windows) and hit_items (sorted ids).

    The benchmark is broadcast in parts of bounded size. Only one part is on the driver and in the workers at a time: what a
    part finds is stored before the next one is read.
    """
    spark = docs.sparkSession
    parts = item_parts(benchmark, part_bytes)
    part = next(parts, [])
    names = [f.name for f in FOUND]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    out = docs
    for nth in itertools.count():
        shared = spark.sparkContext.broadcast(ItemIndex(part, window, k))
        part = next(parts, None)
        last = part is None

        def make(shared=shared, first=nth == 0):
            def f(texts, part):
                index: ItemIndex = shared.value
                words = [alnum_words(t) if t else [] for t in texts]
                lengths = [len(w) for w in words]
                before_spans = [[]] * len(texts) if first else part.column("hit_spans").to_pylist()
                before_items = [[]] * len(texts) if first else part.column("hit_items").to_pylist()
                spans, items = [], []
                flat, bounds = [], [0]
                for w in words:  # a foreign word stands between texts
                    flat += w
                    flat.append(b"")
                    bounds.append(len(flat))
                ids = np.fromiter(map(index.vocab.get, flat, repeat(0)), np.int64, len(flat))
                by_row: dict[int, list] = {}
                found = index.find(ids)
                rows = np.searchsorted(bounds, [s for _, s, _ in found], "right") - 1 if found else []
                for r, hit in zip(rows, found):
                    by_row.setdefault(int(r), []).append(hit)
                for r, (old, had) in enumerate(zip(before_spans, before_items)):
                    hits = by_row.get(r, ())
                    own = [(s - bounds[r], e - bounds[r]) for _, s, e in hits] + [(x["start"], x["end"]) for x in old]
                    spans.append([{"start": a, "end": b} for a, b in merge(own)])
                    items.append(sorted({*had, *(index.names[i] for i, _, _ in hits)}))
                return [lengths, spans, items]

            return f

        out = map_texts(
            out, text, FOUND, make, keep=kept if last else list(dict.fromkeys([*kept, text])), also=[] if nth == 0 else names[1:]
        )
        if last:
            return out
        out = stored(out, "found")
        shared.unpersist()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", min_items: int = 1, **more) -> DataFrame:
    """docs without those in which windows of at least min_items items occur; columns as given."""
    found = find_items(docs, benchmark, text, **more)
    return found.filter(F.size("hit_items") < min_items).select(*[F.col(f"`{c}`") for c in docs.columns])


def contamination(docs: DataFrame, benchmark: DataFrame, min_items: int = 2) -> DataFrame:
    """The report of each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_items(docs.select("doc_id", "text"), benchmark, keep=["doc_id"])
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))
    n_items = F.size("hit_items").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (n_items >= min_items).alias("contaminated"),
    )
