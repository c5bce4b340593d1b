"""Language identification by interpolated Kneser-Ney character models, one per language.

Counting: every training text's character 4-grams (letters lower-cased, everything else one space) are counted by language
in Arrow batches and summed in a shuffle that carries distinct 4-grams only. Lower orders are Kneser-Ney continuation
counts, made in Spark from all 4-grams, and so are the discounts and the totals of contexts: nothing is cut before.

Model: every order stores a sorted array of 64-bit hashes of its n-grams, with the languages that have each and their
log-probabilities; and one of contexts with their backoff weights. Memory so grows with the n-grams, not with their number
times that of languages. An order holds at most MODEL_GRAMS entries, shared equally among the languages: where a language
has more, its rarest fall back to the lower orders, with their share of the probability in the context's weight, so that
probabilities still add up to one. A small language keeps its n-grams whatever the others have.

Scoring: a text's 4-grams are scored in all languages at once by binary searches, each distinct one once in SCORED_BYTES.

Prediction: the lowest cross-entropy per character. Rejection is calibrated on texts that the model has not seen: one in
FOLDS training texts (by a hash of the text, so copies go together) is scored by a model of the others. For each language
and length class the bound is the quantile QUANTILE of their cross-entropies plus MARGIN nats, or the loosest of the
language where a class has none; a text above it, or without any letter, is rejected. Final models learn from all.

Defined results: null text, or text without a letter: `und`, score 0, rejected. Ties go to the first language in order of
name. No training text at all: every text is `und`. Repeated rows each count. Columns named like the new ones are replaced.
A language without any calibration text rejects nothing but texts without letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, give_back, map_texts, row_ranges, stored, text_slices

ORDER = 4
#: Entries that an order of a model stores at most, over all languages (16 bytes each).
MODEL_GRAMS = 1 << 21
QUANTILE, MARGIN, FOLDS = 0.999, 0.5, 8
LENGTHS = (16, 64, 256, 1024)
UNKNOWN = "und"
#: Distinct 4-grams of one language that a task sums up before it hands them on.
FLUSH = 1 << 20
#: Text bytes scored at once (fewer with more than eight languages): each takes some 120 bytes of arrays meanwhile.
SCORED_BYTES = 1 << 18
#: Slots for distinct 4-grams of a batch.
SLOT_BITS = 18

_P = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter; made once per worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def characters(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, others than letters as one space, and the texts' bounds.

    Before each text stand ORDER - 1 spaces, so its first letters are predicted too, and one space ends it.
    """
    frame = " " * (ORDER - 1)
    points = [
        np.frombuffer(f"{frame}{t.decode('utf-8', 'replace').lower()} ".encode("utf-32-le"), np.uint32) if t else np.full(ORDER - 1, 32, np.uint32)
        for t in texts
    ]
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in points]))).astype(np.int64)
    flat = np.concatenate(points) if points else np.zeros(0, np.uint32)
    flat = np.where(letters()[flat], flat, np.uint32(32))
    kept = np.ones(len(flat), bool)
    kept[1:] = (flat[1:] != 32) | (flat[:-1] != 32)
    for i in range(ORDER - 1):
        kept[bounds[:-1] + i] = True
    before = np.concatenate(([0], np.cumsum(kept)))
    return flat[kept].astype(np.uint64), before[bounds]


def gram_codes(points: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n-gram of code points."""
    size = len(points) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    h = points[:size].copy()
    for j in range(1, n):
        h = h * _P + points[j : j + size]
    return h


def gram_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """The positions of n 4-grams that lie inside one text."""
    inside = np.ones(n, bool)
    cuts = bounds[1:-1]
    for j in range(1, ORDER):
        at = cuts - j
        inside[at[(at >= 0) & (at < n)]] = False
    return np.flatnonzero(inside)


COUNTED = T.StructType(
    [T.StructField("lang", T.StringType()), T.StructField("seen", T.BooleanType()), T.StructField("ctx", T.LongType()), T.StructField("z", T.IntegerType()), T.StructField("n", T.LongType())]
)


def _sum_up(parts: list[tuple]) -> tuple:
    h, ctx, z, n = (np.concatenate(x) for x in zip(*parts))
    h, first, where = np.unique(h, return_index=True, return_inverse=True)
    return h, ctx[first], z[first], np.bincount(where, n).astype(np.int64)


def gram_counts(training: DataFrame, text: str = "text", lang: str = "lang", folds: int = FOLDS) -> DataFrame:
    """(lang, ctx, z, n, n_fit): how often each character 4-gram occurs, in all and outside of the calibration texts.

    ctx: its first three code points in one number, z: the last.
    """
    schema = pa.schema([("lang", pa.string()), ("seen", pa.bool_()), ("ctx", pa.int64()), ("z", pa.int32()), ("n", pa.int64())])

    def run(batches):
        sums: dict[tuple, tuple] = {}

        def rows(key):
            _, ctx, z, n = sums.pop(key)
            for a in range(0, len(n), 50_000):
                s = slice(a, a + 50_000)
                m = len(n[s])
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * m), pa.array([key[1]] * m), pa.array(ctx[s]), pa.array(z[s]), pa.array(n[s])], schema=schema)

        for batch in batches:
            for part, texts in text_slices(batch, text):
                of = list(zip(part.column(1).to_pylist(), part.column(2).to_pylist()))
                for key in sorted(set(of)):
                    c, bounds = characters([t for t, x in zip(texts, of) if x == key])
                    h = gram_codes(c, ORDER)
                    at = gram_starts(bounds, len(h))
                    h, first, n = np.unique(h[at], return_index=True, return_counts=True)
                    at = at[first]
                    ctx = (c[at] << np.uint64(42) | c[at + 1] << np.uint64(21) | c[at + 2]).astype(np.int64)
                    own = (h, ctx, c[at + 3].astype(np.int32), n)
                    sums[key] = _sum_up([sums[key], own]) if key in sums else own
                    if len(sums[key][0]) > FLUSH:
                        yield from rows(key)
        for key in list(sums):
            yield from rows(key)
        give_back()

    rows = training.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select(F.col(text).alias(text), F.col(lang).alias("__lang"), (~calibrates(F.col(text), folds)).alias("__seen"))
    counted = rows.mapInArrow(run, COUNTED)
    return counted.groupBy("lang", "ctx", "z").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("seen"), F.col("n")).otherwise(0)).alias("n_fit"))


def calibrates(text: Column, folds: int = FOLDS) -> Column:
    """Whether a training text is held back for calibration."""
    return F.coalesce(F.pmod(F.xxhash64(text), F.lit(folds)) == 0, F.lit(False))


def continuations(grams: DataFrame, order: int) -> DataFrame:
    """(lang, ctx, z, c) of the next lower order: how many distinct characters stand before each."""
    mask = F.lit((1 << 21 * (order - 2)) - 1)
    return grams.groupBy("lang", F.col("ctx").bitwiseAND(mask).alias("ctx"), "z").agg(F.count(F.lit(1)).alias("c"))


def _bin(c: Column) -> Column:
    """Counts exact up to 1024, then the start of a 16th of an octave: few distinct values whatever the counts."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(c, F.lit(1024)))) - 4)
    return F.when(c <= 1024, c).otherwise((F.floor(c / step) * step).cast("long")).cast("long")


def order_rows(grams: DataFrame, quota: int) -> tuple[DataFrame, dict[str, float]]:
    """The entries (lang, ctx, z, c, total) that are stored, `quota` of a language at most, and the languages' discounts.

    total: of c over all entries of the context, those that are not stored included.
    """
    bins = grams.groupBy("lang", _bin(F.col("c")).alias("b")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    by: dict[str, list] = {}
    for lang, b, n in zip(*(bins.column(x).to_pylist() for x in ("lang", "b", "n"))):
        by.setdefault(lang, []).append((b, n))
    discounts, least = {}, {}
    for lang, counts in by.items():
        few = dict(counts)
        n1, n2 = few.get(1, 0), few.get(2, 0)
        discounts[lang] = float(np.clip((n1 + 0.5) / (n1 + 2 * n2 + 1.0), 0.1, 0.95))
        room = quota
        for b, n in sorted(counts, reverse=True):
            room -= n
            if room < 0:
                break
            least[lang] = b
    spark = grams.sparkSession
    cut = spark.createDataFrame([(x, least.get(x, 1 << 62)) for x in by], "lang string, least long")
    totals = grams.groupBy("lang", "ctx").agg(F.sum("c").alias("total"))
    kept = grams.join(F.broadcast(cut), "lang").filter(_bin(F.col("c")) >= F.col("least")).drop("least")  # a row a language
    return kept.join(totals, ["lang", "ctx"]), discounts


class Sparse:
    """Values by hash and language: sorted distinct `keys`, and for each the run of its languages with their values."""

    def __init__(self, h: np.ndarray, lang: np.ndarray, value: np.ndarray):
        order = np.lexsort((lang, h))
        h = h[order]
        self.lang, self.value = lang[order].astype(np.int32), value[order].astype(np.float32)
        self.starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
        self.keys = h[self.starts]
        self.starts = np.append(self.starts, len(h))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in h, language, value) of every entry that h hits."""
        if not len(self.keys):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.float32),)
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[i] == h)
        i = i[hit]
        sizes = self.starts[i + 1] - self.starts[i]
        rows = np.repeat(hit, sizes)
        entry = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[i], sizes)
        return rows, self.lang[entry], self.value[entry]


def _hashes(ctx: np.ndarray, n: int, z: np.ndarray | None = None) -> np.ndarray:
    """The hash of n packed code points, and one more."""
    ctx = ctx.astype(np.uint64)
    h = np.zeros(len(ctx), np.uint64)
    for j in range(n - 1, -1, -1):
        h = h * _P + (ctx >> np.uint64(21 * j) & np.uint64((1 << 21) - 1))
    return h if z is None else h * _P + z.astype(np.uint64)


class KneserNey:
    """Interpolated Kneser-Ney models of all languages, each order and its contexts in sorted hash arrays."""

    def __init__(self, langs: list[str], orders: dict[int, tuple], characters: int):
        """orders: order -> (language index, ctx, z, c, total, discounts of the languages); characters: distinct ones."""
        self.langs = langs
        self.floor = float(np.log(1.0 / (characters + 1)))
        self.grams: dict[int, Sparse] = {}
        self.contexts: dict[int, Sparse] = {}
        self.first = np.zeros(len(langs), np.float32)
        for order in range(1, ORDER + 1):
            of, ctx, z, c, total, discounts = orders[order]
            share = np.maximum(c - discounts[of], 0) / np.maximum(total, 1)
            by = np.lexsort((ctx, of))
            new = np.ones(len(by), bool)
            new[1:] = (ctx[by][1:] != ctx[by][:-1]) | (of[by][1:] != of[by][:-1])
            at, where = by[new], np.empty(len(by), np.int64)
            where[by] = np.cumsum(new) - 1
            weight = np.maximum(1 - np.bincount(where, share, len(at)), 1e-6)
            points = np.column_stack([ctx >> 21 * j & (1 << 21) - 1 for j in range(order - 2, -1, -1)] + [z]).astype(np.uint64)
            below = np.exp(self.log_rows(points[:, 1:])[np.arange(len(of)), of]) if order > 1 else np.exp(self.floor)
            self.grams[order] = Sparse(_hashes(ctx, order - 1, z), of, np.log(share + weight[where] * below))
            if order > 1:
                self.contexts[order] = Sparse(_hashes(ctx[at], order - 1), of[at], np.log(weight))
            else:
                self.first[of[at]] = np.log(weight)

    def log_rows(self, points: np.ndarray) -> np.ndarray:
        """For n-grams as rows of code points, the log-probability of the last in each language, from the orders known."""
        n = points.shape[1]
        out = np.tile(self.first + np.float32(self.floor), (len(points), 1))
        for order in range(1, n + 1):
            own = points[:, n - order :]
            h = np.zeros(len(points), np.uint64)
            for j in range(order - 1):
                h = h * _P + own[:, j]
            if order > 1:
                rows, lang, value = self.contexts[order].find(h)
                out[rows, lang] += value
            rows, lang, value = self.grams[order].find(h * _P + own[:, -1])
            out[rows, lang] = value
        return out

    def entropies(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character in each language, and the number of characters scored; a text of no letter has 0."""
        limit = max(SCORED_BYTES >> 3, 8 * SCORED_BYTES // max(8, len(self.langs)))
        out, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for a, b in row_ranges([len(t) if t else 0 for t in texts], limit):
            out[a:b], sizes[a:b] = self._entropies(texts[a:b])
        return out, sizes

    def _entropies(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        c, bounds = characters(texts)
        sums, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        h = gram_codes(c, ORDER)
        at = gram_starts(bounds, len(h))
        if len(at):
            rows = np.searchsorted(bounds, at, "right") - 1
            h = h[at]
            # Each slot stands for one 4-gram; those that share a slot with another are scored apart.
            slot = (h * _P >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            holder = np.full(1 << SLOT_BITS, -1, np.int64)
            holder[slot] = np.arange(len(h))
            held = holder[slot]
            apart = np.flatnonzero(h[held] != h)
            used = np.flatnonzero(holder >= 0)
            chosen = np.concatenate([holder[used], apart])
            points = np.column_stack([c[at[chosen] + j] for j in range(ORDER)])
            place = np.zeros(1 << SLOT_BITS, np.int64)
            place[used] = np.arange(len(used))
            which = place[slot]
            which[apart] = len(used) + np.arange(len(apart))
            logp = self.log_rows(points)[which]
            starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            sums[rows[starts]] = np.add.reduceat(logp, starts, axis=0, dtype=np.float64)
            sizes[rows[starts]] = np.diff(np.concatenate((starts, [len(rows)])))
        some = np.add.reduceat(c != 32, bounds[:-1]) if len(texts) else sizes
        sizes[some == 0] = 0
        return -sums / np.maximum(sizes, 1)[:, None], sizes


def build(counts: DataFrame, count: str, max_grams: int = MODEL_GRAMS) -> KneserNey | None:
    """A model from 4-gram counts (lang, ctx, z and the column `count`); None if there are none."""
    grams = counts.filter(F.col(count) > 0).select("lang", "ctx", "z", F.col(count).alias("c"))
    langs = sorted(r.lang for r in grams.select("lang").distinct().toLocalIterator())
    if not langs:
        return None
    index = {x: i for i, x in enumerate(langs)}
    quota, orders, points = max(1, max_grams // len(langs)), {}, 0
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            grams = stored(continuations(grams, order + 1), f"grams{order}")
        kept, discounts = order_rows(grams, quota)
        made = kept.select("lang", "ctx", "z", "c", "total").toArrow()
        of = np.array([index[x] for x in made.column("lang").to_pylist()], np.int64)
        columns = [made.column(x).to_numpy() for x in ("ctx", "z", "c", "total")]
        orders[order] = (of, *columns, np.array([discounts[x] for x in langs]))
        if order == 1:
            points = grams.select("z").distinct().count()
    return KneserNey(langs, orders, points)


def fit(training: DataFrame, text: str = "text", lang: str = "lang", max_grams: int = MODEL_GRAMS) -> tuple[KneserNey | None, KneserNey | None]:
    """A model from all training rows, and one from those not held back for calibration; None where there is no 4-gram."""
    counts = stored(gram_counts(training, text, lang), "grams")
    return build(counts, "n", max_grams), build(counts, "n_fit", max_grams)


SCORED = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("entropy", T.DoubleType()),
        T.StructField("n_scored", T.LongType()),
    ]
)


def score(docs: DataFrame, model: KneserNey | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred, score (0 to 1), entropy (nats per character in that language) and n_scored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def f(texts, _):
            if model is None:
                return [[UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts), [0] * len(texts)]
            e, sizes = model.entropies(texts)
            best = e.argmin(1)
            low = e[np.arange(len(e)), best]
            sure = 1 / np.exp(-(e - low[:, None]) * np.minimum(sizes, 50)[:, None]).sum(1)
            some = sizes > 0
            return [
                [model.langs[b] if s else UNKNOWN for b, s in zip(best, some)],
                np.where(some, sure, 0.0),
                pa.array(low, mask=~some),
                sizes,
            ]

        return f

    return map_texts(docs, text, SCORED, make, keep=keep)


def length_class(n) -> Column:
    return sum((F.when(n >= x, 1).otherwise(0) for x in LENGTHS), F.lit(0))


def thresholds(training: DataFrame, model: KneserNey | None, text: str = "text", quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(lang_pred, class, most): the bounds of the entropy, from the training rows that `model` was not fitted to.

    A row for each language and length class at most.
    """
    scored = score(training.filter(calibrates(F.col(text))).select(F.col(text).alias(text)), model, text, keep=[])
    rows = scored.filter(F.col("entropy").isNotNull()).withColumn("class", length_class(F.col("n_scored")))
    return rows.groupBy("lang_pred", "class").agg((F.percentile_approx("entropy", quantile, 1000) + margin).alias("most"))


def with_rejection(scored: DataFrame, bounds: DataFrame) -> DataFrame:
    """scored with `rejected`. bounds has at most a row for each language and length class.

    A class without calibration texts takes the language's loosest bound.
    """
    bounds = stored(bounds, "bounds")
    loosest = F.broadcast(bounds.groupBy("lang_pred").agg(F.max("most").alias("loosest")))
    joined = scored.withColumn("class", length_class(F.col("n_scored"))).join(F.broadcast(bounds), ["lang_pred", "class"], "left").join(loosest, "lang_pred", "left")
    rejected = (F.col("n_scored") == 0) | F.coalesce(F.col("entropy") > F.coalesce("most", "loosest"), F.lit(False))
    return joined.withColumn("rejected", rejected).drop("class", "most", "loosest")


def identify(docs: DataFrame, fold: int = 4, held: int = 2, max_grams: int = MODEL_GRAMS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, rejected for every document; learns from those not held out."""
    held_out = F.coalesce(crc_mod("doc_id", fold) == held, F.lit(False))
    rows = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    training = rows.filter(~F.col("held_out") & F.col("lang").isNotNull())
    model, calibration = fit(training, max_grams=max_grams)
    bounds = thresholds(training, calibration)
    out = with_rejection(score(rows, model, keep=["doc_id", "held_out"]), bounds)
    return out.select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


def keep_identified(docs: DataFrame, max_grams: int = MODEL_GRAMS) -> DataFrame:
    """docs without those that are rejected: no letter, or unlike every language learnt from the labelled rows."""
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in own.items()])
    training = renamed.filter(F.col(own["lang"]).isNotNull())
    model, calibration = fit(training, own["text"], own["lang"], max_grams)
    bounds = thresholds(training, calibration, own["text"])
    out = with_rejection(score(renamed, model, own["text"]), bounds).filter(~F.col("rejected"))
    return out.select(*[F.col(x).alias(c) for c, x in own.items()])
