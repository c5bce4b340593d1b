"""Language-model scoring with a gated recurrent network in numpy.

Vocabulary: word counts over all training texts are summed in a shuffle. The SHORT most frequent words (and the end of a
text) are predicted by the network word by word; every other word belongs to one of CLASSES classes by its first and last
letters, is predicted as that class, and inside it by its corpus count c as (c + 0.5) / Z, where all unknown words of a
class together count as one of c = 0. The probabilities of all words so add up to one.

Network: one gated recurrent layer; its output softmax is factored into a distribution over groups of units and one over
the units of the group. It is trained by truncated backpropagation through windows of WINDOW tokens with the state
carried on. Texts are scored whole: the state is carried across windows from the first word to the end.

Training: every training text is learnt from once. Texts are dealt into ROUNDS rounds and, in each, into parts by a hash
of key and text; parts train apart, from the average of the round before, and are averaged by tokens. What a part holds
and its order depend on the rows alone, so neither the cores nor the files change the weights. Texts are tokenised once;
the rounds and the scoring read units of two bytes.

Counts of the HEAD most frequent words are broadcast (a bounded table); rarer words of each text meet their counts in a
shuffle join, whose keys are each rarer than one in HEAD tokens, so none is hot. Words above LONG_WORD bytes are counted
by a digest, in the head as elsewhere.

Defined results: a null text is empty and has its end token only; repeated rows are scored each; null doc_id counts as
training text; without any training text every word is unknown and the network is untrained. No score is above zero.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from hashlib import sha256
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, map_texts, space_words, stored, text_slices

SHORT, CLASSES, HEAD = 1023, 64, 65_536
#: Groups of the softmax, and units of each: SHORT words, the end, and the classes.
SIDE = 33
HIDDEN, WINDOW, RATE = 16, 16, 6e-3
#: Texts learnt from at once in a part: more lanes make faster, fewer make more updates; at least UPDATES are aimed at.
LANES, UPDATES = 512, 128
#: Rounds of averaging; tokens of a part (more where PARTS would be exceeded) and of what is held in memory of it at once.
ROUNDS, PART_TOKENS, PARTS, SEGMENT = 4, 1 << 20, 4096, 1 << 20
#: Words above so many bytes are counted by their SHA-256.
LONG_WORD = 40
COUNTER = 200_000


def word_key(word: bytes) -> bytes:
    """What a word is counted by: itself, or a digest that no word can equal (it begins with a space)."""
    return word if len(word) <= LONG_WORD else b" " + sha256(word).digest()


def word_class(word: bytes, classes: int = CLASSES) -> int:
    return zlib.crc32(word[:2] + word[-2:]) % classes


WORDS = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("class", T.IntegerType()), T.StructField("c", T.LongType())])


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word key, class, c) over all rows; each task sums up before the shuffle."""
    schema = pa.schema([("word", pa.binary()), ("class", pa.int32()), ("c", pa.int64())])

    def rows(counts):
        words = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(map(word_key, words), pa.binary()), pa.array(map(word_class, words), pa.int32()), pa.array(counts.values(), pa.int64())],
            schema=schema,
        )

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for _, texts in text_slices(batch, text):
                for t in texts:
                    if t:
                        counts.update(space_words(t))
                if len(counts) > COUNTER:
                    yield rows(counts)
                    counts = Counter()
        if counts:
            yield rows(counts)

    return texts.select(text).mapInArrow(run, WORDS).groupBy("word", "class").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The head of the counts, and what is known of the rest: all of bounded size."""

    def __init__(self, head: list[tuple[bytes, int, int]], classes: list[tuple[int, int, int]], n_texts: int):
        """head: (word, class, c) by falling count; classes: (class, sum of c, words) over all words."""
        self.n = sum(s for _, s, _ in classes) + n_texts
        self.types = sum(v for *_, v in classes) + (n_texts > 0)
        self.end_count = n_texts
        self.index: dict[bytes, int] = {w: i for i, (w, _, _) in enumerate(head)}
        short = min(SHORT, len(head))
        self.short = short
        self.logc = np.log10(np.array([c for *_, c in head], float) + 0.5) if head else np.zeros(0)
        mass = np.full(CLASSES, 0.5)
        for k, s, v in classes:
            mass[k] += s + 0.5 * v
        for _, k, c in head[:short]:
            mass[k] -= c + 0.5
        self.log_mass = np.log10(np.maximum(mass, 0.5))
        # Units of the network: 0..short-1 words, SHORT the end, SHORT + 1 + k class k.
        self.unit = np.array([i if i < short else SHORT + 1 + k for i, (_, k, _) in enumerate(head)], np.int32)
        self.log_all = np.log10(self.n + 0.5 * (self.types + 1))

    def tokens(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Units of the text with its end, head index of each of its head words, and its words outside the head."""
        words = space_words(text) if text else []
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))
        units = np.empty(len(words) + 1, np.int32)
        units[-1] = SHORT
        misses = np.flatnonzero(at < 0).tolist()
        for i in misses:
            if len(words[i]) > LONG_WORD:
                at[i] = self.index.get(word_key(words[i]), -1)
        known = at >= 0
        if len(words):
            units[:-1] = self.unit[at] if len(self.unit) else 0
        rest = [words[i] for i in misses if at[i] < 0]
        if rest:
            units[:-1][~known] = [SHORT + 1 + word_class(w) for w in rest]
        return units, at[known], rest


UNITS = SIDE * SIDE


class Network:
    """A gated recurrent layer with a class-factored softmax. Unit u is number u // SIDE of group u % SIDE."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        self.p = {
            "x": f(UNITS, 3 * HIDDEN),
            "u": f(HIDDEN, 3 * HIDDEN),
            "c": f(HIDDEN, SIDE),
            "cb": np.zeros(SIDE, np.float32),
            "w": f(SIDE, SIDE, HIDDEN),
            "wb": np.zeros((SIDE, SIDE), np.float32),
        }
        # The first group lacks the units that do not exist.
        for u in range(SHORT + 1 + CLASSES, UNITS):
            self.p["wb"][u % SIDE, u // SIDE] = -np.inf
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def step(self, x: np.ndarray, h: np.ndarray):
        a, g = self.p["x"][x], h @ self.p["u"]
        zr = 1 / (1 + np.exp(-(a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])))
        z, r, gn = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN :]
        n = np.tanh(a[:, 2 * HIDDEN :] + r * gn)
        return n + z * (h - n), z, r, n, gn

    def _bounds(self) -> tuple[bool, np.ndarray]:
        """Whether the logits of the groups, and of the units in each, are too small to overflow: no state is above one."""
        size = lambda w, b, axis: np.abs(w).sum(axis).max(-1) + np.abs(np.where(np.isfinite(b), b, 0)).max(-1)
        return bool(size(self.p["c"], self.p["cb"], 0) < 80), size(self.p["w"], self.p["wb"], 2) < 80

    @staticmethod
    def _softmax(logits: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """logits (less their greatest if that could overflow), their exponentials and the sums of those."""
        if not safe:
            logits -= logits.max(1, keepdims=True)
        e = np.exp(logits)
        return logits, e, e @ np.ones(e.shape[1], e.dtype)

    def loss(self, hs: np.ndarray, units: np.ndarray, grads: dict | None = None):
        """Natural log-probability of each unit after state hs; with grads: adds to them and gives d(loss)/d(hs)."""
        order = np.argsort(units % SIDE, kind="stable")
        hs, units = hs[order], units[order]
        first, inner = units % SIDE, units // SIDE
        safe, inside = self._bounds() if np.abs(hs).max(initial=0) <= 1 else (False, np.zeros(SIDE, bool))
        rows = np.arange(len(units))
        logits, e, total = self._softmax(hs @ self.p["c"] + self.p["cb"], safe)
        lp = logits[rows, first] - np.log(total)
        if grads is not None:
            e /= total[:, None]
            e[rows, first] -= 1
            grads["c"] += hs.T @ e
            grads["cb"] += e.sum(0)
            dh = e @ self.p["c"].T
        edges = np.searchsorted(first, np.arange(SIDE + 1)).tolist()
        for g, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if a == b:
                continue
            h, t, i = hs[a:b], inner[a:b], rows[: b - a]
            s, e, total = self._softmax(h @ self.p["w"][g].T + self.p["wb"][g], inside[g])
            lp[a:b] += s[i, t] - np.log(total)
            if grads is not None:
                e /= total[:, None]
                e[i, t] -= 1
                grads["w"][g] += e.T @ h
                grads["wb"][g] += e.sum(0)
                dh[a:b] += e @ self.p["w"][g]
        out = np.empty_like(lp)
        out[order] = lp
        if grads is None:
            return out
        back = np.empty_like(dh)
        back[order] = dh
        return out, back

    def train(self, stream: np.ndarray, before: np.ndarray) -> None:
        """Truncated backpropagation over stream (steps x lanes; -1: nothing), begun after `before`; a text begins after each end."""
        lanes = stream.shape[1]
        h, prev = np.zeros((lanes, HIDDEN), np.float32), before.astype(np.int64)
        for a in range(0, len(stream), WINDOW):
            window = stream[a : a + WINDOW].astype(np.int64)
            kept, xs, hs = [], [], []
            for units in window:
                go = (prev != SHORT)[:, None].astype(np.float32)
                h0 = h * go
                h, *rest = self.step(prev, h0)
                kept.append((h0, go, *rest))
                xs.append(prev)
                hs.append(h)
                prev = np.where(units < 0, SHORT, units)
            grads = {k: np.zeros_like(v) for k, v in self.p.items()}
            hs, targets = np.concatenate(hs), window.ravel()
            some = np.flatnonzero(targets >= 0)
            dhs = np.zeros_like(hs)
            dhs[some] = self.loss(hs[some], targets[some], grads)[1]
            dhs = dhs.reshape(len(window), lanes, HIDDEN)
            dh, dx, dgs = np.zeros((lanes, HIDDEN), np.float32), [], []
            for t in range(len(window) - 1, -1, -1):
                h0, go, z, r, n, gn = kept[t]
                d = dh + dhs[t]
                dz = d * (h0 - n) * z * (1 - z)
                dn = d * (1 - z) * (1 - n * n)
                dr = dn * gn * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], 1)
                dx.append(np.concatenate([dz, dr, dn], 1))
                dgs.append(dg)
                dh = (d * z + dg @ self.p["u"].T) * go
            grads["u"] = np.concatenate([k[0] for k in kept[::-1]]).T @ np.concatenate(dgs)
            at = np.concatenate(xs[::-1])
            order = np.argsort(at, kind="stable")
            at = at[order]
            starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            grads["x"][at[starts]] = np.add.reduceat(np.concatenate(dx)[order], starts, axis=0)
            self._update(grads, max(1, len(some)))

    def _update(self, grads: dict, size: int) -> None:
        self.t += 1
        fix = np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g /= size
            np.clip(g, -1, 1, out=g)
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.p[k] -= RATE * fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)

    def score(self, texts: list[np.ndarray], lanes: int = 512) -> np.ndarray:
        """Log10 probability of each whole text of units; texts of like length go in step, the state is carried on."""
        out = np.zeros(len(texts))
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        for a in range(0, len(order), lanes):
            own = order[a : a + lanes]
            sizes = np.array([len(texts[i]) for i in own])
            flat = np.concatenate([texts[i] for i in own])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            h, prev = np.zeros((len(own), HIDDEN), np.float32), np.full(len(own), SHORT)
            sums = np.zeros(len(own))
            hs, units, at, held = [], [], [], 0
            active = np.searchsorted(-sizes, -np.arange(sizes[0]) - 0.5)
            for t, n in enumerate(active.tolist()):
                h = self.step(prev[:n], h[:n])[0]
                prev = flat[starts[:n] + t]
                hs.append(h)
                units.append(prev)
                at.append(n)
                held += n
                if held >= 8192 or t == len(active) - 1:
                    lp = self.loss(np.concatenate(hs), np.concatenate(units))
                    sums += np.bincount(np.concatenate([np.arange(n) for n in at]), lp, len(own))
                    hs, units, at, held = [], [], [], 0
            out[own] = sums
        return out / np.log(10)


def lanes_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of the texts in lanes of equal length (-1 after the last), and the unit before each lane."""
    flat = np.concatenate(texts)
    lanes = int(np.clip(len(flat) // (WINDOW * UPDATES), 8, LANES))
    steps = -(-len(flat) // lanes)
    whole = np.full(lanes * steps, -1, np.int16)
    whole[: len(flat)] = flat
    whole = whole.reshape(lanes, steps)
    before = np.concatenate(([SHORT], whole[:-1, -1]))
    return np.ascontiguousarray(whole.T), np.where(before < 0, SHORT, before)


WEIGHTS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("weights", T.BinaryType()), T.StructField("tokens", T.LongType())])


def training_parts(tokens: int, rounds: int = ROUNDS) -> int:
    """How many parts a round of so many tokens in all is dealt into: by the data alone."""
    return min(PARTS, max(1, -(-tokens // (rounds * PART_TOKENS))))


def fit_network(units: DataFrame, tokens: int, rounds: int = ROUNDS) -> Network:
    """A network that has learnt from every row of units (hash, units) once; tokens: how many they hold.

    Averages are made in at most eight tasks that hold one sum each; so much reaches the driver.
    """
    sc = units.sparkSession.sparkContext
    network = Network()
    parts = training_parts(tokens, rounds)
    schema = pa.schema([("part", pa.int32()), ("weights", pa.binary()), ("tokens", pa.int64())])

    def row(part, p, n):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(p)], pa.binary()), pa.array([n], pa.int64())], schema=schema)

    def weighted(rows):
        total, sums = 0, None
        for weights, n in rows:
            sums = {k: v * np.float64(n) + (sums[k] if sums else 0) for k, v in pickle.loads(weights).items()}
            total += n
        return None if not total else ({k: (v / total).astype(np.float32) for k, v in sums.items()}, total)

    for i in range(rounds):
        shared = sc.broadcast(network.p)

        def train(batches, shared=shared):
            own, n, part, held, texts = None, 0, None, 0, []

            def learn():
                if texts:
                    own.train(*lanes_of(texts))

            for batch in batches:
                for p, u in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                    if p != part:
                        if part is not None:
                            learn()
                            yield row(part, own.p, n)
                        own, n, part, held, texts = Network(), 0, p, 0, []
                        own.p = {k: v.copy() for k, v in shared.value.items()}
                    u = np.frombuffer(u, np.int16)
                    texts.append(u)
                    held += len(u)
                    n += len(u)
                    if held >= SEGMENT:
                        learn()
                        held, texts = 0, []
            if part is not None:
                learn()
                yield row(part, own.p, n)

        def average(batches):
            made = weighted((w, n) for b in batches for w, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
            if made:
                yield row(0, *made)

        # Rows alike in key and text are numbered, so that many of them are no hot part.
        mine = units.filter(F.pmod("hash", F.lit(rounds)) == i).groupBy("hash", "units").agg(F.count(F.lit(1)).alias("n"))
        mine = mine.select("hash", "units", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth"))
        mine = mine.select(F.pmod(F.xxhash64("hash", "nth"), F.lit(parts)).cast("int").alias("part"), "hash", "units")
        mine = mine.repartition(parts, "part").sortWithinPartitions("part", "hash", "units")
        weights = mine.mapInArrow(train, WEIGHTS).repartition(8, F.col("part") % 8).sortWithinPartitions("part")
        rows = sorted((r.weights, r.tokens) for r in weights.mapInArrow(average, WEIGHTS).collect())
        made = weighted(rows)
        if made:
            network.p = made[0]
    return network


def fit_vocabulary(counts: DataFrame, n_texts: int) -> Vocabulary:
    head = counts.orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    head = list(zip(head.column("word").to_pylist(), head.column("class").to_pylist(), head.column("c").to_pylist()))
    classes = [tuple(r) for r in counts.groupBy("class").agg(F.sum("c"), F.count(F.lit(1))).toLocalIterator()]
    return Vocabulary(head, classes, n_texts)


TOKENISED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_head", T.LongType()),
        T.StructField("head_log", T.DoubleType()),
        T.StructField("class_log", T.DoubleType()),
        T.StructField("units", T.BinaryType()),
        T.StructField("rest", T.ArrayType(T.BinaryType())),
    ]
)
MODEL = T.StructType([T.StructField("model_log", T.DoubleType())])


def tokenised(docs: DataFrame, words, text: str, keep: list[str]) -> DataFrame:
    """docs with the units of each text, what its head words score in the base and in their classes, and its other words."""

    def make():
        vocabulary = words.value

        def f(texts, _):
            units, at, rest = zip(*(vocabulary.tokens(t) for t in texts))
            end = np.log10(vocabulary.end_count + 0.5)
            mass = np.concatenate((np.zeros(SHORT + 1), vocabulary.log_mass))
            head = [float(vocabulary.logc[x].sum()) + end for x in at]
            inner = [float(vocabulary.logc[x[x >= vocabulary.short]].sum()) - float(mass[u].sum()) for x, u in zip(at, units)]
            known = [len(x) + (vocabulary.end_count > 0) for x in at]
            return [[len(u) for u in units], known, head, inner, [u.astype(np.int16).tobytes() for u in units], [[w if len(w) <= LONG_WORD else word_key(w) for w in r] for r in rest]]

        return f

    return map_texts(docs, text, TOKENISED, make, keep=keep)


def score_texts(docs: DataFrame, training, text: str = "text", keep: list[str] | None = None, key: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score, learnt from the rows where `training` holds.

    key: columns that tell rows of equal text apart. Columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    trained = docs.filter(training)
    counts = stored(word_counts(trained, text), "words")
    vocabulary = fit_vocabulary(counts, trained.count())
    words = spark.sparkContext.broadcast(vocabulary)

    names = ["n_known", "train_tokens", "base_score", "score", *(f.name for f in TOKENISED)]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    taken = set(docs.columns) | set(names)
    own, learn, hashed = (next(x for x in (n + "_" * i for i in range(len(taken) + 1)) if x not in taken) for n in ("__row", "__learn", "__hash"))
    rows = docs.withColumn(learn, F.coalesce(training, F.lit(False))).withColumn(hashed, F.xxhash64(*key, text))
    rows = tokenised(rows, words, text, [*kept, learn, hashed]).withColumn(own, F.monotonically_increasing_id())
    rows = stored(rows, "tokenised")

    network = fit_network(rows.filter(F.col(learn)).select(F.col(hashed).alias("hash"), "units"), vocabulary.n)
    shared = spark.sparkContext.broadcast(network)

    def make():
        net = shared.value
        return lambda units, _: [net.score([np.frombuffer(u, np.int16) for u in units])]

    new = ["n_tokens", "n_head", "head_log", "class_log"]
    scored = map_texts(rows, "units", MODEL, make, keep=[*kept, *new, own], limit=8 << 20)
    rest = rows.select(own, F.explode("rest").alias("word")).join(counts.select("word", "c"), "word", "left")
    rest = rest.groupBy(own).agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("__log"), F.count("c").alias("__known")
    )
    out = scored.join(rest, own, "left")
    rest_log = F.coalesce("__log", F.lit(0.0))
    return out.select(
        *[F.col(f"`{c}`") for c in kept],
        "n_tokens",
        (F.col("n_head") + F.coalesce("__known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("head_log") + rest_log - F.col("n_tokens") * F.lit(float(vocabulary.log_all))).alias("base_score"),
        (F.col("model_log") + F.col("class_log") + rest_log).alias("score"),
    )


def score_documents(docs: DataFrame, fold: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    held_out = F.coalesce(crc_mod("doc_id", fold) == held, F.lit(False))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return score_texts(rows, ~F.col("held_out"), keep=["doc_id", "held_out"], key=("doc_id",))
