"""Sharding by fixed virtual slots.

Records are hashed into SLOTS virtual slots, whose rows and bytes are summed; a versioned map sends slots to shards.
Version 0 deals slots out in turn. Rebalancing edits the map: slots move from shards above the mean to those below until
no move or swap brings the heaviest and the lightest shard closer. The law that holds is `bytes`: shards have nearly equal
bytes. The map is stored with all its versions, so any version's placement can be had again.

A slot far above the mean (a record repeated very often) is cut into parts by a hash of its rows' numbers, so that neither
a shard nor a task gets it whole. Within a shard rows are numbered without gaps: each slot part starts where the part
before ends (from the bounded table of parts), and numbers its own rows.

Defined results: a null text has 0 bytes (size 16) and the CRC-32 of no bytes; null doc_ids are hashed by text; repeated
rows are all placed; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, stored

SLOTS, SHARDS, OVERHEAD = 8192, 40, 16
#: Parts that one slot may be cut into: more than any shard can need.
MOST_PARTS = 4096


@dataclass
class SlotMap:
    """Slot parts, their bytes, and their shard in each version."""

    keys: list[tuple[int, int]]
    weights: np.ndarray
    versions: list[np.ndarray] = field(default_factory=list)
    shards: int = SHARDS

    @classmethod
    def initial(cls, parts: list[tuple[int, int, int]], shards: int = SHARDS) -> SlotMap:
        """parts: (slot, part, bytes)."""
        parts = sorted(parts)
        keys = [p[:2] for p in parts]
        out = cls(keys, np.array([p[2] for p in parts], np.int64), shards=shards)
        out.versions.append(np.array([(s + p) % shards for s, p in keys], np.int64))
        return out

    def loads(self, version: int = -1) -> np.ndarray:
        return np.bincount(self.versions[version], self.weights, self.shards)[: self.shards].astype(np.int64) if self.keys else np.zeros(self.shards, np.int64)

    def rebalance(self) -> SlotMap:
        """Add a version in which shards have nearly equal bytes, moving few slots."""
        of, w = self.versions[-1].copy(), self.weights
        loads = self.loads()
        mean = loads.sum() / self.shards
        loose: list[int] = []
        for s in np.flatnonzero(loads > mean):
            own = np.flatnonzero(of == s)
            for i in own[np.argsort(-w[own], kind="stable")]:
                if w[i] and loads[s] - w[i] >= mean:
                    loads[s] -= w[i]
                    loose.append(int(i))
        for i in sorted(loose, key=lambda i: (-w[i], i)):
            s = int(loads.argmin())
            of[i] = s
            loads[s] += w[i]
        for _ in range(8 * self.shards * 8):
            if not self._improve(of, loads):
                break
        self.versions.append(of)
        return self

    def _improve(self, of: np.ndarray, loads: np.ndarray) -> bool:
        """One move or swap between the heaviest shard and one of the lightest that lessens their difference."""
        high = int(loads.argmax())
        a = np.flatnonzero(of == high)
        for low in np.argsort(loads, kind="stable")[:3].tolist():
            gap = loads[high] - loads[low]
            if gap < 2:
                return False
            b = np.flatnonzero(of == low)
            gain = self.weights[a][:, None] - np.concatenate(([0], self.weights[b]))[None, :]
            left = np.abs(gap - 2 * gain)
            i, j = np.unravel_index(left.argmin(), left.shape) if left.size else (0, 0)
            if left.size and left[i, j] < gap:
                of[a[i]] = low
                if j:
                    of[b[j - 1]] = high
                loads[high] -= gain[i, j]
                loads[low] += gain[i, j]
                return True
        return False

    def grow(self) -> SlotMap:
        """Add a version with one shard more, which takes slots from the others until it holds its share."""
        of = self.versions[-1].copy()
        loads = np.append(self.loads(), 0)
        share = loads.sum() / (self.shards + 1)
        new = self.shards
        for i in np.argsort(-self.weights, kind="stable"):
            s = of[i]
            if loads[s] - self.weights[i] >= share and loads[new] + self.weights[i] <= share:
                of[i] = new
                loads[s] -= self.weights[i]
                loads[new] += self.weights[i]
        self.shards += 1
        self.versions.append(of)
        return self

    def table(self, spark: SparkSession) -> DataFrame:
        """(version, slot, part, shard, bytes); at most SLOTS * MOST_PARTS rows a version, in practice SLOTS."""
        rows = [(v, *k, int(s), int(w)) for v, of in enumerate(self.versions) for k, s, w in zip(self.keys, of, self.weights)]
        return spark.createDataFrame(rows, "version int, slot int, part int, shard int, bytes long")

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SlotMap:
        rows = sorted(tuple(r) for r in spark.read.parquet(path).select("version", "slot", "part", "shard", "bytes").toLocalIterator())
        first = [r for r in rows if r[0] == 0]
        out = cls([r[1:3] for r in first], np.array([r[4] for r in first], np.int64))
        for v in range(rows[-1][0] + 1 if rows else 0):
            out.versions.append(np.array([r[3] for r in rows if r[0] == v], np.int64))
        out.shards = max([SHARDS, *(int(x.max()) + 1 for x in out.versions if len(x))])
        return out


def slotted(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """(key, size, text_crc32, vslot, part): the virtual slot of each row, and its part of a slot that is cut."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    crc = F.crc32(raw)
    slot = F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(crc, F.octet_length(raw)))
    rows = docs.select(
        F.col(key), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), crc.cast("long").alias("text_crc32"), F.pmod(slot, F.lit(slots)).cast("int").alias("vslot")
    )
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "slotted")
    sums = {r[0]: r[1:] for r in rows.groupBy("vslot").agg(F.count(F.lit(1)), F.sum("size")).toLocalIterator()}
    n, size = (sum(x) for x in zip(*sums.values())) if sums else (0, 0)
    hot = []
    for s, (rows_here, bytes_here) in sums.items():
        times = max(rows_here / max(1, n), bytes_here / max(1, size)) * shards * 8
        if rows_here > 1 and times > 1:
            hot.append((s, min(MOST_PARTS, rows_here, 1 + int(times))))
    if not hot:
        return rows.withColumn("part", F.lit(0))
    parts = F.broadcast(rows.sparkSession.createDataFrame(hot, "vslot int, parts int"))  # at most `slots` rows
    return rows.join(parts, "vslot", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("__row"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard, from 0), grown_shard (null), virtual_slot."""
    spark = docs.sparkSession
    rows = slotted(docs, slots=slots, shards=shards)
    sums = [tuple(r) for r in rows.groupBy("vslot", "part").agg(F.sum("size"), F.count(F.lit(1))).toLocalIterator()]
    slot_map = SlotMap.initial([r[:3] for r in sums], shards).rebalance()
    path = new_path(spark, "slot-map")
    slot_map.save(spark, path)
    counts = {r[:2]: r[3] for r in sums}
    starts, filled = [], [0] * shards
    for k, s in zip(slot_map.keys, slot_map.versions[-1].tolist()):
        starts.append((*k, s, filled[s]))
        filled[s] += counts[k]
    placed = F.broadcast(spark.createDataFrame(starts, "vslot int, part int, shard int, start long"))  # the map's rows
    place = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "__row")) - 1
    return rows.withColumn("place", place).join(placed, ["vslot", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
    )
