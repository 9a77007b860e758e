"""Sharding through fixed virtual slots.

Records are hashed into ``SLOTS`` slots, for good. A versioned map says which shard
holds each slot; rebalancing edits the map, so only the slots it names move. Equal
texts share a slot, unless their group is larger than a shard's fair share: such a
group is spread over all slots by doc_id. There are fewer of those groups than
twice the shards, so their list is bounded. All work on rows is DataFrame
operations; the driver sees a row per slot.
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SLOTS = 4096
#: Part of a shard's fair share above which a group of equal texts is spread.
SPREAD_ABOVE = 0.9
#: Rows of a piece in which places are numbered; pieces of a slot grow in number, not in size.
PIECE_ROWS = 500


@dataclasses.dataclass(frozen=True)
class SlotMap:
    """Which shard holds each slot; every edit gives a new version."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def initial(cls, shards: int, slots: int = SLOTS) -> "SlotMap":
        return cls(1, shards, tuple(s % shards for s in range(slots)))

    def _edited(self, shard_of, shards=None) -> "SlotMap":
        return SlotMap(self.version + 1, shards or self.shards, tuple(int(s) for s in shard_of))

    def rebalanced(self, size: np.ndarray, tolerance: float = 1e-4) -> "SlotMap":
        """Moves slots from the heaviest to the lightest shard, each time the slot that
        comes nearest to half their difference, until the spread is within ``tolerance``
        of the mean or no move lessens it. Ties go to the lowest slot."""
        at, size = np.array(self.shard_of), np.asarray(size, np.float64)
        load = np.bincount(at, size, self.shards)
        for _ in range(20 * len(at)):
            heavy, light = int(load.argmax()), int(load.argmin())
            gap = load[heavy] - load[light]
            if gap <= tolerance * load.mean():
                break
            own = np.flatnonzero((at == heavy) & (size > 0) & (size < gap))
            if not len(own):
                break
            best = own[np.abs(size[own] - gap / 2).argmin()]
            at[best] = light
            load[heavy] -= size[best]
            load[light] += size[best]
        return self._edited(at)

    def grown(self, size: np.ndarray) -> "SlotMap":
        """One more shard, which takes its share of slots from the others; no slot moves between old shards."""
        at, size = np.array(self.shard_of), np.asarray(size, np.float64)
        load = np.bincount(at, size, self.shards + 1)
        fair = load.sum() / (self.shards + 1)
        for shard in range(self.shards):
            own = np.flatnonzero((at == shard) & (size > 0))
            for slot in own[np.argsort(-size[own], kind="stable")]:
                if load[shard] - size[slot] >= fair and load[self.shards] + size[slot] <= fair:
                    at[slot] = self.shards
                    load[shard] -= size[slot]
                    load[self.shards] += size[slot]
        return self._edited(at, self.shards + 1)


def save_map(spark: SparkSession, path: str, versions: list[SlotMap]) -> None:
    rows = [(m.version, m.shards, slot, shard) for m in versions for slot, shard in enumerate(m.shard_of)]
    spark.createDataFrame(rows, "version int, shards int, vslot int, shard int").coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("version") == version).select("vslot", "shard")


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version for each row.

    The law is ``bytes``: sizes of shards are near equal. ``slot`` is the row's place in
    its shard, gapless from 0, by virtual slot and doc_id (null ids first); ``vslot`` is
    the virtual slot. A null text has size 1 and the checksum of the empty text. Rows
    that repeat are placed one by one. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.lit(11)).alias("copies"),
    )
    rows = common.materialise(rows, "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = rows.groupBy("copies").agg(F.sum("size").alias("b")).filter(F.col("b") > F.lit(SPREAD_ABOVE * total / shards))
    spread = [r[0] for r in large.select("copies").collect()]  # fewer than shards / SPREAD_ABOVE
    own = F.xxhash64("doc_id", "copies")
    key = F.when(F.col("copies").isin(spread), own).otherwise(F.col("copies")) if spread else F.col("copies")
    rows = rows.withColumn("vslot", F.pmod(key, F.lit(slots)).cast("int"))

    used = rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()  # a row per slot
    size = np.zeros(slots)
    size[[r.vslot for r in used]] = [r.b for r in used]
    first = SlotMap.initial(shards, slots)
    second = first.rebalanced(size)
    path = common.new_path(spark, "slot-map")
    save_map(spark, path, [first, second])
    pieces = spark.createDataFrame([(r.vslot, -(-r.n // PIECE_ROWS)) for r in used], "vslot int, pieces int")
    placed = load_map(spark, path, second.version).join(F.broadcast(pieces), "vslot")  # a row per slot

    rows = rows.join(F.broadcast(placed), "vslot").withColumn("piece", F.pmod(F.xxhash64("doc_id", "size"), F.col("pieces")).cast("int")).drop("pieces")
    order = Window.partitionBy("vslot", "piece").orderBy(F.asc_nulls_first("doc_id"), "size", "text_crc32")
    rows = rows.withColumn("place", F.row_number().over(order) - 1)
    counts = rows.groupBy("vslot", "piece", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("vslot", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("vslot", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, ["vslot", "piece"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        F.lit(second.version).alias("map_version"),
    )
