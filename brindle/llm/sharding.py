"""Sharding by rendezvous hashing over weighted shards, and gapless slots.

Each shard draws an exponential waiting time from the hash of (record key,
shard number), divided by its weight; the record goes to the shard with the
least. One more shard changes no other draw, so it only takes rows into itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import EXPAND, text_or_empty

SHARDS = 40
#: Ranges of hash within each shard that are numbered independently of each other: at least so many, and more if they would hold more rows than that.
RANGES, RANGE_ROWS = 256, 100_000
OVERHEAD = 16


def _draw(key: Column, shard: Column, weight: Column) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(unit) / weight


def placed(key: Column, weights: Sequence[float]) -> Column:
    """The least (draw, shard) for a key."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    number = F.sequence(F.lit(0), F.lit(len(weights) - 1))
    if len(set(weights)) == 1:
        weight = lambda s: F.lit(float(weights[0]))
    else:
        table = F.split(F.lit(",".join(map(repr, map(float, weights)))), ",").cast("array<double>")
        weight = lambda s: F.get(table, s)
    return F.array_min(F.transform(number, lambda s: F.struct(_draw(key, s, weight(s)).alias("draw"), s.alias("shard"))))


def shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, added: float | None = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard: one row per row of ``docs``.

    size is the text's UTF-8 bytes plus 16, slot numbers a shard's rows from 0
    without gaps, grown_shard is the shard with one more of weight ``added``.

    Defined results: a null text counts as empty; a null doc_id is a key of its
    own, so such rows share a shard; rows equal in id, size and checksum get
    neighbouring slots; an empty table gives an empty result.

    The slots come from two aggregates instead of one sort per shard: rows are
    numbered within a shard's hash range, and each range starts after the rows
    of those before it. The table of starts has shards x ranges rows, a row for
    every RANGE_ROWS rows of a large table, and is broadcast. Equal rows are
    counted before they are shuffled; what stands for more than EXPAND of them
    goes on in parts, which fall into ranges of their own.
    """
    raw = text_or_empty("text")
    ranges = max(RANGES, -(-docs.count() // (RANGE_ROWS * len(weights))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    rows = rows.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(EXPAND).cast("long"))))
    rows = rows.withColumn("n", F.least(F.lit(EXPAND).cast("long"), F.col("n") - F.col("first")))
    best = placed(F.col("doc_id"), weights)
    rows = rows.withColumn("best", best).withColumn("range", F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "text_crc32", "first"), F.lit(ranges)).cast("int"))
    grown = F.lit(None).cast("int")
    if added is not None:
        grown = F.when(_draw(F.col("doc_id"), F.lit(len(weights)), F.lit(float(added))) < F.col("best.draw"), F.lit(len(weights))).otherwise(F.col("best.shard"))
    rows = rows.select("doc_id", "size", "text_crc32", "first", "n", F.col("best.shard").alias("shard"), "range", grown.alias("grown_shard"))

    counted = rows.groupBy("shard", "range").agg(F.sum("n").alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("shard", "range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))

    before = Window.partitionBy("shard", "range").orderBy("doc_id", "text_crc32", "size", "first").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = rows.join(F.broadcast(starts), ["shard", "range"])
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("before") + F.col("copy")).alias("slot"), "grown_shard")


def digest(docs: DataFrame) -> DataFrame:
    out = shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
