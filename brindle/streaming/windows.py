"""Sessions and sliding windows by event time, as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.temporal import micros

SECOND = 1_000_000


def session_stream(rows: DataFrame, keys: Sequence[str], time: str, gap: int, late: str, sums: Mapping[str, str] | None = None) -> DataFrame:
    """Sessions of a stream: keys, start, end, n, and the sum of each column of ``sums`` under its name.

    A row belongs to the session of the rows less than ``gap`` microseconds (two
    at least) before or after it; a session ends that long after its last row, and is
    given out when the watermark, ``late`` behind the newest row, has passed its
    end. ``time`` is a timestamp with a zone. Rows before the watermark are
    dropped and counted (``Replay.dropped``), rows without a time as well.
    """
    # Spark merges sessions that touch, so that rows exactly the gap apart would be in one
    window = F.session_window(time, f"{gap - 1} microseconds")
    # no row that still counts comes at the watermark itself, where a session would end a microsecond early
    grouped = rows.withWatermark(time, f"{late} 1 millisecond").groupBy(window.alias("session"), *keys)
    out = grouped.agg(F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in (sums or {}).items()])
    return out.select(*keys, F.col("session.start").alias("start"), F.timestamp_add("MICROSECOND", F.lit(1), F.col("session.end")).alias("end"), "n", *(sums or {}))


def sessions(rows: DataFrame, keys: Sequence[str], time: str, gap: int, sums: Mapping[str, str] | None = None) -> DataFrame:
    """The same of a table.

    Rows in one bucket of ``gap`` are in one session, so they are put together
    before the shuffle, and only buckets are sorted: a key with very many rows
    has no more buckets than its time has gaps.
    """
    sums = sums or {}
    at = micros(F.col(time))
    buckets = rows.where(F.col(time).isNotNull()).groupBy(*keys, F.floor(at / F.lit(gap)).alias("bucket"))
    buckets = buckets.agg(F.min(time).alias("start"), F.max(time).alias("last"), F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in sums.items()])
    along = Window.partitionBy(*keys).orderBy("bucket")
    begins = micros(F.col("start")) - micros(F.lag("last").over(along)) >= gap
    buckets = buckets.withColumn("begins", F.coalesce(begins, F.lit(True)).cast("long"))
    buckets = buckets.withColumn("number", F.sum("begins").over(along))
    out = buckets.groupBy(*keys, "number").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in sums])
    return out.select(*keys, "start", F.timestamp_add("MICROSECOND", F.lit(gap), F.col("last")).alias("end"), "n", *sums)


def sliding(rows: DataFrame, keys: Sequence[str], time: str, width: str, slide: str, late: str | None = None, **of: Column) -> DataFrame:
    """Windows of ``width`` that begin every ``slide``: keys, start, end and the aggregates ``of``; of a stream when ``late`` is given."""
    if late:
        rows = rows.withWatermark(time, late)
    grouped = rows.groupBy(F.window(time, width, slide).alias("window"), *keys).agg(*[c.alias(n) for n, c in of.items()])
    return grouped.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), *of)
