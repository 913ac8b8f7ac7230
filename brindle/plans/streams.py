"""Queries whose rows come as a stream: a table replayed in the order of arrival, or out of order.

A far later row at the end lets the watermark pass all others, so the table
that the stream wrote is whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.temporal import micros
from brindle.streaming import lists, matching, register, windows
from brindle.streaming.ordered import groups_of
from brindle.streaming.replay import replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Parts of a replay, and how late clicks may arrive.
PARTS, LATE = 4, "4 days"
FAR = "2100-01-01"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parted(rows: DataFrame, at: Column, parts: int = PARTS) -> Column:
    """Number of a row's part, from 1 on, when the span of ``at`` (a number) is cut into equal parts."""
    low, high = rows.agg(F.min(at), F.max(at)).first()
    if low is None:
        return F.lit(1)
    return F.coalesce(F.least(F.lit(parts), F.floor((at - low) / F.lit((high - low) // parts + 1)) + 1), F.lit(1)).cast("int")


def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with a client and a time, as they arrive."""
    rows = _read(spark, sf_dir, "clicks").where("client_id IS NOT NULL AND ts IS NOT NULL")
    return rows.select("click_id", "client_id", "kind", "value", F.col("ts").cast("timestamp").alias("ts"), "arrived_at")


def _last(spark: SparkSession, kinds: tuple[str | None, ...] = (None,)) -> DataFrame:
    """Far later rows. They have a client, which no other row has: a join leaves out null keys before their time is seen."""
    rows = [(k,) for k in kinds]
    kind = spark.createDataFrame(rows, "kind string")
    return kind.select(
        F.lit(None).cast("long").alias("click_id"), F.lit(-(1 << 63)).alias("client_id"), "kind", F.lit(None).cast("double").alias("value"),
        F.lit(FAR).cast("timestamp").alias("ts"), F.lit(None).cast("timestamp_ntz").alias("arrived_at"),
    )


_SESSIONS = """
WITH c AS (SELECT client_id, ts, CAST(floor(value * 100 + 0.5::DOUBLE) AS BIGINT) AS cents FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
m AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY client_id ORDER BY ts) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS begins FROM c),
s AS (SELECT *, sum(begins) OVER (PARTITION BY client_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS number FROM m)
SELECT client_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM s GROUP BY client_id, number"""
_GAP = 6 * 3_600_000_000


def _cents(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cents", F.floor(F.col("value") * 100 + 0.5).cast("long"))


def _plain(rows: DataFrame) -> DataFrame:
    """Times without a zone, as in the tables."""
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in rows.dtypes if t == "timestamp"})


@query(_SESSIONS)
def click_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each client's clicks, six hours apart."""
    return _plain(windows.sessions(_cents(_clicks(spark, sf_dir)), ["client_id"], "ts", _GAP, {"cents": "cents"}))


@query(_SESSIONS)
def click_sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream in which clicks come up to days late."""
    rows = _clicks(spark, sf_dir)
    build = lambda read: windows.session_stream(_cents(read()), ["client_id"], "ts", _GAP, LATE, {"cents": "cents"})
    return _plain(replay(rows, parted(rows, micros(F.col("arrived_at"))), PARTS, build, _last(spark)).table)


@query("""
WITH c AS (SELECT kind, epoch_us(ts) AS us FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
w AS (SELECT kind, us // 21600000000 - i AS slot FROM c, (SELECT unnest([0, 1, 2, 3]) AS i))
SELECT kind, make_timestamp(slot * 21600000000) AS start, make_timestamp((slot + 4) * 21600000000) AS "end", count(*) AS n FROM w GROUP BY kind, slot""")
def clicks_by_day_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of each kind in windows of a day that begin every six hours, from a stream."""
    rows = _clicks(spark, sf_dir)
    build = lambda read: windows.sliding(read(), ["kind"], "ts", "1 day", "6 hours", LATE, n=F.count("*"))
    return _plain(replay(rows, parted(rows, micros(F.col("arrived_at"))), PARTS, build, _last(spark)).table)


@query("""
WITH c AS (SELECT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL)
SELECT v.click_id, v.ts, p.click_id AS then_click_id FROM c v LEFT JOIN c p ON p.kind = 'purchase' AND p.client_id = v.client_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 2 HOURS
WHERE v.kind = 'view'""")
def view_to_purchase_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view with the purchases of its client in the two hours after it, from two streams."""
    rows = _clicks(spark, sf_dir).where("kind IN ('view', 'purchase')")
    build = lambda read: matching.followed(read().where("kind = 'view'"), read().where("kind = 'purchase'"), ["client_id"], "ts", "2 HOURS", LATE, ["click_id"])
    out = replay(rows, parted(rows, micros(F.col("arrived_at"))), PARTS, build, _last(spark, ("view", "purchase"))).table
    return _plain(out.where("click_id IS NOT NULL").select("click_id", "ts", "then_click_id"))


def _shuffled(events: DataFrame) -> tuple[DataFrame, Column]:
    """Events with owner, ms and seq, arriving up to two days late by a hash of their number."""
    rows = events.select(F.col("user_id").alias("owner"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("seq"), "event_type", "value")
    return rows, F.col("ms") + F.pmod(F.xxhash64("seq"), F.lit(2 * 86_400_000))


def _end(rows: DataFrame) -> DataFrame:
    """One far later row without an owner."""
    far = {"ms": F.unix_millis(F.lit(FAR).cast("timestamp")), "seq": F.lit(-1)}
    return rows.sparkSession.range(1).select(*[far.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])


@query("""
WITH e AS (SELECT user_id, event_id, event_type, epoch_ms(ts) AS ms,
  lag(event_type) OVER w AS was, lag(epoch_ms(ts)) OVER w AS before, lag(value) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id))
SELECT user_id, event_id, CASE WHEN was = 'error' AND ms - before <= 50000000 THEN v END AS got FROM e WHERE event_type <> 'error'""")
def ttl_register_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F01 as a stream: events that arrive out of order give the reads of the table."""
    rows, arrival = _shuffled(_read(spark, sf_dir, "events").where("event_type IS NOT NULL"))
    rows = rows.select("owner", "ms", "seq", (F.col("event_type") == "error").alias("is_write"), F.col("value").cast("string").alias("value"))
    groups = groups_of(rows)
    out = replay(rows, parted(rows, arrival), PARTS, lambda read: register.reads(read(), 50_000_000, "3 days", groups), _end(rows)).table
    return out.where("seq >= 0").select(F.col("owner").alias("user_id"), F.col("seq").alias("event_id"), F.col("got").cast("double").alias("got"))


@query("""
WITH e AS (
  SELECT user_id, (epoch_ms(ts), event_id) AS tick, CAST(floor(value) % 7 AS BIGINT) AS item,
         CASE event_type WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'clear' ELSE 'add' END AS act FROM events
), c AS (SELECT *, max(CASE WHEN act = 'clear' THEN tick END) OVER (PARTITION BY user_id) AS cleared FROM e),
a AS (SELECT * FROM c WHERE cleared IS NULL OR tick > cleared),
g AS (SELECT *, max(CASE WHEN act = 'remove' THEN tick END) OVER (PARTITION BY user_id, item) AS gone FROM a),
f AS (SELECT user_id, item, min(tick) AS first FROM g WHERE act = 'add' AND (gone IS NULL OR tick > gone) GROUP BY user_id, item)
SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY first) AS position FROM f""")
def cart_replay_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F05, E13 as a stream."""
    rows, arrival = _shuffled(_read(spark, sf_dir, "events"))
    act = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "clear").otherwise("add")
    rows = rows.select("owner", "ms", "seq", act.alias("act"), (F.floor("value") % 7).cast("long").cast("string").alias("item"))
    groups = groups_of(rows)
    out = replay(rows, parted(rows, arrival), PARTS, lambda read: lists.lists(read(), "3 days", groups), _end(rows)).table
    return lists.latest(out.where("seq >= 0")).select(F.col("owner").alias("user_id"), F.col("item").cast("long").alias("item"), "position")
