"""Queries over time: the last row before, rows within an interval, sums over the last days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import temporal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
HOUR, DAY = 3_600_000_000, 86_400_000_000


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cents(column: str) -> Column:
    return F.floor(F.col(column) * 100 + 0.5).cast("long")


@query("""
WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL)
SELECT event_id, o_orderkey FROM events e ASOF LEFT JOIN o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""")
def asof_order_of_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its customer's last order before it."""
    orders = _read(spark, sf_dir, "orders").withColumn("user_id", F.col("o_custkey"))
    return temporal.asof(_read(spark, sf_dir, "events"), orders, ["user_id"], "ts", "o_orderdate", ["o_orderkey"], ["o_orderkey"]).select("event_id", "o_orderkey")


@query("""
WITH s AS (SELECT client_id, sold_at, max(sale_id) AS sale_id FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL GROUP BY ALL)
SELECT c.click_id, c.kind, CASE WHEN date_diff('microsecond', s.sold_at, c.ts) <= 7 * 86400000000 THEN s.sale_id END AS sale_id
FROM clicks c ASOF LEFT JOIN s ON c.client_id = s.client_id AND c.ts > s.sold_at""")
def asof_sale_of_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with its client's last sale of the seven days before it."""
    out = temporal.asof(_read(spark, sf_dir, "clicks"), _read(spark, sf_dir, "sales"), ["client_id"], "ts", "sold_at", ["sale_id"], ["sale_id"], before=True, within=7 * DAY)
    return out.select("click_id", "kind", "sale_id")


@query("""
WITH l AS (SELECT sale_id, max(shipped_at) AS shipped FROM sale_lines GROUP BY sale_id),
s AS (SELECT DISTINCT sale_id, client_id, sold_at FROM sales)
SELECT click_id, ts, sale_id, sold_at, shipped FROM s JOIN l USING (sale_id) JOIN clicks c ON c.client_id = s.client_id AND c.ts BETWEEN sold_at AND shipped""")
def clicks_in_fulfilment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client's clicks between a sale and its last shipment."""
    shipped = _read(spark, sf_dir, "sale_lines").groupBy("sale_id").agg(F.max("shipped_at").alias("shipped"))
    sales = _read(spark, sf_dir, "sales").select("sale_id", "client_id", "sold_at").distinct().join(shipped, "sale_id")
    clicks = _read(spark, sf_dir, "clicks").select("click_id", "client_id", "ts")
    return temporal.within_interval(clicks, sales, "ts", "sold_at", "shipped", ["client_id"]).select("click_id", "ts", "sale_id", "sold_at", "shipped")


@query("""
WITH v AS (SELECT client_id, min(ts) AS opened, max(ts) AS closed FROM clicks WHERE client_id IS NOT NULL GROUP BY client_id)
SELECT e.event_id, count(v.client_id) AS visitors FROM events e LEFT JOIN v ON e.ts BETWEEN v.opened AND v.closed GROUP BY e.event_id""")
def visitors_at_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many clients had begun and not ended their clicks when an event happened: intervals from none to months, no key."""
    visits = _read(spark, sf_dir, "clicks").where("client_id is not null").groupBy("client_id").agg(F.min("ts").alias("opened"), F.max("ts").alias("closed"))
    events = _read(spark, sf_dir, "events").select("event_id", "ts")
    return temporal.covered(events, visits, "ts", "opened", "closed", "visitors").groupBy("event_id").agg(F.sum("visitors").alias("visitors"))


_LAST_DAYS = "CAST(sum(CAST(floor({amount} * 100 + 0.5::DOUBLE) AS BIGINT)) OVER (PARTITION BY {key} ORDER BY {at} RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS BIGINT)"


@query(f"SELECT o_orderkey, {_LAST_DAYS.format(amount='o_totalprice', key='o_custkey', at='o_orderdate')} AS spent FROM orders")
def spend_last_7_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the customer of each order spent in the seven days up to it, in cents."""
    orders = _read(spark, sf_dir, "orders").withColumn("spent_now", cents("o_totalprice"))
    return temporal.rolling_sum(orders, ["o_custkey"], "o_orderdate", "spent_now", 7 * DAY, DAY, "spent").select("o_orderkey", "spent")


@query(f"SELECT sale_id, sold_at, CASE WHEN sold_at IS NOT NULL THEN coalesce({_LAST_DAYS.format(amount='total', key='client_id', at='sold_at')}, 0) END AS spent FROM sales")
def sales_last_7_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the shop's sales: rows repeated, clients null or with very many sales, totals null."""
    sales = _read(spark, sf_dir, "sales").withColumn("spent_now", cents("total"))
    return temporal.rolling_sum(sales, ["client_id"], "sold_at", "spent_now", 7 * DAY, 6 * HOUR, "spent").select("sale_id", "sold_at", "spent")
