"""Review and publication of rows, progress of shipments, and the short-lived error register."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.cart import marked

TTL_MS = 5000


def published(df: DataFrame, selected: DataFrame, key: str, flag: str = "published") -> DataFrame:
    """Sets the flag of selected rows, ready or not; other rows stay as they are."""
    hit = marked(df, selected, key, flag="_selected")
    return hit.withColumn(flag, F.when(F.col("_selected"), F.lit(True)).otherwise(F.col(flag))).drop("_selected")


def publication(done: Column, ready: Column) -> Column:
    true = lambda c: F.coalesce(c, F.lit(False))
    return F.when(true(done), "Published").when(true(ready), "Ready to Publish").otherwise("Needs Review")


def by_case(value: Column, cases: dict[str, str], other: str) -> Column:
    out = None
    for k, v in cases.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return F.lit(other) if out is None else out.otherwise(other)


def all_selected(df: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    hit = marked(df, selected, key, flag="_selected")
    n = F.count_if(F.col("_selected"))
    return hit.agg(n.alias("selected"), F.count("*").alias("total"), (n == F.count("*")).alias("all_selected"))


def milestones(df: DataFrame, names: Column, completed: Column, keep: Sequence[str]) -> DataFrame:
    """A row for each milestone: reached up to the completed one; its connector before it; none after the last."""
    out = df.select(*keep, completed.alias("_done"), F.size(names).alias("_n"), F.posexplode(names).alias("position", "milestone"))
    out = out.withColumn("reached", F.col("position") <= F.col("_done"))
    connector = F.when(F.col("position") < F.col("_n") - 1, F.col("position") < F.col("_done"))
    return out.withColumn("connected", connector).drop("_done", "_n")


def register_reads(log: DataFrame, owner: str, at_ms: Column, order: list[str], is_write: Column, value: str, ttl: int = TTL_MS) -> DataFrame:
    """What each read of a register returns: the write just before it, if not older than the time to live.

    A write replaces what is there and a read clears it, so only the event just
    before a read matters.
    """
    w = Window.partitionBy(owner).orderBy(*order)
    log = log.withColumns({"_write": is_write, "_ms": at_ms})
    log = log.withColumns({"_was": F.lag("_write").over(w), "_then": F.lag("_ms").over(w), "_value": F.lag(value).over(w)})
    fresh = F.coalesce(F.col("_was"), F.lit(False)) & (F.col("_ms") - F.col("_then") <= ttl)
    return log.where(~F.col("_write")).withColumn("got", F.when(fresh, F.col("_value"))).drop("_write", "_ms", "_was", "_then", "_value")


def report(context: Column, source: str, route: Column) -> Column:
    """Payload of an error report; the caller's context overrides the defaults."""
    defaults = F.create_map(F.lit("source"), F.lit(source), F.lit("route"), route)
    rest = F.map_filter(defaults, lambda k, v: ~F.coalesce(F.map_contains_key(context, k), F.lit(False)))
    return F.map_concat(rest, F.coalesce(context, F.expr("cast(map() as map<string,string>)")))
