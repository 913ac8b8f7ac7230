"""Shopping list: existence marks, list updates, and replay of an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import cart_spec, plural

ITEM = "struct<id:string,name:string,spec:string,origin:string,image:string>"


def marked(df: DataFrame, listed: DataFrame, key: str, listed_key: str | None = None, flag: str = "added") -> DataFrame:
    """Every row of ``df`` once, with whether its key is listed. Repeated list entries count once."""
    keys = listed.select(F.col(listed_key or key).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    return df.join(keys, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def removed(df: DataFrame, keys: DataFrame, key: str, listed_key: str | None = None) -> DataFrame:
    return df.join(keys.select(F.col(listed_key or key).alias(key)), key, "left_anti")


def kept_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: a second addition changes nothing."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def toggled(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Members after toggles: keys toggled an odd number of times, placed by their last toggle."""
    last = F.max(F.struct(*order)).alias("last")
    return log.groupBy(*keys).agg(F.count("*").alias("n"), last).where("n % 2 = 1")


def replayed(log: DataFrame, owner: str, item: str, action: Column, order: list[str]) -> DataFrame:
    """List of each owner after add, remove and clear events.

    Events up to the owner's last clear are void, and so are an item's up to its
    last remove; an item is listed from its earliest addition after both.
    """
    at = F.struct(*order)
    log = log.select(owner, item, action.alias("_act"), at.alias("_at"))
    # the last clears and removes are few beside the events, and their maxima are taken before the shuffle
    clears = log.where("_act = 'clear'").groupBy(F.col(owner).alias("_owner")).agg(F.max("_at").alias("_cleared"))
    removes = log.where("_act = 'remove'").groupBy(F.col(owner).alias("_by"), F.col(item).alias("_of")).agg(F.max("_at").alias("_gone"))
    adds = log.where("_act = 'add'").join(clears, F.col(owner).eqNullSafe(F.col("_owner")), "left")
    adds = adds.join(removes, F.col(owner).eqNullSafe(F.col("_by")) & F.col(item).eqNullSafe(F.col("_of")), "left")
    later = lambda c: F.col(c).isNull() | (F.col("_at") > F.col(c))
    listed = adds.where(later("_cleared") & later("_gone")).groupBy(owner, item).agg(F.min("_at").alias("_first"))
    place = F.row_number().over(Window.partitionBy(owner).orderBy("_first"))
    return listed.withColumn("position", place.cast("bigint")).drop("_first")


def product_line(df: DataFrame) -> DataFrame:
    """D01. A product as an item of a list."""
    return df.select("id", "name", cart_spec(F.col("size"), F.col("finish")).alias("spec"), "origin", "image")


def featured_line(df: DataFrame) -> DataFrame:
    """D02. A featured product as an item of a list: its picture has another name there, its spec stays as it is."""
    return df.select("id", "name", "spec", "origin", F.col("img").alias("image"))


def badge(df: DataFrame, noun: str = "product") -> DataFrame:
    """E02, E06. How many items a list holds; no row for an empty list."""
    return df.agg(F.count("*").alias("n")).where("n > 0").select("n", plural(F.col("n"), noun).alias("label"))


def restored(stored: Column) -> Column:
    """A stored list; what is absent or malformed is an empty one."""
    return F.coalesce(F.from_json(stored, f"array<{ITEM}>"), F.expr(f"cast(array() as array<{ITEM}>)"))


def stored(df: DataFrame, owner: str, order: str) -> DataFrame:
    """Each owner's items as one JSON text, in order."""
    items = F.array_sort(F.collect_list(F.struct(order, F.struct("id", "name", "spec", "origin", "image").alias("item"))))
    return df.groupBy(owner).agg(F.to_json(F.transform(items, lambda x: x["item"])).alias("stored"))


def lines(df: DataFrame, owner: str, order: str, line: Column) -> DataFrame:
    """Each owner's lines as one text, in order."""
    collected = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line"))))
    return df.groupBy(owner).agg(F.array_join(F.transform(collected, lambda x: x["line"]), "\n").alias("text"))


def all_or_none(df: DataFrame, key: str, every: bool) -> DataFrame:
    """A selection of all rows, or of none."""
    return df.select(key) if every else df.select(key).limit(0)


def placeholders(df: DataFrame, n: int) -> DataFrame:
    """n numbered rows."""
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("position"))
