"""Sorting, searching and counting that the storefront shows but does not wire up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import lead_weeks
from brindle.operators.filters import FacetSpec, at_most
from brindle.sources.shared import stored


def sort_keys(by: str, lead: str = "lead_time", price: str = "price_min", moq: str = "moq") -> list[Column]:
    keys: dict[str, list[Column]] = {
        "recommended": [], "lead time": [lead_weeks(F.col(lead))["least"], lead_weeks(F.col(lead))["most"]], "price": [F.col(price)], "moq": [F.col(moq)],
    }
    return keys[by]


def ordered(df: DataFrame, by: str = "recommended", order: str = "ord", **columns: str) -> DataFrame:
    return df.orderBy(*sort_keys(by, **columns), order)


def placed(df: DataFrame, keys: Sequence[Column], order: str, name: str = "position") -> DataFrame:
    """Rows with their position, from 1 on, by ``keys`` and then ``order``.

    Rows are dealt out by ranges of the order, stored so, and numbered within a
    range; what stands before a range is added from a table of one row for each.
    """
    by = [*keys, F.col(order)]
    names = [f"_k{i}" for i in range(len(by))]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumns(dict(zip(names, by, strict=True))).repartitionByRange(ranges, *names).withColumn("_range", F.spark_partition_id())
    rows = stored(rows, "placed")
    inside = Window.partitionBy("_range").orderBy(*names)
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    out = rows.withColumn("_number", F.row_number().over(inside)).join(F.broadcast(starts), "_range")
    return out.withColumn(name, F.col("_start") + F.col("_number")).drop("_range", "_number", "_start", *names)


def of_supplier(df: DataFrame, supplier: str, column: str = "supplier_slug") -> DataFrame:
    """G09."""
    return df.where(F.col(column) == F.lit(supplier))


def counted(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def option_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of each option of each facet, from one pass with each row given once per facet."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("option")) for c in columns])
    return df.select(F.explode(pairs).alias("x")).groupBy("x.facet", "x.option").agg(F.count("*").alias("n"))


def option_counts_chosen(df: DataFrame, spec: FacetSpec, facets: Sequence[str], nullable: bool = True) -> DataFrame:
    """Rows of each option of each of ``facets`` under the choices in all other facets: what choosing the option would show.

    One pass: a bit for each part of the choice that a row fails. A row counts
    for a facet if it fails nothing, or that facet's own choice alone.
    """
    parts = {c: F.col(c).isin(list(o)) for c, o in spec.options.items() if o}
    parts |= {f"required {c}": F.col(c) for c in spec.required}
    parts |= {f"bound {c}": at_most(F.col(c), b, nullable) for c, b in spec.bounds.items()}
    bit = {name: 1 << i for i, name in enumerate(parts)}
    failed = F.lit(0)
    for name, passes in parts.items():
        failed = failed.bitwiseOR(F.when(F.coalesce(passes, F.lit(False)), 0).otherwise(bit[name]))
    pairs = [F.when(F.col("_failed").bitwiseAND(~bit.get(c, 0)) == 0, F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("option"))) for c in facets]
    rows = df.withColumn("_failed", failed).select(F.explode(F.array_compact(F.array(*pairs))).alias("x"))
    return rows.groupBy("x.facet", "x.option").agg(F.count("*").alias("n"))


def edited(df: DataFrame, edits: DataFrame, key: str, columns: Sequence[str], order: str | None = None, clear: str | None = None) -> DataFrame:
    """Rows with their edits, where there are any.

    Of several edits of a key, for each column the last by ``order`` that has a
    value counts (without ``order``, the greatest value). ``clear`` names an
    array of the edits' columns to be set to null; a value in the same or a
    later edit counts instead.
    """
    at = F.col(order) if order else F.lit(0)
    rows = edits.where(F.col(key).isNotNull())
    change = []
    for c in columns:
        cleared = F.coalesce(F.array_contains(clear, c), F.lit(False)) if clear else F.lit(False)
        touched = F.col(c).isNotNull() | cleared
        change.append(F.max(F.when(touched, F.struct(at.alias("at"), F.col(c).isNotNull().alias("set"), F.col(c).alias("to")))).alias(f"_new_{c}"))
    out = df.join(rows.groupBy(key).agg(*change), key, "left")
    return out.withColumns({c: F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}.to")).otherwise(F.col(c)) for c in columns}).drop(*[f"_new_{c}" for c in columns])
