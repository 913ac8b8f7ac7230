"""Aggregates by several levels at once, stored sketches that merge, and multiset differences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of sketches: log2 of the registers of distinct counts, size of those of quantiles.
HLL_LOG, KLL_SIZE = 12, 200


def by_levels(df: DataFrame, columns: Sequence[str], sets: Sequence[Sequence[str]], **of: Column) -> DataFrame:
    """Aggregates ``of`` for each set of ``columns``: the columns, ``level``, the aggregates.

    A row is expanded once for each set and all are aggregated together. In a
    column that is not in a row's set stands null; ``level`` tells that null
    from a null of the data: bit k from the right is set if the k-th column
    from the right is summed over.
    """
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    return grouped.agg(F.grouping_id(*columns).cast("long").alias("level"), *[c.alias(n) for n, c in of.items()])


def cube_sets(columns: Sequence[str]) -> list[list[str]]:
    """All subsets."""
    return [[c for i, c in enumerate(columns) if bits >> i & 1] for bits in range(1 << len(columns))]


def rollup_sets(columns: Sequence[str]) -> list[list[str]]:
    """All beginnings, the empty one as well."""
    return [list(columns[:k]) for k in range(len(columns) + 1)]


def sketched(df: DataFrame, keys: Sequence[str], distinct: Mapping[str, str] | None = None, quantiles: Mapping[str, str] | None = None) -> DataFrame:
    """One row for each of ``keys``, with states that can be stored and merged.

    ``distinct`` and ``quantiles`` map a name to a column: its state of distinct
    values (HyperLogLog), of quantiles (KLL, as doubles). A state has a bounded
    size however many rows it stands for. Nulls are not counted.
    """
    states = [F.hll_sketch_agg(c, HLL_LOG).alias(n) for n, c in (distinct or {}).items()]
    states += [F.kll_sketch_agg_double(F.col(c).cast("double"), KLL_SIZE).alias(n) for n, c in (quantiles or {}).items()]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *states)


def merged(states: DataFrame, keys: Sequence[str], distinct: Sequence[str] = (), quantiles: Sequence[str] = ()) -> DataFrame:
    """Stored states put together for coarser ``keys``; none for keys makes one of all."""
    out = [F.hll_union_agg(n).alias(n) for n in distinct] + [F.kll_merge_agg_double(n).alias(n) for n in quantiles]
    return states.groupBy(*keys).agg(F.sum("n").alias("n"), *out)


def quantile_of(state: str | Column, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(state, F.lit(share))


def multiset(left: DataFrame, right: DataFrame, keep: str) -> DataFrame:
    """Rows of ``left`` counted against equal rows of ``right``, which has the same columns in order.

    ``keep`` is ``both``: as often as either side has them; ``rest``: as often
    as the left side has them more; ``moved``: both, with ``side`` ('left' or
    'right') telling which has them more. Nulls equal each other. Rows are
    counted before the shuffle, so a row that occurs very often is one there,
    and are repeated after it.
    """
    names = left.columns
    row = [F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(d.columns)]).alias("row") for d in (left, right)]
    both = left.select(row[0], F.lit(1).alias("sign")).unionAll(right.select(row[1], F.lit(-1).alias("sign")))
    counts = both.groupBy("row").agg(F.count_if(F.col("sign") > 0).alias("l"), F.count_if(F.col("sign") < 0).alias("r"))
    times = {"both": F.least("l", "r"), "rest": F.greatest(F.col("l") - F.col("r"), F.lit(0)), "moved": F.abs(F.col("l") - F.col("r"))}[keep]
    counts = counts.withColumn("times", times.cast("long")).where("times > 0")
    side = [F.when(F.col("l") > F.col("r"), "left").otherwise("right").alias("side")] if keep == "moved" else []
    out = counts.select("row", *side, F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)], *(["side"] if side else []))
