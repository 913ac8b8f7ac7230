"""Lookups and optional predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


class NotFoundError(LookupError):
    """A row that has to exist does not."""


@dataclass(frozen=True)
class FacetSpec:
    """What a shopper has chosen. Nothing chosen in a facet means no constraint."""

    options: Mapping[str, Sequence[str]] = field(default_factory=dict)
    required: Sequence[str] = ()
    bounds: Mapping[str, float] = field(default_factory=dict)


def at_most(column: Column, bound: Column | float, nullable: bool = True) -> Column:
    """Inclusive upper bound that keeps nulls; where there are none, the plain form reaches the scan."""
    bound = bound if isinstance(bound, Column) else F.lit(bound)
    return ~F.coalesce(column > bound, F.lit(False)) if nullable else column <= bound


def predicate(spec: FacetSpec, nullable: bool = True) -> Column | None:
    """Any option within a facet, and all facets together."""
    parts = [F.col(c).isin(list(options)) for c, options in spec.options.items() if options]
    parts += [F.col(c) for c in spec.required]
    parts += [at_most(F.col(c), b, nullable) for c, b in spec.bounds.items()]
    return reduce(lambda a, b: a & b, parts) if parts else None


def facets(df: DataFrame, spec: FacetSpec, nullable: bool = True) -> DataFrame:
    p = predicate(spec, nullable)
    return df if p is None else df.where(p)


def showing(df: DataFrame, spec: FacetSpec) -> DataFrame:
    """How many rows pass, of how many, in one pass."""
    p = predicate(spec)
    return df.agg(F.count_if(F.lit(True) if p is None else p).alias("showing"), F.count("*").alias("total"))


def by_either(df: DataFrame, key: object, columns: Sequence[str], order: str = "ord") -> DataFrame:
    """The first row, by ``order``, of which any of the columns equals the key."""
    match = reduce(lambda a, b: a | b, [F.col(c) == F.lit(key) for c in columns])
    return df.where(match).orderBy(order).limit(1)


def or_default(df: DataFrame, column: str, key: object, order: str = "ord") -> DataFrame:
    """The row of the key, or else the first row."""
    return df.orderBy(F.coalesce(F.col(column) == F.lit(key), F.lit(False)).desc(), order).limit(1)


def must_exist(df: DataFrame, what: str) -> Row:
    """B04."""
    row = df.first()
    if row is None:
        raise NotFoundError(what)
    return row


def others(df: DataFrame, column: str, key: object, n: int = 4, order: str = "ord") -> DataFrame:
    """The first n rows that are not the key's."""
    return df.where(F.col(column) != F.lit(key)).orderBy(order).limit(n)


def others_of_each(df: DataFrame, column: str, n: int = 4, order: str = "ord") -> DataFrame:
    """For every row the first n others, which are among the first n + 1 rows: those n + 1 keys are read once, so nothing is shuffled or joined."""
    first = [r[0] for r in df.orderBy(order).limit(n + 1).select(column).collect()]
    kind = df.schema[column].dataType
    known = F.array(*[F.lit(x).cast(kind) for x in first]).cast(f"array<{kind.simpleString()}>")
    rest = F.slice(F.filter(known, lambda x: x != F.col(column)), 1, n)
    return df.select(column, F.posexplode(rest).alias("_at", "related")).select(column, "related", (F.col("_at") + 1).alias("position"))


def matches_all(df: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Rows of which some column holds the query, without regard to case."""
    wanted = F.lower(F.lit(query))
    return df.where(reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), wanted) for c in columns]))


def equal_unless_all(df: DataFrame, chosen: Mapping[str, str], everything: str = "All") -> DataFrame:
    return facets(df, FacetSpec({c: [v] for c, v in chosen.items() if v != everything}))


def from_dictionary(entries: Column, nested: Column, key: Column) -> Column:
    """The entry of a key, or else the nested dictionary's, or else the key itself."""
    return F.coalesce(F.try_element_at(entries, key), F.try_element_at(nested, key), key)


def configured(config: Column, payload: Column, nested: Column, key: Column) -> Column:
    """B17. The config of the name that the payload, or else its nested payload, gives for a key; the key's own config where that name has none.

    Without a payload there is no result.
    """
    name = from_dictionary(payload, nested, key)
    found = F.when(F.map_contains_key(config, name), F.element_at(config, name)).otherwise(F.try_element_at(config, key))
    return F.when(payload.isNotNull(), found)


def entries(dictionary: Column) -> Column:
    """B20. Key and value pairs; ``F.map_keys`` gives the keys."""
    return F.map_entries(dictionary)


def nothing_found(df: DataFrame, message: str) -> DataFrame:
    """E06. A row with the message if ``df`` is empty, else none. At most one row is read for it."""
    seen = df.limit(1).agg(F.count("*").alias("n"))
    return seen.where("n = 0").select(F.lit(message).alias("message"))


def server_error(status: Column, content_type: Column, body: Column, markers: Sequence[str]) -> Column:
    """A framework's JSON error: status of 500 or more, JSON, and all markers in the body."""
    return reduce(lambda a, b: a & b, [status >= 500, F.contains(content_type, F.lit("application/json")), *[F.contains(body, F.lit(m)) for m in markers]])


def response(status: Column, raised: Column) -> Column:
    """F07. What a request gives: its own status; if something was raised, that error's status, or 500 for one without."""
    return F.when(raised.isNull(), F.coalesce(status, F.lit(200))).otherwise(F.coalesce(raised["status"], F.lit(500)))


def shown_series(kind: Column) -> Column:
    return ~F.coalesce(kind == "none", F.lit(False))


def coloured(theme: Column, color: Column) -> Column:
    return theme.isNotNull() | (F.coalesce(color, F.lit("")) != "")


def single_day(selected: Column, *range_flags: Column) -> Column:
    return reduce(lambda a, b: a & ~b, range_flags, selected)


def form_problems(df: DataFrame, required: Sequence[str], email: str) -> DataFrame:
    """Rows with ``problems``: required fields that are empty, and an address that is none."""
    empty = [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(c)) for c in required]
    bad = F.when(~F.col(email).rlike(r"^[^\s@]+@[^\s@]+$"), F.lit("email format"))
    return df.withColumn("problems", F.array_compact(F.array(*empty, bad)))
