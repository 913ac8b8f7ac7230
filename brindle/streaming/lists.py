"""Shopping lists as a stream of ordered events: additions, removals, clearings.

The batch form is ``brindle.operators.cart.replayed``.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from brindle.streaming.ordered import GROUPS, Rules, ordered

cloudpickle.register_pickle_by_value(sys.modules[__name__])
EVENT = "ms long, seq long, act string, item string"


def _apply(held: tuple | None, event: Row) -> tuple[tuple | None, list[tuple]]:
    items = list(held[0]) if held else []
    if event.act == "clear":
        items = []
    elif event.act == "remove":
        items = [x for x in items if x != event.item]
    elif event.act == "add" and event.item not in items:
        items.append(event.item)
    return (items,), []


def _settle(held: tuple | None, event: Row) -> list[tuple]:
    return [(event.ms, event.seq, list(held[0]) if held else [])]


RULES = Rules("ms long, seq long, items array<string>", _apply, _settle)


def lists(log: DataFrame, late: str = "10 seconds", groups: int = GROUPS) -> DataFrame:
    """owner, ms, seq, items: an owner's list after the events that became due together, by the last of them.

    For a stream of (owner, ms, seq, act, item). The row of an owner with the
    greatest (ms, seq) is its list.
    """
    return ordered(log, RULES, EVENT, late, groups)


def latest(changes: DataFrame) -> DataFrame:
    """owner, item, position: each owner's present list from what ``lists`` wrote."""
    last = changes.groupBy("owner").agg(F.max_by("items", F.struct("ms", "seq")).alias("items"))
    return last.select("owner", F.posexplode("items").alias("position", "item")).withColumn("position", F.col("position").cast("long") + 1)
