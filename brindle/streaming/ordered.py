"""Events of each owner in order of time, whatever the order of their arrival.

Events wait in state until the watermark has passed their time: then no earlier
one can come any more, and they are applied in order of (time, number). Each
group of owners has a timer at its earliest waiting event; Spark calls back when
the watermark is there. Events later than the lateness allowed are dropped.
"""

from __future__ import annotations

import itertools
import pickle
import sys
from collections import namedtuple
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
#: Groups of owners of a stream of unknown size. Of a known one: owners and events of a group, and the fewest groups.
GROUPS, OWNERS, EVENTS, LEAST = 1024, 256, 20_000, 64
#: Events that are one value of the state.
PARCEL = 5_000


@dataclass(frozen=True)
class Rules:
    """What an event does to an owner's state.

    ``apply`` gets the state (None at first) and an event and returns the new
    state, or None, and what is given out for the event. ``settle``, if there is
    one, gives out what the state is after all that became due together.
    ``kept_until`` tells up to which millisecond an idle state can matter.
    """

    output: str
    apply: Callable[[tuple | None, Any], tuple[tuple | None, list[tuple]]]
    settle: Callable[[tuple | None, Any], list[tuple]] | None = None
    kept_until: Callable[[tuple], int] | None = None


class Ordered(StatefulProcessor):
    """A key of the state is a group of owners, read and written once a batch: what waits in parcels of events, the states of all in one."""

    def __init__(self, rules: Rules, events: str) -> None:
        self.rules = rules
        self.names = [c.split()[0] for c in events.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "parcel binary")
        self.held = handle.getValueState("held", "states binary")
        # fields of a Row are looked up by name at each use
        self.event = namedtuple("Event", self.names)

    def _timer(self, ms: int | None) -> None:
        """The group's only timer."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if ms is not None:
            self.handle.registerTimer(ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        earliest = None
        while new := [tuple(r[1 : len(self.names) + 2]) for r in itertools.islice(rows, PARCEL)]:
            self.waiting.appendValue((pickle.dumps(new),))
            earliest = min(e[1] for e in new) if earliest is None else min(earliest, min(e[1] for e in new))
        timers = list(self.handle.listTimers())
        if earliest is not None and (not timers or earliest < min(timers)):
            self._timer(earliest)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        # what came at the watermark counts as late, so all before it are there
        reached = timerValues.getCurrentWatermarkInMs()
        due: dict[Any, list[tuple]] = {}
        rest = []
        for (parcel,) in self.waiting.get() if self.waiting.exists() else ():
            for e in pickle.loads(parcel):
                due.setdefault(e[0], []).append(e) if e[1] < reached else rest.append(e)
        held = pickle.loads(self.held.get()[0]) if self.held.exists() else {}
        give = Row("owner", *[c.split()[0] for c in self.rules.output.split(", ")])
        for owner, events in due.items():
            state = held.pop(owner, None)
            for e in sorted(events, key=lambda e: (e[1], e[2])):
                event = self.event(*e[1:])
                state, given = self.rules.apply(state, event)
                for g in given:
                    yield give(owner, *g)
            if self.rules.settle:
                for g in self.rules.settle(state, event):
                    yield give(owner, *g)
            if state is not None:
                held[owner] = state
        following = [e[1] for e in rest]
        if self.rules.kept_until:
            busy = {e[0] for e in rest}
            until = {owner: self.rules.kept_until(state) for owner, state in held.items() if owner not in busy}
            held = {owner: state for owner, state in held.items() if until.get(owner, reached) >= reached}
            following += [ms for ms in until.values() if ms >= reached]
        if due:
            parcels = [(pickle.dumps(rest[i : i + PARCEL]),) for i in range(0, len(rest), PARCEL)]
            self.waiting.put(parcels) if parcels else self.waiting.clear()
        self.held.update((pickle.dumps(held),)) if held else self.held.clear()
        self._timer(min(following, default=None))


def groups_of(rows: DataFrame) -> int:
    """How many groups of owners suit a table: some OWNERS of them in each, and not much more than EVENTS rows."""
    owners, n = rows.agg(F.approx_count_distinct("owner"), F.count("*")).first()
    return max(LEAST, -(-owners // OWNERS), -(-n // EVENTS))


def ordered(log: DataFrame, rules: Rules, events: str, late: str, groups: int = GROUPS) -> DataFrame:
    """``rules`` applied to a stream of (owner, and the columns of ``events``, which begin with ms and seq): owner and the rules' output.

    Rows without an owner are an owner's; a row without a time or number is left
    out. Times before 1970 count as late. Owners are dealt into ``groups``,
    which has to stay as it is for a checkpoint; a task holds what waits for a group.
    """
    log = log.where(F.col("ms").isNotNull() & F.col("seq").isNotNull())
    # rows at the watermark count as late, and it starts at 0: a millisecond more keeps those of time 0
    timed = log.withColumn("_at", F.timestamp_millis(F.col("ms") + 1)).withWatermark("_at", late)
    names = ["owner", *[c.split()[0] for c in events.split(", ")]]
    timed = timed.select(F.pmod(F.xxhash64("owner"), F.lit(groups)).alias("_group"), *names, "_at")
    output = f"owner {dict(log.dtypes)['owner']}, {rules.output}"
    return timed.groupBy("_group").transformWithState(Ordered(rules, events), output, "Append", "EventTime")
