"""The last-value register as a stream of ordered events.

A write replaces the held value; a read returns it, if it is not older than the
time to live by event time, and clears it either way. A value that no read
fetches is let go when the watermark has passed its time to live, so the state
holds no owner for longer. The batch form is
``brindle.operators.review.register_reads``; the stream gives the same for any
order of arrival within the lateness.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row

from brindle.operators.review import TTL_MS
from brindle.streaming.ordered import GROUPS, Rules, ordered

cloudpickle.register_pickle_by_value(sys.modules[__name__])
EVENT = "ms long, seq long, is_write boolean, value string"


def _rules(ttl: int) -> Rules:
    def apply(held: tuple | None, event: Row) -> tuple[tuple | None, list[tuple]]:
        if event.is_write:
            return (event.value, event.ms), []
        fresh = held is not None and event.ms - held[1] <= ttl
        return None, [(event.seq, held[0] if fresh else None)]

    return Rules("seq long, got string", apply, kept_until=lambda held: held[1] + ttl)


def reads(log: DataFrame, ttl: int = TTL_MS, late: str = "10 seconds", groups: int = GROUPS) -> DataFrame:
    """owner, seq, got: what each read returns, for a stream of (owner, seq, ms, is_write, value).

    Those later than ``late`` behind the newest are left out.
    """
    return ordered(log, _rules(ttl), EVENT, late, groups)
