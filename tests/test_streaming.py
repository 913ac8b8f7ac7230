"""Streams against their batch forms: any order of arrival, late rows, state that levels off."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import cart, review
from brindle.streaming import lists, matching, register, windows
from brindle.streaming.replay import replay

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
READS = "owner string, seq long, ms long, is_write boolean, value string, p int"


def log(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def registered(spark, rows, ttl=5000, late="10 seconds", parts=4):
    last = log(spark, [(None, -1, 10**12, True, None, 0)], READS)
    out = replay(log(spark, rows, READS), F.col("p"), parts, lambda read: register.reads(read(), ttl, late), last)
    return out


def test_a_read_that_arrives_after_a_later_one(spark):
    """Write at 100, read at 300, then a read at 200 that arrives later: it is the one that gets the value."""
    rows = [("a", 0, 100, True, "v", 1), ("a", 2, 300, False, None, 1), ("a", 1, 200, False, None, 2), ("b", 3, 0, True, "w", 2), ("b", 4, 5000, False, None, 3), ("b", 5, 5001, False, None, 4)]
    assert {r.seq: r.got for r in registered(spark, rows).table.collect()} == {1: "v", 2: None, 4: "w", 5: None}


def test_register_equals_the_table_in_any_order_of_arrival(spark):
    r = random.Random(1)
    rows = []
    for seq in range(120):
        ms = r.randrange(40_000)
        # within the lateness: a part covers 10 seconds of arrival, and a row arrives less than 10 seconds late
        rows.append((r.choice([None, "a", "b", "c"]), seq, ms, r.random() < 0.5, r.choice([None, "x", "y"]), 1 + (ms + r.randrange(10_000)) // 10_000))
    out = registered(spark, rows, ttl=3000, late="20 seconds", parts=5)
    got = {(x.owner, x.seq): x.got for x in out.table.collect()}
    df = log(spark, rows, READS)
    want = review.register_reads(df, "owner", F.col("ms"), ["ms", "seq"], F.col("is_write"), "value", ttl=3000)
    assert got == {(x.owner, x.seq): x.got for x in want.collect()} and out.dropped() == 0


def test_unread_values_do_not_stay(spark):
    rows = [(f"o{i}", i, ms, True, "x", i + 1) for i, ms in enumerate((0, 60_000, 120_000, 180_000))]
    out = registered(spark, rows, late="0 seconds")
    held = out.state_rows()
    assert held[-1] < len(rows) < 2 * max(held)
    assert out.table.count() == 0


def test_lists_equal_the_replay_of_the_table(spark):
    r = random.Random(2)
    rows = []
    for seq in range(150):
        ms = r.randrange(30_000)
        rows.append((r.choice(["a", "b"]), ms, seq, r.choice(["add"] * 6 + ["remove", "remove", "clear"]), r.choice("xyzw"), 1 + (ms + r.randrange(10_000)) // 10_000))
    schema = "owner string, ms long, seq long, act string, item string, p int"
    df = log(spark, rows, schema)
    last = log(spark, [(None, 10**12, -1, None, None, 0)], schema)
    got = lists.latest(replay(df, F.col("p"), 4, lambda read: lists.lists(read(), "20 seconds"), last).table.where("seq >= 0"))
    want = cart.replayed(df, "owner", "item", F.col("act"), ["ms", "seq"])
    assert sorted(tuple(x) for x in got.select("owner", "item", "position").collect()) == sorted(tuple(x) for x in want.collect())


CLICKS = "user string, kind string, ts timestamp, n long, p int"


def clicks(seed, n, late=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        at = r.randrange(4 * 3600)
        out.append((r.choice("abc"), r.choice(["view", "buy"]), START + datetime.timedelta(seconds=at), i, 1 + min(3, (at + r.randrange(late + 1)) // 3600)))
    return out


def far(spark):
    return log(spark, [("", k, START + datetime.timedelta(days=9000), -1, 0) for k in ("view", "buy")], CLICKS)


def test_sessions_of_the_stream_are_those_of_the_table(spark):
    df = log(spark, clicks(3, 200, late=3600), CLICKS)
    out = replay(df, F.col("p"), 4, lambda read: windows.session_stream(read(), ["user"], "ts", 300 * windows.SECOND, "3 hours", {"total": "n"}), far(spark))
    want = windows.sessions(df, ["user"], "ts", 300 * windows.SECOND, {"total": "n"})
    assert sorted(map(tuple, out.table.collect())) == sorted(map(tuple, want.collect())) and out.dropped() == 0
    sizes = sorted((r.start, r.end) for r in want.collect())
    assert len(sizes) > 20 and any(b - a > datetime.timedelta(seconds=700) for a, b in sizes)


def test_late_rows_are_dropped_and_counted(spark):
    """The row of the second part is an hour behind the watermark."""
    at = lambda h, m=0: START + datetime.timedelta(hours=h, minutes=m)
    rows = [("a", "view", at(5), 1, 1), ("a", "view", at(0, 30), 2, 2), ("a", "view", at(6), 3, 2)]
    out = replay(log(spark, rows, CLICKS), F.col("p"), 2, lambda read: windows.sliding(read(), ["user"], "ts", "1 hour", "1 hour", "1 hour", n=F.count("*")), far(spark))
    assert sorted((r.start.hour, r.n) for r in out.table.collect()) == [(5, 1), (6, 1)]
    assert out.dropped() == 1


@pytest.mark.parametrize("late", ["3 hours"])
def test_joined_streams_are_the_joined_table(spark, late):
    df = log(spark, clicks(4, 150, late=3600), CLICKS)
    build = lambda read: matching.followed(read().where("kind = 'view'"), read().where("kind = 'buy'"), ["user"], "ts", "10 MINUTES", late, ["n"])
    out = replay(df, F.col("p"), 4, build, far(spark))
    rows = df.collect()
    want = []
    for v in (r for r in rows if r.kind == "view"):
        then = [b.n for b in rows if b.kind == "buy" and b.user == v.user and datetime.timedelta(0) <= b.ts - v.ts <= datetime.timedelta(minutes=10)]
        want += [(v.n, n) for n in then or [None]]
    assert sorted((r.n, r.then_n) for r in out.table.where("n >= 0").collect() if r.then_n is not None) == sorted(w for w in want if w[1] is not None)
    assert sorted(r.n for r in out.table.where("n >= 0 AND then_n IS NULL").collect()) == sorted(w[0] for w in want if w[1] is None)
    assert out.table.columns == ["user", "kind", "ts", "n", "p", "then_n"]


def test_state_of_a_join_levels_off(spark):
    """As many rows an hour for twelve hours: after the first hours, the state is no larger at the end."""
    rows = [(f"u{i % 7}", ("view", "buy")[i % 2], START + datetime.timedelta(minutes=3 * i), i, 1 + i // 20) for i in range(240)]
    build = lambda read: matching.followed(read().where("kind = 'view'"), read().where("kind = 'buy'"), ["user"], "ts", "10 MINUTES", "30 minutes", ["n"])
    held = replay(log(spark, rows, CLICKS), F.col("p"), 12, build).state_rows()
    assert max(held[8:]) <= max(held[:8]) < 60


def test_rows_exactly_the_gap_apart_are_two_sessions(spark):
    """In one part, within a session of another part, and a microsecond less."""
    gap = datetime.timedelta(seconds=300)
    at = [("a", 0 * gap, 1), ("a", gap, 1), ("a", 2 * gap, 2), ("b", 0 * gap, 1), ("b", gap - datetime.timedelta(microseconds=1), 2)]
    df = log(spark, [(u, "view", START + t, i, p) for i, (u, t, p) in enumerate(at)], CLICKS)
    out = replay(df, F.col("p"), 2, lambda read: windows.session_stream(read(), ["user"], "ts", 300 * windows.SECOND, "1 hour"), far(spark)).table
    want = windows.sessions(df, ["user"], "ts", 300 * windows.SECOND)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and out.count() == 4


def test_a_join_of_streams_compares_near_rows_only(spark):
    """The keys of the state hold a bin of time; times on the bounds of bins, and before 1970."""
    base = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)
    minutes = [-20, -11, -10, -1, 0, 1, 9, 10, 11, 19, 20, 21, 30, 45]
    rows = [("a", k, base + datetime.timedelta(days=d, minutes=m), 1000 * d + m, 1) for d in (0, 19000) for m in minutes for k in ("view", "buy")]
    df = log(spark, rows, CLICKS)
    found = matching.followed(df.where("kind = 'view'"), df.where("kind = 'buy'"), ["user"], "ts", "10 MINUTES", "1 hour", ["n"])
    want = [(v[3], b[3]) for v in rows for b in rows if v[1] == "view" and b[1] == "buy" and datetime.timedelta(0) <= b[2] - v[2] <= datetime.timedelta(minutes=10)]
    assert sorted((r.n, r.then_n) for r in found.collect()) == sorted(want)
    assert "then__bin" in found._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1].splitlines()[0]


def test_owners_share_a_key_of_the_state(spark):
    """As the table, with far fewer rows in state than owners, events that wait and values that stay."""
    r = random.Random(5)
    rows = [(r.choice([None, *map(str, range(90))]), seq, ms, r.random() < 0.5, r.choice([None, "x", "y"]), 1 + ms // 10_000) for seq in range(400) for ms in [r.randrange(40_000)]]
    df, last = log(spark, rows, READS), log(spark, [(None, -1, 10**12, True, None, 0)], READS)
    out = replay(df, F.col("p"), 4, lambda read: register.reads(read(), 20_000, "5 seconds", groups=2), last)
    want = review.register_reads(df, "owner", F.col("ms"), ["ms", "seq"], F.col("is_write"), "value", ttl=20_000)
    assert {(x.owner, x.seq): x.got for x in out.table.collect()} == {(x.owner, x.seq): x.got for x in want.collect()}
    assert out.dropped() == 0 and max(out.state_rows()) < 45
