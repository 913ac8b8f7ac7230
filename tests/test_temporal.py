"""Joins and frames over time against brute force, their plans, and histories cut in any way."""

import random
from datetime import datetime, timedelta

import pytest

from brindle.operators import temporal

START = datetime(2024, 1, 1)


def rows(seed, n, keys=3, minutes=60):
    r = random.Random(seed)
    return [(r.choice([None, *range(keys)]), None if r.random() < 0.05 else START + timedelta(minutes=r.randrange(minutes)), i) for i in range(n)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("minutes", [None, 1, 7, 1000])
def test_asof(spark, before, minutes):
    left, right = rows(1, 60), rows(2, 40)
    ours = spark.createDataFrame(left, "k long, t timestamp_ntz, id long")
    theirs = spark.createDataFrame(right, "k long, u timestamp_ntz, n long")
    width = minutes and minutes * 60_000_000
    out = temporal.asof(ours, theirs, ["k"], "t", "u", ["n", "u"], ["n"], before=before, within=15 * 60_000_000, width=width)
    got = {r.id: (r.n, r.u) for r in out.collect()}
    assert len(got) == len(left)
    for k, t, i in left:
        earlier = [(u, n) for j, u, n in right if j == k is not None and t and u and (u < t or (u == t and not before))]
        u, n = max(earlier, default=(None, None))
        assert got[i] == ((n, u) if u and t - u <= timedelta(minutes=15) else (None, None))
    assert "Join" not in plan(out)


def test_asof_keeps_all_columns_and_repeated_rows(spark):
    ours = spark.createDataFrame([(1, START, "a", 7)] * 3, "k long, t timestamp_ntz, `at` string, side int")
    theirs = spark.createDataFrame([(1, START, 5), (1, START, 6)], "k long, u timestamp_ntz, n long")
    out = temporal.asof(ours, theirs, ["k"], "t", "u", ["n"], ["n"])
    assert [tuple(r) for r in out.collect()] == [(1, START, "a", 7, 6)] * 3
    assert temporal.asof(ours.limit(0), theirs, ["k"], "t", "u", ["n"]).count() == 0
    assert [r.n for r in temporal.asof(ours, theirs.limit(0), ["k"], "t", "u", ["n"]).collect()] == [None] * 3


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("width", [None, 1, 60_000_000, 10**12])
def test_intervals(spark, keys, width):
    r = random.Random(3)
    points = rows(4, 50, minutes=3000)
    spans = [(k, t, t and t + timedelta(minutes=r.choice([-5, 0, 0, 1, 10, 10, 300, 2500])), i) for k, t, i in rows(5, 40, minutes=3000)]
    if width == 1:  # bins of a microsecond: few rows suffice
        points, spans = points[:10], spans[:6]
    dots = spark.createDataFrame(points, "k long, t timestamp_ntz, id long")
    intervals = spark.createDataFrame(spans, "k long, s timestamp_ntz, e timestamp_ntz, n long")
    if not keys:
        intervals = intervals.drop("k")
    out = temporal.within_interval(dots, intervals, "t", "s", "e", keys, width)
    want = sorted((i, n) for k, t, i in points for j, s, e, n in spans if t and s and s <= t <= e and (not keys or k == j is not None))
    assert sorted((x.id, x.n) for x in out.collect()) == want
    assert not {"NestedLoop", "Cartesian"} & set(plan(out).split("Join")[0].split()) and "NestedLoop" not in plan(out)


def test_bins_of_an_interval_are_few(spark):
    """Lengths from an instant to a century."""
    spans = [(START, START + timedelta(seconds=10**k), k) for k in range(10)]
    intervals = spark.createDataFrame(spans, "s timestamp_ntz, e timestamp_ntz, n long")
    dots = spark.createDataFrame([(START + timedelta(days=1), 0)], "t timestamp_ntz, id long")
    out = temporal.within_interval(dots, intervals, "t", "s", "e", width=1_000_000)
    assert sorted(r.n for r in out.collect()) == [5, 6, 7, 8, 9]
    analyzed = out._jdf.queryExecution().analyzed().toString()
    assert "explode" in analyzed


@pytest.mark.parametrize("bucket", [1, 5, 30])
def test_rolling_sum(spark, bucket):
    data = [(k, t, None if i % 9 == 0 else i) for k, t, i in rows(6, 150, minutes=200)]
    df = spark.createDataFrame(data + data[:10], "k long, t timestamp_ntz, amount long")
    out = temporal.rolling_sum(df, ["k"], "t", "amount", 30 * 60_000_000, bucket * 60_000_000, "total")
    data = data + data[:10]
    want = [(k, t, a, None if t is None else sum(b or 0 for j, u, b in data if j == k and u and timedelta(0) <= t - u <= timedelta(minutes=30))) for k, t, a in data]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    with pytest.raises(ValueError):
        temporal.rolling_sum(df, ["k"], "t", "amount", 7, 2)


def test_numbers_of_intervals(spark, monkeypatch):
    """As many as the pairs, without any pair; null and equal times, intervals of an instant or upside down, several buckets."""
    r = random.Random(7)
    points = rows(8, 80, minutes=300)
    spans = [(t, None if i % 11 == 0 or not t else t + timedelta(minutes=r.choice([-5, 0, 0, 1, 30, 250]))) for i, (_, t, _) in enumerate(rows(9, 60, minutes=300))]
    dots = spark.createDataFrame(points, "k long, t timestamp_ntz, id long")
    intervals = spark.createDataFrame(spans, "s timestamp_ntz, e timestamp_ntz")
    for size in (200_000, 10):
        monkeypatch.setattr(temporal, "BUCKET_ROWS", size)
        out = temporal.covered(dots, intervals, "t", "s", "e", "n")
        want = sorted((i, sum(bool(t and s and e and s <= t <= e) for s, e in spans)) for _, t, i in points)
        assert sorted((x.id, x.n) for x in out.collect()) == want and any(n for _, n in want)
        assert "Join" not in plan(out)
    assert {x.n for x in temporal.covered(dots, intervals.limit(0), "t", "s", "e", "n").collect()} == {0}
    assert temporal.covered(dots.limit(0), intervals, "t", "s", "e", "n").count() == 0


def test_a_hot_key_is_many_groups(spark, monkeypatch):
    """One key and one bin: blocks of either side, in more than one task; exact copies stay, none come."""
    monkeypatch.setattr(temporal, "SIDE", 7)
    monkeypatch.setattr(temporal, "PAIRS", 50)
    dots = spark.createDataFrame([(1, START + timedelta(minutes=i % 40), i % 45) for i in range(60)] + [(2, START, 99)], "k long, t timestamp_ntz, id long")
    intervals = spark.createDataFrame([(k, START + timedelta(minutes=i), START + timedelta(minutes=i + 60), i) for k in (1, 2) for i in range(0, 20)], "k long, s timestamp_ntz, e timestamp_ntz, points int")
    out = temporal.within_interval(dots, intervals, "t", "s", "e", ["k"])
    want = sorted((r.id, i.points) for r in dots.collect() for i in intervals.collect() if r.k == i.k and i.s <= r.t <= i.e)
    assert sorted((x.id, x.points) for x in out.collect()) == want
    assert out.columns == ["k", "t", "id", "s", "e", "points"]
    sizes = [n for n in out.rdd.glom().map(len).collect() if n]
    assert len(sizes) > 4 and max(sizes) < len(want) / 3


def test_a_pair_costs_no_conversion_and_intervals_are_made_once(spark):
    """The check of a pair compares numbers, and what makes the intervals is no part of the last plan."""
    dots = spark.createDataFrame([(1, START, 1)], "k long, t timestamp_ntz, at int")
    intervals = spark.createDataFrame([(1, START, START + timedelta(minutes=5), 7)] * 2, "k long, s timestamp_ntz, e timestamp_ntz, low int").distinct()
    out = temporal.within_interval(dots, intervals, "t", "s", "e", ["k"])
    optimized = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in optimized.splitlines() if "Join Inner" in x]
    assert joins and "timestampdiff" not in "".join(joins).lower() and "Aggregate" not in optimized
    assert out.columns == ["k", "t", "at", "s", "e", "low"] and [(r.at, r.low) for r in out.collect()] == [(1, 7)]
