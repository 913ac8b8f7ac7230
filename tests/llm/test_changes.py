"""The applier of changes against a brute-force version that takes one row after the other."""

import datetime
import math
import random
import zlib
from collections import defaultdict

import pytest

from brindle.llm import changes

SCHEMA = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"


def low(v):
    return (v is not None, v)


def brute(rows):
    rows, numbers = set(rows), {}
    seqs = defaultdict(set)
    for r in rows:
        seqs[r[1]].add(r[2])
    for client, of in seqs.items():
        numbers |= {(client, s): i for i, s in enumerate(sorted(of, key=low), 1)}
    batches = defaultdict(list)
    for r in rows:
        h = zlib.crc32(b"" if r[0] is None else str(r[0]).encode())
        if r[4] is not None and h % 11:
            day = (r[4].date() - datetime.date(1970, 1, 1)).days + 2 * (h % 4)
            batches[max(1, min(8, 1 + math.floor((day - 19723) * 8 / 160)))].append((day, r))
    state, out, last, largest = {}, [], {}, None

    def apply(client, n, batch, missed):
        s = state[client]
        _, r = s["held"].pop(n)
        old = s["values"]
        s["values"] = {"I": (r[7], r[8]), "D": (None, None), "U": tuple(o if v is None else v for o, v in zip(old, r[7:9], strict=True))}.get(r[3], old)
        s["next"] = n + 1
        last[client] = (len(out), r[3])
        city, balance = s["values"]
        out.append([r[0], client, "applied", batch, missed, city, None if balance is None else math.floor(100 * balance + 0.5), False])

    def go_on(client, batch):
        while state[client]["next"] in state[client]["held"]:
            apply(client, state[client]["next"], batch, 0)

    for batch in range(1, 10):
        for client, s in state.items():
            while s["held"] and (batch == 9 or (largest is not None and min(d for d, _ in s["held"].values()) + 5 <= largest)):
                n = min(s["held"])
                missed, s["next"] = n - s["next"], n
                apply(client, n, batch, missed)
                go_on(client, batch)
        for day, r in sorted(batches[batch], key=lambda x: (x[0], low(x[1][0]), numbers[x[1][1], x[1][2]], low(x[1][3]), x[1][4], low(x[1][7]), low(x[1][8]))):
            s, n = state.setdefault(r[1], {"next": 1, "held": {}, "values": (None, None)}), numbers[r[1], r[2]]
            if n in s["held"] or n < s["next"]:
                out.append([r[0], r[1], "rejected", batch, 0, None, None, False])
                continue
            s["held"][n] = (day, r)
            go_on(r[1], batch)
        largest = max([d for d, _ in batches[batch]] + ([] if largest is None else [largest]), default=None)
    for place, op in last.values():
        out[place][7] = op != "D"
    return sorted(map(repr, map(tuple, out)))


def ours(df):
    out = changes.digest(df).select("change_id", "client_id", "status", "batch", "missed", "city", "cents", "current")
    return sorted(repr(tuple(r)) for r in out.collect())


def made(seed, rows, clients=6, first=0, days=160):
    r = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    out = []
    for i in range(rows):
        client, day = r.choice([0] * clients + list(range(clients))), r.randrange(first, days)
        at = None if r.random() < 0.03 else start + datetime.timedelta(days=day, hours=r.randrange(24))
        out.append((i, client, day // 3 + r.choice([0, 0, 0, 1, 5]), r.choice("IUUUUD"), at, "s", "t", r.choice([None, "a", "b", "ä"]), r.choice([None, 1.005, -2.5, 1e6])))
    return out


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/client_changes.parquet").select(*changes.COLUMNS)
    assert ours(df) == brute([tuple(r) for r in df.collect()])


def test_odd_rows_and_empty_batches(spark):
    """Nulls anywhere, repeated rows, ties, other operations, days far out; batches 3 to 6 are empty; other columns are ignored."""
    start = datetime.datetime(2024, 1, 1)
    rows = made(1, 150, days=40) + [(i + 1000, *r[1:]) for i, r in enumerate(made(2, 60, first=125))]
    rows += [
        (None, 1, 1, "I", start, None, None, "a", 1.0), (500, None, None, "I", start, None, None, "n", 1.0), (501, None, 4, "U", start, None, None, None, 2.0), (502, 77, 1, None, start, None, None, "x", 3.0),
        (503, 77, 2, "Z", start, None, None, "y", 4.0), (504, 88, 1, "I", datetime.datetime(1950, 5, 5), None, None, "old", 5.0), (505, 88, 9, "U", datetime.datetime(2030, 1, 1), None, None, "new", None),
        (506, 99, 1, "I", start, None, None, "x" * 200_000, float("-1.005")), (507, 99, 2, "D", start, None, None, None, None), (508, 99, 2, "U", start, None, None, "same day and number", None),
        (509, 66, 1, "I", start, None, None, "tie", 1.0), (509, 66, 1, "U", start, None, None, "tie", 1.0),
    ]
    df = spark.createDataFrame([(*r, 0, "k") for r in rows + rows[::3]], SCHEMA + ", n long, batch string").withColumnRenamed("n", "key")
    assert ours(df) == brute(rows)


@pytest.mark.parametrize("ranges", [1, 7])
def test_numbers_across_ranges(spark, ranges):
    """Ranks and repeats are those of one sort, however the rows are cut into ranges."""
    rows = made(3, 400, clients=2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = changes.numbered(spark.createDataFrame(rows, SCHEMA), changes.Cut()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    seqs = {c: sorted({r[2] for r in rows if r[1] == c}) for c in range(2)}
    assert all(g.n == seqs[g.client_id].index(g.seq) + 1 for g in got)
    firsts = [g for g in got if not g.again]
    assert len({(g.client_id, g.n, g.batch) for g in got}) == len(firsts) == len({(g.client_id, g.n, g.batch) for g in firsts})
    least = {}
    for g in got:
        k = (g.client_id, g.n, g.batch)
        least[k] = min(least.get(k, (g.day, g.change_id)), (g.day, g.change_id))
    assert all(least[g.client_id, g.n, g.batch] == (g.day, g.change_id) for g in firsts)


def test_empty_table(spark):
    assert ours(spark.createDataFrame([], SCHEMA)) == []
