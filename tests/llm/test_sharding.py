import math
import random
import struct
import zlib
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from brindle.llm import queries, sharding


def spark_hash(doc_id, shard):
    seed = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    return xxhash.xxh64_intdigest(struct.pack("<i", shard), seed)


def brute(doc_id, weights):
    draw = [-math.log(((spark_hash(doc_id, s) >> 11) + 0.5) / 2**53) / w for s, w in enumerate(weights)]
    return min(range(len(weights)), key=lambda s: (draw[s], s))


def check(rows, got, weights, grown):
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 16
    wanted = sorted((i is not None, i or 0, size(t), zlib.crc32((t or "").encode()), brute(i, weights), brute(i, grown)) for i, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == wanted
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, len(weights))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op7_sharding(spark, sf).collect()
    check(rows, got, [1.0] * 40, [1.0] * 41)
    assert {r.law for r in got} == {"key"}
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op7_sharding(spark, sf).collect()))


def test_weights(spark):
    rows = [(i, "x" * (i % 5)) for i in range(3000)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), [1.0, 2.0, 5.0], 2.0).collect()
    check(rows, got, [1.0, 2.0, 5.0], [1.0, 2.0, 5.0, 2.0])
    share = [sum(r.shard == s for r in got) / len(rows) for s in range(3)]
    assert abs(share[0] - 0.125) < 0.03 and abs(share[2] - 0.625) < 0.04


def test_hot_key(spark):
    r = random.Random(0)
    rows = [(7, "same") if r.random() < 0.5 else (i, "t") for i in range(800)]
    check(rows, sharding.shards(spark.createDataFrame(rows, "doc_id long, text string")).collect(), [1.0] * 40, [1.0] * 41)


def test_odd_rows(odd, odd_rows, none):
    check([(i, t) for i, t, *_ in odd_rows], sharding.shards(odd).collect(), [1.0] * 40, [1.0] * 41)
    assert sharding.digest(none).count() == 0


def test_native(odd):
    plan = sharding.digest(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert odd.select(F.lit(1)).count()


def test_one_row_repeated(spark, monkeypatch):
    """A row that stands for very many is numbered in parts; ranges follow the rows."""
    monkeypatch.setattr(sharding, "EXPAND", 100)
    monkeypatch.setattr(sharding, "RANGES", 1)
    monkeypatch.setattr(sharding, "RANGE_ROWS", 5)
    rows = [(1, "same")] * 3000 + [(i, f"text {i}") for i in range(2, 1500)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert len({r.shard for r in got if r.doc_id == 1}) == 1
