"""Counts under choices, positions, edits, totals by level, sketches, multisets, search and the ledger against plain versions."""

import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.operators import aggregates, browse, search
from brindle.operators.filters import FacetSpec
from brindle.sources import ledger

ITEMS = "id int, kind string, brand string, size int, ready boolean"


def items(seed=1, n=80):
    r = random.Random(seed)
    return [(i, r.choice([None, "a", "b", "c"]), r.choice([None, "x", "y"]), r.choice([None, 1, 5, 9]), r.choice([None, True, False])) for i in range(n)]


@pytest.mark.parametrize("kinds, brands, required", list(itertools.product(([], ["a"], ["a", "c"]), ([], ["x"]), ((), ("ready",)))))
def test_counts_under_the_other_choices(spark, kinds, brands, required):
    spec = FacetSpec({"kind": kinds, "brand": brands}, required=required, bounds={"size": 5})
    got = Counter({(r.facet, r.option): r.n for r in browse.option_counts_chosen(spark.createDataFrame(items(), ITEMS), spec, ["kind", "brand"]).collect()})
    want = Counter()
    for _, kind, brand, size, ready in items():
        if (size is None or size <= 5) and (ready or not required):
            if not brands or brand in brands:
                want["kind", kind] += 1
            if not kinds or kind in kinds:
                want["brand", brand] += 1
    assert got == want


@pytest.mark.parametrize("ranges", ["1", "5"])
def test_positions(spark, ranges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        out = browse.placed(spark.createDataFrame(items(), ITEMS), [F.col("size"), F.col("kind")], "id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    key = lambda r: (r[3] is not None, r[3], r[1] is not None, r[1], r[0])
    assert [r.id for r in sorted(out, key=lambda r: r.position)] == [r[0] for r in sorted(items(), key=key)]
    assert sorted(r.position for r in out) == list(range(1, 81))


def test_edits(spark):
    """To null, several of a row, ties, a key without a row, a null key."""
    rows = spark.createDataFrame([(i, f"n{i}", i) for i in range(6)] + [(None, "none", 0)], "id int, name string, n int")
    edits = [
        (0, 1, "a", None, None), (0, 2, None, 7, None), (1, 1, "first", None, None), (1, 2, "second", None, None), (2, 1, None, None, ["name", "n"]), (3, 1, None, None, ["n"]), (3, 2, None, 9, None),
        (4, 1, "x", 1, None), (4, 2, None, None, ["name"]), (9, 1, "gone", 1, None), (None, 1, "null", 1, None), (5, 1, "tie a", None, ["n"]), (5, 1, "tie b", 3, None),
    ]
    e = spark.createDataFrame(edits, "id int, at int, name string, n int, cleared array<string>")
    got = {r.id: (r.name, r.n) for r in browse.edited(rows, e, "id", ["name", "n"], order="at", clear="cleared").collect()}
    assert got == {0: ("a", 7), 1: ("second", 1), 2: (None, None), 3: ("n3", 9), 4: (None, 1), 5: ("tie b", 3), None: ("none", 0)}
    assert browse.edited(rows, e, "id", ["n"]).count() == 7


def test_levels_tell_nulls_of_data_from_those_of_the_level(spark):
    df = spark.createDataFrame(items(), ITEMS)
    got = {(r.kind, r.brand, r.level): r.n for r in aggregates.by_levels(df, ["kind", "brand"], aggregates.cube_sets(["kind", "brand"]), n=F.count("*")).collect()}
    want = Counter()
    for _, kind, brand, *_ in items():
        for level, row in enumerate([(kind, brand), (kind, None), (None, brand), (None, None)]):
            want[*row, level] += 1
    assert got == want and (None, None, 0) in got and (None, None, 3) in got
    assert aggregates.rollup_sets(["a", "b"]) == [[], ["a"], ["a", "b"]]


def test_sketches_of_days_merge(spark):
    df = spark.range(40_000).select((F.col("id") % 10).alias("day"), (F.xxhash64("id") % 9000).alias("user"), F.col("id").cast("double").alias("v"))
    daily = aggregates.sketched(df, ["day"], {"users": "user"}, {"q": "v"})
    some = aggregates.merged(daily.where("day < 7"), [], ["users"], ["q"])
    shown = some.select("n", F.hll_sketch_estimate("users").alias("users"), aggregates.quantile_of("q", 0.25).alias("low")).first()
    exact = df.where("day < 7").agg(F.count_distinct("user")).first()[0]
    assert shown.n == 28_000 and abs(shown.users - exact) < 0.05 * exact and abs(shown.low - 10_000) < 0.03 * 40_000
    assert daily.agg(F.max(F.length("q"))).first()[0] < 20_000


def test_multisets(spark):
    r = random.Random(2)
    left, right = ([(r.choice([None, 1, 2]), r.choice([None, "a", "b"])) for _ in range(n)] for n in (60, 40))
    a, b = (spark.createDataFrame(x, "n int, s string") for x in (left, right))
    count = lambda df: Counter(map(tuple, df.collect()))
    x, y = Counter(left), Counter(right)
    assert count(aggregates.multiset(a, b, "both")) == x & y == count(a.intersectAll(b))
    assert count(aggregates.multiset(a, b, "rest")) == x - y == count(a.exceptAll(b))
    moved = count(aggregates.multiset(a, b, "moved"))
    assert moved == Counter({(*k, "left"): n for k, n in (x - y).items()}) + Counter({(*k, "right"): n for k, n in (y - x).items()})


TEXTS = [(1, "Red clay tile, red"), (2, "red brick"), (3, "Tile tile TILE blue"), (4, None), (5, ""), (6, "Rédaction über alles"), (7, "red " * 50)]


def test_ranked_search(spark, tmp_path):
    index = search.write_index(spark.createDataFrame(TEXTS, "id long, body string"), "id", "body", f"file://{tmp_path}/index")
    docs = {i: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for i, t in TEXTS}
    mean = sum(map(len, docs.values())) / len(docs)
    words = ["RED", "tile", "absent"]
    want = {}
    for i, d in docs.items():
        for w in ("red", "tile"):
            n, has = d.count(w), sum(w in x for x in docs.values())
            if n:
                idf = math.log(1 + (len(docs) - has + 0.5) / (has + 0.5))
                want[i] = want.get(i, 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(d) / mean))
    found = search.ranked(index, words)
    assert {r.doc: pytest.approx(r.score) for r in found.collect()} == want
    best = sorted(want, key=lambda i: (-want[i], i))[:2]
    top = search.ranked(index, words, 2)
    assert [r.doc for r in top.collect()] == best
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "PartitionFilters: [shard" in plan.replace("isnotnull(shard", "shard") and "In(term" in plan
    assert [tuple(r) for r in search.suggested(index, "R", 5).collect()] == [("red", 3), ("rédaction", 1)]
    assert search.ranked(index, []).count() == 0


def test_a_batch_replayed_after_a_failure_is_there_once(spark, tmp_path):
    out, source = f"file://{tmp_path}/out", f"{tmp_path}/in"
    assert ledger.committed(spark, out, "id long").count() == 0
    rows = lambda a, b: spark.range(a, b)
    rows(0, 10).write.parquet(f"{source}/1")
    stream = lambda: spark.readStream.schema("id long").option("recursiveFileLookup", "true").parquet(source)

    def fail():
        raise RuntimeError("between")

    def feed(between=lambda: None):
        query = ledger.write_stream(stream(), out, f"file://{tmp_path}/checkpoint", between)
        try:
            query.awaitTermination()
        finally:
            query.stop()

    ids = lambda: sorted(r.id for r in ledger.committed(spark, out, "id long").collect())
    with pytest.raises(Exception, match="between"):
        feed(fail)
    assert ids() == []  # rows lie there, but no entry
    feed()
    assert ids() == list(range(10))
    rows(10, 15).write.parquet(f"{source}/2")
    with pytest.raises(Exception, match="between"):
        feed(fail)
    assert ids() == list(range(10))
    feed()
    feed()
    assert ids() == list(range(15))
    # a batch that was entered is not written again, even with other rows
    ledger.write_batch(rows(100, 200), 0, out)
    assert ids() == list(range(15))


def test_an_index_reads_each_text_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def count(text):
        read.add(1)
        return text

    docs = spark.createDataFrame([(0, "a b a"), (1, ""), (2, None), (3, "b c, d")], "id long, text string")
    index = search.write_index(docs.withColumn("text", F.udf(count, "string")("text")), "id", "text", f"file://{tmp_path}/once")
    assert read.value == 4
    assert [tuple(r) for r in index.whole.collect()] == [(4, 1.5)]
