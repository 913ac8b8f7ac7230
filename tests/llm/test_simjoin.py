import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import components, shingles, simjoin


def shingle_set(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, percent):
    """Least id reachable, by comparing all pairs."""
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    named = [x for x in sets if x[0] is not None and x[1]]
    for a, (i, s) in enumerate(named):
        for j, t in named[:a]:
            if 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), None if i is None else root(i) if s or any(n == i for n, _ in named) else i) for i, s in sets)


def got(df, k, percent):
    key = lambda x: tuple((v is not None, v) for v in x)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in simjoin.similar(df, k, percent).collect()), key=key)


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_against_all_pairs(spark, sf, k, percent):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert got(df, k, percent) == brute([tuple(r) for r in df.collect()], k, percent)


def near_copies(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(6):
        base = [r.choice(words) for _ in range(r.choice([5, 9, 14, 40, 120, 300]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4, 8])):
                at = r.randrange(len(copy))
                copy[at : at + r.choice([0, 1])] = [r.choice(words)] * r.choice([0, 1, 1])
                copy = copy or ["w0"]
            rows.append((len(rows), r.choice([" ", "\n", "  "]).join(copy)))
    return rows


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
@pytest.mark.parametrize("block", [2_000_000, 150])
def test_near_copies(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(simjoin, "BLOCK", block)
    rows = near_copies()
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), k, percent) == brute(rows, k, percent)


def test_odd_rows(odd, odd_rows):
    mine = got(odd, 4, 85)
    named = [r for r in mine if r[0] is not None]
    assert sorted(set(named)) == sorted(set(x for x in brute([(i, t) for i, t, *_ in odd_rows if i is not None], 4, 85)))
    assert len(mine) == len(odd_rows)
    assert [r[2] for r in mine if r[0] is None] == [None, None]


def test_one_of_each(odd, odd_rows):
    kept = simjoin.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 8, 10, 11, 12, 13, 14]
    assert ids.count(None) == 2


def test_empty(none):
    assert simjoin.similar(none).count() == 0
    assert simjoin.one_of_each(none).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_reachable_sets_share_a_signature(percent):
    r = np.random.default_rng(0)
    for n in (1, 2, 5, 7, 9, 13, 21, 34, 60, 111, 250, 700):
        for _ in range(25):
            a = np.unique(r.integers(1, 1 << 62, n, dtype=np.uint64))
            b, extra = a, []
            while True:
                drop, add = b[:-1] if r.random() < 0.6 and len(b) > 1 else b, [*extra, *r.integers(1, 1 << 62, int(r.integers(0, 2)), dtype=np.uint64).tolist()]
                if 100 * len(drop) < percent * (len(a) + len(add)):
                    break
                b, extra = r.permutation(drop), add
            other = np.unique(np.concatenate([b, np.array(extra, np.uint64)]))
            if not np.array_equal(a, other):
                for share in (0, 0.3, 1):  # whatever is taken for common
                    table = simjoin.table_of(a[: int(share * len(a))])
                    assert len(np.intersect1d(simjoin.signatures(a, percent, table), simjoin.signatures(other, percent, table)))


def test_bands_touch():
    for percent in (80, 85, 95):
        for size in range(1, 3000):
            number, low, high = simjoin.band_of(size, percent)
            assert low <= size <= high
            assert simjoin.band_of(size * 100 // percent, percent)[0] <= number + 1


def test_shingles_are_whole_words():
    texts = ["A b  c\td", "a B c D", "", None, "a", "a b c d e", "é É", " a b c d "]
    got = [list(x) for x in shingles.sets(pa.array(texts), 4)]
    assert got[0] == got[1] == got[7] and got[2] == got[3] == []
    assert [len(x) for x in got] == [len(shingle_set(t, 4)) for t in texts]
    sliced = [list(x) for x in shingles.sets(pa.array(texts).slice(4, 3), 4)]
    assert sliced == got[4:7]


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)]
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    out = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in out} == {x: root(x) for x in up} and len(out) == len(up)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_plan_has_no_pairs(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    plan = simjoin.similar(df, 4, 85)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert F is not None


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_links_across_blocks_and_size_classes(spark, monkeypatch, k, percent):
    """Prefixes of one text, each linked with its neighbours only, in a component that is split."""
    monkeypatch.setattr(simjoin, "BLOCK", 150)
    words = [f"w{i}" for i in range(400)]
    sizes = [20]
    while sizes[-1] < 380:
        sizes.append(min(int((sizes[-1] - k + 1) * 100 / percent) + k - 1, sizes[-1] + 9))
    rows = [(i, " ".join(words[:n])) for i, n in enumerate(sizes)]
    wanted = brute(rows, k, percent)
    assert {c for _, _, c in wanted} == {0}
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), k, percent) == wanted


@pytest.mark.parametrize("block", [2_000_000, 150])
def test_texts_of_one_id(spark, monkeypatch, block):
    """Each text of an id is compared in its own size class, and all of them are one document."""
    monkeypatch.setattr(simjoin, "BLOCK", block)
    text = lambda name, n, end="": " ".join(f"{name}{i}" for i in range(n)) + end
    rows = [(0, text("a", 40)), (0, text("b", 300)), (0, text("c", 120)), (9, text("a", 40, " x")), (8, text("b", 300, " x")), (7, text("c", 120, " x"))]
    rows += [(20, text("d", 30)), (21, text("e", 60)), (22, text("f", 90)), (23, text("d", 30)), (23, text("e", 60)), (23, text("f", 90))]
    wanted = brute(rows, 5, 80)
    assert {c for _, _, c in wanted} == {0, 20}
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80) == wanted


def test_hot_signatures(spark, monkeypatch):
    """One large group of near copies: only a task's head of a hot signature is shuffled, and no link is lost."""
    monkeypatch.setattr(simjoin, "HOT", 5)
    r = random.Random(21)
    words = [f"w{i}" for i in range(300)]
    base = [r.choice(words) for _ in range(200)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(len(copy))] = r.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(r.choice(words) for _ in range(120))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sample = simjoin._sample(df)
    common = simjoin._common(sample, 4)
    hot = simjoin._hot(sample, 4, 85, common)
    assert len(hot)
    signed = simjoin._signed(df, 4, 85, common, hot)
    most = max(x.n for x in signed.where("head is null").groupBy("sig").agg(F.countDistinct("doc_id").alias("n")).collect())
    before = max(x.n for x in simjoin._signed(df, 4, 85, common, hot[:0]).groupBy("sig").agg(F.countDistinct("doc_id").alias("n")).collect())
    assert before > 20 and most <= max(4, simjoin.HOT)
    assert got(df, 4, 85) == brute(rows, 4, 85)


def test_large_group_meets_once(spark, monkeypatch):
    """Members of a large component's largest group do not meet again in the second round."""
    monkeypatch.setattr(simjoin, "BLOCK", 4000)
    seen = []
    whole = simjoin._links
    monkeypatch.setattr(simjoin, "_links", lambda docs, blocks, *a: seen.append(blocks.groupBy("doc_id").count().agg(F.count("*"), F.max("count")).first()) or whole(docs, blocks, *a))
    r = random.Random(22)
    words = [f"w{i}" for i in range(300)]
    base = [r.choice(words) for _ in range(200)]
    rows = []
    for i in range(300):
        copy = list(base)
        for _ in range(r.randint(0, 3)):
            copy[r.randrange(len(copy))] = r.choice(words)
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, 5, 80) == brute(rows, 5, 80)
    # nobody is left outside, so the second round has no meetings
    assert len(seen) == 2 and seen[1][0] == 0


def test_hubs_and_hot_keys(spark, monkeypatch):
    from brindle.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    edges = [(5, i) for i in range(6, 200)] + [(i, 300) for i in range(200, 290)] + [(150, 250), (400, 401)]
    out = {x.node: x.label for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[x] for x in range(5, 290)} == {5} and out[300] == 5 and out[401] == 400
    rows = [(i, "same words in each of them", ) for i in range(60)] + [(100 + i, "") for i in range(20)] + [(200, "other words here and there")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85) == brute(rows, 4, 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_unrelated_sets_from_any_end_of_a_band_share_no_signature(percent):
    """Else documents of one size are candidates of each other, in a component that grows with the table."""
    r = np.random.default_rng(5)
    for n in (400, 3400, 5298):
        found = [np.unique(simjoin.signatures(np.unique(r.integers(1, 1 << 62, n, dtype=np.uint64)), percent)) for _ in range(30)]
        assert np.unique(np.concatenate(found), return_counts=True)[1].max() == 1


@pytest.mark.parametrize("percent", [80, 85])
def test_a_set_and_the_largest_it_reaches_share_a_signature(percent):
    """At the limit of similarity, where the smaller one has the most groups to spare."""
    r = np.random.default_rng(6)
    for n in [*range(4, 120), *range(120, 700, 23)]:
        b = np.unique(r.integers(1, 1 << 62, n * 100 // percent, dtype=np.uint64))
        a = np.sort(r.permutation(b)[:n])
        for share in (0, 0.5) if len(a) < len(b) else ():
            table = simjoin.table_of(a[: int(share * n)])
            assert len(np.intersect1d(simjoin.signatures(a, percent, table), simjoin.signatures(b, percent, table)))


def test_shuffle_files_go_with_their_query(spark):
    files = lambda: set(re.findall(r"/shuffle_([0-9]+)_", spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    before = files()
    simjoin.similar(spark.createDataFrame(near_copies(), "doc_id long, text string"))
    until = time.monotonic() + 10  # they are removed in the background
    while len(left := files() - before) > 1 and time.monotonic() < until:
        time.sleep(0.2)
    assert len(left) <= 1  # that of one sum, taken for the lazy result
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
