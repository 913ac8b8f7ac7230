import hashlib
import re
from collections import defaultdict

import pytest

from brindle.llm import mixing, queries


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, target = 1.5 * sum(sizes.values()), {}
    free = set(order)
    while free:
        level = (want - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
        free -= over
    return target


def brute(rows):
    """rows: (doc_id, text, source) with distinct (id, size) in a source: a row is known by them."""
    docs = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows]
    by = defaultdict(list)
    for d in docs:
        by[d[2]].append(d)
    total = {s: sum(x[1] for x in v) for s, v in by.items()}
    target = brute_targets(total)
    taken = {}
    for s, v in by.items():
        whole = int(target[s] // total[s]) if total[s] else 0
        rest = target[s] - whole * total[s]
        mean, certain = total[s] / len(v) if v else 0, set()
        # documents whose probability would be 1 or more are certain, and the others' are set anew
        while True:
            free = [x for x in v if x not in certain]
            squares = float(sum(x[1] * (x[1] + mean) for x in free))
            factor = (rest - sum(x[1] for x in certain)) / squares if squares else 0
            more = {x for x in free if factor * (x[1] + mean) >= 1}
            if not more:
                break
            certain |= more
        ranked = []
        for i, n, _ in v:
            p = 1 if (i, n, s) in certain else factor * (n + mean)
            u = (int(hashlib.md5(f"{'-' if i is None else i}:{n}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            ranked.append((0.0 if p >= 1 else u * (1 - p) / (u * (1 - p) + (1 - u) * p), i is not None, i or 0, n))
        before = 0
        for _, named, i, n in sorted(ranked):
            once = rest > 0 and n > 0 and before + n / 2 <= rest
            taken[(i if named else None, n, s)] = n * (whole + once)
            before += n
    return target, taken


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    target, taken = brute(rows)
    source = {i: s for i, _, s in rows}
    got = queries.op6_mixing(spark, sf).collect()
    assert len(got) == len(rows)
    words = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.target == pytest.approx(target[s])
        assert r.taken == taken[(r.doc_id, r.size, s)] and r.taken <= 2 * r.size
        words[s] += r.taken
    for s in target:
        longest = max(r.size for r in got if source[r.doc_id] == s)
        assert abs(words[s] - target[s]) <= longest
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op6_mixing(spark, sf).collect()))


def test_many_bins(spark, sf, monkeypatch):
    """The cut does not depend on how ranks are binned."""
    whole = sorted(map(tuple, queries.op6_mixing(spark, sf).collect()))
    monkeypatch.setattr(mixing, "BINS", 7)
    assert sorted(map(tuple, queries.op6_mixing(spark, sf).collect())) == whole
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, queries.op6_mixing(spark, sf).collect())) == whole


def test_odd_rows(odd, odd_rows, none):
    got = mixing.mixed(odd).collect()
    assert len(got) == len(odd_rows)
    assert all(r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size for r in got)
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(words(r.text) for r in out.collect()) == sum(r.taken for r in got)
    assert mixing.mixed(none).count() == 0 and mixing.mix(none).count() == 0


def test_longer_documents_are_likelier(spark):
    rows = [(i, " ".join(["w"] * (10 if i % 2 else 100)), "a") for i in range(600)] + [(1000 + i, " ".join(["w"] * 50), s) for s in "bc" for i in range(1200)]
    got = [r for r in mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    again = {n: [r.taken // r.size for r in got if r.size == n] for n in (10, 100)}
    assert len(set(again[10] + again[100])) <= 2


def test_repeated_rows_meet_the_target(spark):
    """Of very many equal rows as many are taken as the target asks for, whatever their id."""
    for hot in (7, 8):
        rows = [(hot, "w " * 10, "a")] * 2000 + [(100 + i, "w " * (5 + i % 20), "a") for i in range(1000)] + [(at + i, "w " * 10, s) for s, at in (("b", 5000), ("c", 10_000)) for i in range(4000)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = mixing.mixed(docs).collect()
        words, target = defaultdict(int), {}
        source = {i: s for i, _, s in rows}
        for r in got:
            words[source[r.doc_id]] += r.taken
            target[source[r.doc_id]] = r.target
        assert len(got) == len(rows)
        assert all(abs(words[s] - target[s]) <= 13 for s in target)
        out = mixing.mix(docs).collect()
        assert sum(len(r.text.split()) for r in out) == sum(words.values())


def test_expected_words_are_the_wanted_ones(spark):
    """Inclusion probabilities, recomputed after the certain documents, add up to the words wanted."""
    from pyspark.sql import functions as F

    sizes = [1000, 700, 40, 40, 30, 20, 20, 10, 10, 10, 5, 5, 5, 5, 1]
    rows = [(i, n, "a") for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, size long, source string")
    t = spark.createDataFrame([("a", 1700.0, sum(sizes) / len(sizes))], "source string, rest double, mean double")
    made = mixing.factors(t, df.groupBy("source", "size").agg(F.count("*").alias("n"))).first()
    p = [min(1.0, made.factor * (n + made.mean)) for n in sizes]
    assert sum(a * b for a, b in zip(p, sizes, strict=True)) == pytest.approx(1700)
    assert p[0] == 1.0 and p[-1] < p[5] < p[2] < 1


def test_sources_of_any_number(spark):
    """Targets of very many sources are those of the brute-force version."""
    sizes = {f"s{i:04d}": (i * 37) % 101 + 1 for i in range(900)} | {None: 5, "": 9}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
