import re
import zlib

import corpus_pipeline
from brindle.llm import decontaminate, mixing, sharding, toxicity
from tests.llm.test_simjoin import shingle_set


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append((before, docs))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
    clean, apart, free, mixed, placed = [after for _, after in kept]

    model = toxicity.fit(kept[0][0], spark.read.parquet(f"{sf}/labels.parquet")).start()
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in kept[0][0].collect() if model.score(r.text or "") < toxicity.REJECT_AT)

    # one document of each group, and every group keeps one
    sets = {r.doc_id: shingle_set(r.text, 5) for r in clean.collect()}
    left = {r.doc_id for r in apart.collect()}
    up = {i: i for i in sets}
    root = lambda x: x if up[x] == x else root(up[x])
    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    assert left == {root(i) for i in ids}

    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    known = decontaminate.Items(list(enumerate(items)))
    assert {r.doc_id for r in free.collect()} == {r.doc_id for r in apart.collect() if not known.matches(r.text or "")}

    taken = {r.doc_id: r.taken for r in mixing.mixed(free).collect()}
    count = {}
    for r in mixed.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in count.items() if n}

    rows = placed.collect()
    assert len(rows) == mixed.count()
    crc = {r.doc_id: zlib.crc32((r.text or "").encode()) for r in mixed.collect()}
    assert all(r.text_crc32 == crc[r.doc_id] and 0 <= r.shard < sharding.SHARDS for r in rows)


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert rows and all(sorted(s) == list(range(len(s))) for s in slots.values())


def _through(stage, docs, sf, path):
    stage(docs.sparkSession, docs, sf).write.parquet(str(path))
    return docs.sparkSession.read.parquet(str(path))


def test_odd_rows(odd, odd_rows, sf, tmp_path):
    """What each stage makes of nulls, empty and long texts, repeated rows and clashing columns."""
    at = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id is not None, r.doc_id or 0) for r in df.select("doc_id").collect())
    every = ids(odd)
    clean = _through(at["toxicity"], odd, sf, tmp_path / "1")
    assert clean.columns == odd.columns and ids(clean) == every
    apart = _through(at["near_copies"], clean, sf, tmp_path / "2")
    assert apart.columns == odd.columns
    assert ids(apart) == [(False, 0)] * 2 + [(True, i) for i in (1, 3, 4, 5, 6, 8, 10, 11, 12, 13, 14)]
    free = _through(at["decontamination"], apart, sf, tmp_path / "3")
    assert free.columns == odd.columns and ids(free) == ids(apart)
    mix = _through(at["mixing"], odd, sf, tmp_path / "4")
    assert mix.columns == odd.columns
    # without words nothing is taken, and nothing more than twice
    n = {}
    for r in mix.collect():
        n[(r.doc_id, r.text, r.source)] = n.get((r.doc_id, r.text, r.source), 0) + 1
    rows = {}
    for i, text, _, source in odd_rows:
        rows[(i, text, source)] = rows.get((i, text, source), 0) + 1
    assert all(k in rows and k[1] and k[1].split() and v <= 2 * rows[k] for k, v in n.items())
    placed = _through(at["sharding"], odd, sf, tmp_path / "5")
    assert ids(placed) == every and placed.where("size = 16").count() == sum(not r[1] for r in odd_rows)


def test_empty_table(none, sf, tmp_path):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = _through(stage, none, sf, tmp_path / str(k))
        assert out.count() == 0
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == none.columns
