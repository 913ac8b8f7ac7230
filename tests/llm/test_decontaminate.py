import random

import numpy as np

from brindle.llm import decontaminate, queries


def folded(text):
    return "".join(map(chr, decontaminate.normal(text)[0]))


def distance(item, text):
    """Least edit distance of the whole item to any part of the text."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, d in enumerate(text, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d))
        row = new
    return int(row.min())


def budget(item):
    m = len(item)
    return max(0, min(int(decontaminate.EDITS * m), (m - decontaminate.Q) // decontaminate.Q))


def test_whole_table(spark, sf):
    """Every item that occurs in a document without case and punctuation is found."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    wanted = {(d.doc_id, b.item_id) for d in docs for b in items if folded(b.text) in folded(d.text)}
    rows = queries.op3_decontamination(spark, sf).collect()
    text, item = {d.doc_id: d.text for d in docs}, {b.item_id: folded(b.text) for b in items}
    assert wanted and wanted <= {(r.doc_id, r.item_id) for r in rows}
    for r in rows:
        part = folded(text[r.doc_id][r.start : r.end])
        assert (part == item[r.item_id]) == (r.edits == 0)
        assert r.edits <= budget(item[r.item_id])


def test_edits_within_the_budget_are_found():
    r = random.Random(7)
    letters = "abcdefghij "
    make = lambda n: " ".join("".join(r.choice(letters[:10]) for _ in range(r.randint(1, 8))) for _ in range(n))
    items = [(i, make(r.choice([2, 5, 12, 25]))) for i in range(12)]
    known = decontaminate.Items(items)
    for _ in range(60):
        i, text = r.choice(items)
        chars = list(folded(text))
        for _ in range(r.randint(0, budget(folded(text)) + 2)):
            at = r.randrange(len(chars))
            chars[at : at + r.choice([0, 1])] = [r.choice("abcxyz")] * r.choice([0, 1])
        doc = make(8) + " " + "".join(chars) + " " + make(8)
        near = distance(folded(text), folded(doc))
        found = [m for m in known.matches(doc) if m[0] == i]
        assert bool(found) == (near <= budget(folded(text)))
        if found:
            assert min(m[3] for m in found) == near


def test_short_items_and_case():
    known = decontaminate.Items([(1, "Ab, c!"), (2, ""), (3, None), (4, "...")])
    assert [m[:3] for m in known.matches("xx AB C yy ab-c")] == [(1, 3, 7), (1, 11, 15)]
    assert known.matches("") == [] and known.matches("a b c") == []


def test_blocks_of_items(spark, sf, monkeypatch):
    key = lambda rows: sorted(tuple(r) for r in rows)
    whole = key(queries.op3_decontamination(spark, sf).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 3000)
    assert key(queries.op3_decontamination(spark, sf).collect()) == whole


def test_odd_rows(spark, odd, odd_rows, none):
    items = spark.createDataFrame([(1, odd_rows[0][1]), (2, None), (3, ""), (None, "日本 😀 alpha beta gamma delta never said here")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd, items).collect()}
    assert found == {(1, 1), (2, 1), (None, 1), (14, 1)}
    kept = decontaminate.without_leaks(odd, items)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13]
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(odd, items.limit(0)).count() == 0
    assert decontaminate.without_leaks(odd, items.limit(0)).count() == len(odd_rows)


def test_slices_change_nothing(monkeypatch):
    """Counting in small slices of positions finds the same bands, also where common q-grams hit very often."""
    r = random.Random(8)
    words = ["alpha", "beta", "gamma", "the the the", "of of"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([3, 9, 40])))) for i in range(15)] + [(99, "word " * 60)]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([5, 80, 300]))) for _ in range(25)] + ["word " * 400]
    known = decontaminate.Items(items)
    whole = [known.bands(decontaminate.normal(t)[0]) for t in texts]
    assert any(whole)
    monkeypatch.setattr(decontaminate, "SLICE_HITS", 50)
    assert [known.bands(decontaminate.normal(t)[0]) for t in texts] == whole
    monkeypatch.setattr(decontaminate, "SLICE_CHARS", 37)
    assert [known.bands(decontaminate.normal(t)[0]) for t in texts] == whole


def test_common_grams_take_little_memory():
    import tracemalloc

    known = decontaminate.Items([(1, "word " * 198)])
    code = decontaminate.normal("word " * 20_000)[0]
    tracemalloc.start()
    assert known.bands(code)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20


def test_blocks_of_the_filter(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(r.doc_id for r in decontaminate.without_leaks(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 4000)
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, items).collect()) == whole


def test_whole_table_with_edits(spark, sf):
    """Against brute force on a whole small table: the pairs found are those within an item's edit budget."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 900").limit(40).collect()
    items = [b for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:12]
    r = random.Random(5)
    rows = []
    for d in docs:
        text = folded(d.text)
        if r.random() < 0.6:
            chars = list(folded(r.choice(items).text))
            for _ in range(r.randint(0, 12)):
                chars[r.randrange(len(chars))] = r.choice("xyz")
            text += " " + "".join(chars)
        rows.append((d.doc_id, text))
    found = {(x.doc_id, x.item_id) for x in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items)).collect()}
    near = {(i, b.item_id) for i, t in rows for b in items if distance(folded(b.text), folded(t)) <= budget(folded(b.text))}
    assert near and found == near
