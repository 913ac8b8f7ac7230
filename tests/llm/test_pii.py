import hashlib
import random
import re

import numpy as np
import pytest

from brindle.llm import pii, queries

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


@pytest.fixture(scope="module")
def tagger(spark, sf):
    return pii.fit(spark.read.parquet(f"{sf}/documents.parquet"))


def test_whole_table(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op10_pii(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        base = brute(rows[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(",") if r.spans else [])


def test_base_spans_of_random_texts():
    r = random.Random(1)
    parts = ["a", "@", "@b.c", ".", "-", "+", "1", "255", "256", ".1.2.3", "4111111111111111", " ", "(", "é", "%", "0", "+49 (30) 12345", "😀"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert sorted(brute(text)) == sorted(pii.base_spans(text)), text


def test_gradient():
    t, r = pii.Tagger(), np.random.default_rng(0)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    ids, tags = r.integers(0, pii.VOCABULARY, (3, 8)), r.integers(0, pii.TAGS, (3, 8))
    _, g = t.loss(ids, tags)
    for k in t.p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        t.p[k][i] += 1e-3
        up, _ = t.loss(ids, tags)
        t.p[k][i] -= 2e-3
        down, _ = t.loss(ids, tags)
        t.p[k][i] += 1e-3
        assert g[k][i] == pytest.approx((up - down) / 2e-3, rel=1e-2, abs=1e-3)


def test_viterbi_is_best():
    import itertools

    t, r = pii.Tagger(), np.random.default_rng(2)
    t.p["move"] = r.normal(0, 1, (pii.TAGS, pii.TAGS)).astype(np.float32)
    ids = r.integers(1, pii.VOCABULARY, (4, 5))
    emit, _ = t.run(ids)
    best = t.decode(ids)
    for b in range(4):
        value = lambda path, b=b: sum(emit[i, b, k] for i, k in enumerate(path)) + sum(t.p["move"][x, y] for x, y in itertools.pairwise(path))
        assert value(best[b]) == pytest.approx(max(value(p) for p in itertools.product(range(pii.TAGS), repeat=5)), rel=1e-4)


def test_held_out_spans(spark, sf01, tagger):
    """The network by itself finds what the patterns find in documents that it was not trained on, and little else."""
    texts = [r.text for r in spark.read.parquet(f"{sf01}/documents.parquet").select("text").collect()]
    base, found = [pii.base_spans(t) for t in texts], pii.tag_spans(tagger, texts)
    wanted = sum(map(len, base))
    assert sum(len(set(a) & set(b)) for a, b in zip(base, found, strict=True)) >= 0.9 * wanted
    assert sum(len(set(b) - set(a)) for a, b in zip(base, found, strict=True)) <= 0.1 * wanted


def test_spans_do_not_depend_on_place(tagger):
    """Windows are reconciled: a span is found wherever it falls among them."""
    filler = "the onha eror inthe wasan " * 40
    hits = 0
    for at in range(0, 260, 7):
        text = filler[:at] + " +1 (583) 555-8469 " + filler
        hits += ("phone", at + 1, at + 18) in pii.tag_spans(tagger, [text])[0]
    assert hits >= 34


def test_odd_rows(odd, odd_rows, none):
    rows = pii.digest(odd).collect()
    assert len(rows) == len(odd_rows)
    assert all(r.spans == "" for r in rows)
    assert pii.digest(none).count() == 0


def test_left_out_windows_change_nothing(spark, sf01, tagger):
    """Spans are those of decoding every window, on whole tables and where runs are longer than windows."""
    texts = [r.text for r in spark.read.parquet(f"{sf01}/documents.parquet").select("text").collect()]
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz.-_") for _ in range(n))
    for _ in range(300):
        parts = [word(r.randint(1, 9)) for _ in range(r.randint(0, 60))]
        parts.insert(r.randrange(len(parts) + 1), r.choice([word(r.randint(30, 400)) + "@" + word(r.randint(30, 300)) + ".com", "+1 " + "(555) 123-4567 " * r.randint(1, 20), "1.2.3.4" * r.randint(1, 40)]))
        texts.append(" ".join(parts))
    texts += ["a" * 5000 + "@" + "b" * 5000 + ".org", "1" * 700, "@", "", "é" * 64 + "@" + "é" * 63, "x" * 128 + "7", "7" + "x" * 128]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        assert pii.tag_spans(tagger, part) == pii.tag_spans(tagger, part, everything=True)


def test_added_spans_of_the_whole_table(spark, sf, tagger):
    """The query's spans are the base ones and, of all windows' spans, those that touch none of them."""
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    every = dict(zip(rows, pii.tag_spans(tagger, list(rows.values()), everything=True), strict=True))
    for r in queries.op10_pii(spark, sf).collect():
        base = brute(rows[r.doc_id])
        added = [s for s in every[r.doc_id] if all(s[2] <= a or s[1] >= b for _, a, b in base)]
        assert r.spans == pii.joined(base + added)


def test_training_reads_whole_texts(spark):
    """Words far from a text's start are trained on as well."""
    docs = spark.createDataFrame([(i, "x" * 20_000 + f" call +1 (583) 555-84{i:02d} now" * 200) for i in range(20)], "doc_id long, text string")
    seen = []
    whole = pii.labelled
    pii.labelled = lambda texts, *a: seen.extend(texts) or whole(["no words"], 8)
    try:
        pii.fit(docs)
    finally:
        pii.labelled = whole
    assert any("call" in t for t in seen) and any("xxx" in t for t in seen)


def _planted(spark, sf01, make, n=150, seed=41):
    """Texts of documents with one string set among their words, and its place."""
    r = random.Random(seed)
    texts = [x.text for x in spark.read.parquet(f"{sf01}/documents.parquet").where("length(text) > 300 and doc_id >= 500").collect()]
    out = []
    for _ in range(n):
        text = r.choice(texts)
        at = r.choice([m.end() for m in re.finditer(" ", text)])
        piece = make(r)
        out.append((text[:at] + piece + " " + text[at:], at, at + len(piece)))
    return out


def test_forms_that_no_pattern_has(spark, sf01, tagger):
    d = pii._digits
    forms = [
        lambda r: f"({d(r, 3)}) {d(r, 3)}-{d(r, 4)}", lambda r: f"{d(r, 3)}-{d(r, 3)}-{d(r, 4)}", lambda r: f"{d(r, 3)}.{d(r, 3)}.{d(r, 4)}",
        lambda r: f"0{d(r, 3)} {d(r, 7)}", lambda r: f"0{d(r, 2)} {d(r, 8)}",
    ]
    shares = []
    for make in forms:
        rows = _planted(spark, sf01, make)
        found = pii.tag_spans(tagger, [x[0] for x in rows])
        shares.append(sum(("phone", a, b) in f for f, (_, a, b) in zip(found, rows, strict=True)) / len(rows))
    assert min(shares) >= 0.6 and sum(shares) / len(shares) >= 0.85, shares


def test_numbers_that_are_nobodys(spark, sf01, tagger):
    d = pii._digits
    day = lambda r: f"20{r.randint(10, 29)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"
    forms = [
        lambda r: f"978-3-16-{d(r, 6)}-{d(r, 1)}", lambda r: f"978-{d(r, 1)}-{d(r, 4)}-{d(r, 4)}-{d(r, 1)}", lambda r: f"{d(r, 1)}-{d(r, 3)}-{d(r, 5)}-{d(r, 1)}", day,
        lambda r: f"{day(r)} - {day(r)}", lambda r: f"{d(r, 3)}-{d(r, 7)}-{d(r, 7)}", lambda r: f"INV-2023-{d(r, 6)}",
    ]
    shares = []
    for make in forms:
        rows = _planted(spark, sf01, make)
        found = pii.tag_spans(tagger, [x[0] for x in rows])
        shares.append(sum(any(x < b and y > a for _, x, y in f) for f, (_, a, b) in zip(found, rows, strict=True)) / len(rows))
    assert max(shares) <= 0.12 and sum(shares) / len(shares) <= 0.04, shares


def test_dates_are_no_phone_numbers():
    for piece in ("2020-01-02", "2020-01-02 - 2021-03-04", "1998-2004"):
        assert not pii.plausible("phone", piece)
    for piece in ("555-010-2020", "020 7946 0123", "(020) 1234567"):
        assert pii.plausible("phone", piece)
