"""Runs of words against a brute-force version: every period, every stretch."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from brindle.llm import runs


def brute(words, least=12):
    """Stretches of the smallest period that no neighbour extends."""
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            # words i to j + q have period q
            if j + q - i >= max(least, 2 * q) and all(words[k] != words[k + p] for p in range(1, q) if q % p == 0 for k in [next((k for k in range(i, j + q - p) if words[k] != words[k + p]), i)]):
                out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = [w for w in (text or "").encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)).split(b" ") if w]
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(found), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4),
        sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


@pytest.mark.parametrize("seed", range(12))
def test_runs_of_small_alphabets(seed):
    r = random.Random(seed)
    texts = []
    for _ in range(60):
        word = [r.randrange(r.choice([1, 2, 3, 4])) for _ in range(r.randrange(0, 40))]
        if word and r.random() < 0.6:
            k = r.randrange(len(word))
            word = word[:k] + (word[k:] or [0]) * r.randrange(1, 5) + word[: r.randrange(len(word))]
        texts.append(word)
    for least in (2, 12):
        got = runs.runs([np.array(t, np.int64) for t in texts], least)
        assert [list(map(tuple, g.tolist())) for g in got] == [brute(t, least) for t in texts]


def test_known_words():
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 2000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for text in (fibonacci[-1][:600], "a" * 300, "ab" * 200 + "a", ("a" * 30 + "b") * 12, "abcdefgh" * 40):
        (got,) = runs.runs([runs.numbers(list(text))], 2)
        assert list(map(tuple, got.tolist())) == brute(text, 2)


def test_no_text_with_runs_is_passed_over():
    r = random.Random(9)
    for _ in range(400):
        root = [r.randrange(50) for _ in range(r.randrange(1, 12))]
        text = [r.randrange(50) for _ in range(20)] + (root * 12)[: max(12, 2 * len(root))] + [r.randrange(50) for _ in range(20)]
        assert brute(text) and runs.may_run(np.array(text))


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 6000")
    rows = docs.select("doc_id", "text").collect()
    got = sorted(map(tuple, runs.digest(docs).collect()))
    want = sorted(expected(r.doc_id, r.text) for r in rows)
    assert got == want and any(w[1] for w in want)


def test_odd_rows(spark, odd, odd_rows, none):
    got = sorted((tuple(r) for r in runs.digest(odd).collect()), key=repr)
    short = [expected(r[0], r[1]) for r in odd_rows if len(r[1] or "") < 20_000]
    assert not set(short) - set(got) and len(got) == len(odd_rows)
    assert sum(t[0] in (6, 7) for t in got) == 2
    assert runs.digest(none).count() == 0


def test_long_texts_together_and_alone(spark, monkeypatch):
    """Texts longer than what is worked on at once, one of them a single run."""
    r = random.Random(4)
    texts = [(1, "x " * 30_000), (2, " ".join(str(r.randrange(9)) for _ in range(30_000))), (3, "a b c " * 9_000 + "end")]
    words = [t.split() for _, t in texts]
    one = [runs.runs([runs.numbers(w)])[0].tolist() for w in words]
    assert one == [f.tolist() for f in runs.runs([runs.numbers(w) for w in words])]
    assert one[0] == [[0, 30_000, 1]] and one[2] == [[0, 27_000, 3]]
    assert runs.digest(spark.createDataFrame(texts, "doc_id long, text string")).count() == 3
