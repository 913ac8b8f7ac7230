"""Packing against best-fit decreasing of one piece after the other, and against the tokenizer on whole texts."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm import packing


def naive(sizes, capacity):
    """Room left in each sequence."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [(room, i) for i, room in enumerate(rooms) if room >= s]
        if fits:
            rooms[min(fits)[1]] -= s
        else:
            rooms.append(capacity - s)
    return Counter(rooms)


def unpacked(counts, capacity):
    """Every piece's place: (sequence, offset, size)."""
    plan = packing.best_fit(counts, capacity)
    out = []
    for size, n in counts.items():
        rows = plan[plan[:, 0] == size]
        for j in range(n):
            _, first, per, sequence, offset = rows[np.searchsorted(rows[:, 1], j, side="right") - 1]
            out.append((int(sequence + (j - first) // per), int(offset + (j - first) % per * size), size))
    return sorted(out)


def gapless(places):
    at = {}
    for sequence, offset, size in places:
        assert offset == at.get(sequence, 0)
        at[sequence] = offset + size
    return at


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_is_that_of_single_pieces(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 2, 7, 8, 31, 100, 257])
    counts = {r.randrange(1, capacity + 1): r.choice([1, 2, 3, 40]) for _ in range(r.randrange(1, 30))}
    filled = gapless(unpacked(counts, capacity))
    assert sorted(filled) == list(range(len(filled)))
    assert Counter(capacity - x for x in filled.values()) == naive([s for s, n in counts.items() for _ in range(n)], capacity)


def test_tightest_room():
    r = random.Random(3)
    rooms, have = packing.Rooms(100), Counter()
    for _ in range(2000):
        if r.random() < 0.5:
            room = r.randrange(1, 101)
            rooms.put(room, 0, 1)
            have[room] += 1
        size = r.randrange(1, 101)
        want = min((x for x in have if have[x] and x >= size), default=None)
        assert rooms.tightest(size) == want
        if want and r.random() < 0.8:
            rooms.take(want)
            have[want] -= 1


TOKENIZER = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
TOKENIZER.encode_special_tokens = True


def whole(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_ids_by_words_are_those_of_the_text():
    ids = packing.encoder(public_tokenizers.path(packing.TOKENIZER))
    r = random.Random(1)
    odd = ["a", "B", "é", "é", "́", " ", "  ", "\n", "\t\x0b\x0c\r", "\x1c", "\x85", "\xa0", " ", "　", " ", "'s", "'", "1", "²", "Σ", "ΑΣ", "İ", "ß", "日本", "😀", "<|endoftext|>", "<|startoftext|", "!?", "ﬁ", "가", "\x00"]
    for _ in range(500):
        text = "".join(r.choice(odd) for _ in range(r.randrange(0, 30)))
        assert np.frombuffer(ids(text), "<u4").tolist() == whole(text)


def check(rows, texts, capacity):
    """rows: tuples of a result; texts: (doc_id, text) with repetitions."""
    want = Counter()
    for doc_id, text in texts:
        ids = [*whole(text), 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            want[doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r[:5]) for r in rows) == want
    filled = gapless(sorted((r[5], r[6], r[3]) for r in rows))
    assert Counter(capacity - x for x in filled.values()) == naive([r[3] for r in rows], capacity)


def test_table(spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_ROWS", 7)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check([tuple(r) for r in packing.digest(docs).collect()], [tuple(r) for r in docs.select("doc_id", "text").collect()], 4096)


def test_odd_rows_and_sequences(spark, odd, odd_rows, none):
    texts = [r[:2] for r in odd_rows]
    check([tuple(r) for r in packing.packed(odd, capacity=300).collect()], texts, 300)
    got = packing.sequences(odd, capacity=300).collect()
    assert sorted(sum(([d, n] for r in got for d, n in zip(r.doc_ids, r.lengths, strict=True)), []), key=repr) == sorted(
        sum(([r[0], r[3]] for r in packing.packed(odd, capacity=300).collect()), []), key=repr
    )
    assert all(len(r.ids) == sum(r.lengths) <= 300 for r in got)
    ids = {(d, tuple(r.ids[sum(r.lengths[:k]) : sum(r.lengths[: k + 1])])) for r in got for k, d in enumerate(r.doc_ids)}
    assert {(t[0], (*whole(t[1]), 1)) for t in texts if len(whole(t[1])) < 300} <= ids
    assert packing.digest(none).count() == 0 and packing.digest(none).columns == packing.digest(odd).columns


def test_few_sequences(spark, sf01):
    """Hardly more than all ids would fill."""
    out = packing.digest(spark.read.parquet(f"{sf01}/documents.parquet"))
    r = out.agg(F.sum("length").alias("ids"), F.count_distinct("sequence_id").alias("n")).first()
    assert r.n <= -(-r.ids // 4096) + 1
