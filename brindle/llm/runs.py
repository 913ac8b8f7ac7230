"""Maximal periodic runs of words, by the runs theorem.

Each run contains a Lyndon root: a longest Lyndon word, of either order of the
letters, that begins at some place and has the run's period as its length. The
longest Lyndon word at a place ends before the next place with a smaller
suffix, so both sets follow from next smaller values of the inverse suffix
array. A root is extended to both sides by longest common extensions, minima
over ranges of the LCP array, read from a sparse table. Of 2 n roots those that
reach twice their length are the runs.

Several texts are worked on at once, each ended by a letter of its own that is
smaller than all words. Words of different texts are different letters, so that
nothing is found across texts. A run of the length asked for repeats six words,
so a text without two equal stretches of six words has none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import map_arrow

#: Words of a run at least.
LEAST = 12
#: A run of LEAST words repeats so many words at least.
REPEATED = LEAST // 2
#: Words of the texts that are worked on at once, if there are several.
TOGETHER = 200_000
#: Letters compared one by one for all pairs; longer matches go on in growing slices.
STEPS = 24
_MIX = np.random.default_rng(12).integers(1 << 62, size=REPEATED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def suffix_ranks(s: np.ndarray) -> np.ndarray:
    """Rank of each suffix, by prefix doubling of those that are not yet told apart. The last letter must be unique."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    changes = np.flatnonzero(np.diff(s[order], prepend=-1))
    sizes = np.diff(changes, append=n)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(changes, sizes)
    live, k = order[np.repeat(sizes > 1, sizes)], 1
    while live.size:
        old = rank[live]
        key = old * n + rank[live + k]
        by = np.argsort(key, kind="stable")
        live, old, key = live[by], old[by], key[by]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        sizes = np.diff(starts, append=len(key))
        firsts = np.flatnonzero(np.diff(old, prepend=-1))
        first = np.repeat(firsts, np.diff(firsts, append=len(old)))
        rank[live] = old + np.repeat(starts, sizes) - first
        live = live[np.repeat(sizes > 1, sizes)]
        k *= 2
    return rank


def common_prefixes(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at each a and b, which end in different letters."""
    length = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for _ in range(STEPS):
        live = live[s[a[live] + length[live]] == s[b[live] + length[live]]]
        if not live.size:
            return length
        length[live] += 1
    for i in live:
        x, y, step = int(a[i] + length[i]), int(b[i] + length[i]), 64
        while True:
            step = min(step, len(s) - max(x, y))
            differ = s[x : x + step] != s[y : y + step]
            at = int(differ.argmax())
            if differ[at]:
                length[i] = x + at - a[i]
                break
            x, y, step = x + step, y + step, 2 * step
    return length


class Extensions:
    """Longest common extensions: the LCP array and a sparse table of its minima."""

    def __init__(self, s: np.ndarray, rank: np.ndarray) -> None:
        n = len(s)
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        before = order[rank - 1]  # of the least suffix this is no neighbour, and its value is not used
        # if the letters before a suffix and before its neighbour are equal, its value is one less than that of the place before
        led = np.zeros(n, bool)
        led[1:] = (before[1:] > 0) & (s[:-1] == s[before[1:] - 1]) & (rank[1:] > 0)
        own = np.flatnonzero(~led & (rank > 0))
        lengths = np.zeros(n, np.int64)
        lengths[own] = common_prefixes(s, own, before[own])
        last = np.maximum.accumulate(np.where(led, 0, np.arange(n)))
        lengths = lengths[last] - (np.arange(n) - last)
        self.rank, row = rank, np.empty(n, np.int32)
        row[rank] = lengths
        self.table = [row]
        while 2 << (len(self.table) - 1) <= n:
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places i and j that differ."""
        low, high = self.rank[i], self.rank[j]
        low, high = np.minimum(low, high) + 1, np.maximum(low, high)
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.table[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k) + 1])
        return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """The next place with a smaller value; those without one get the place itself."""
    v = values.tolist()
    out = list(range(len(v)))
    open_: list[int] = []
    for i, x in enumerate(v):
        while open_ and v[open_[-1]] > x:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, np.int64)


def runs(texts: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """For each text, given as numbers of words from 0 on, its runs of at least so many words: rows of start, length, period, in order of start and period."""
    d, begins = len(texts), np.cumsum([1, *[len(t) + 1 for t in texts]])
    s = np.zeros(begins[-1], np.int64)
    offset = d + 1
    for i, (t, at) in enumerate(zip(texts, begins, strict=False)):
        s[at : at + len(t)] = t + offset
        s[at + len(t)] = i + 1
        offset += int(t.max()) + 1 if len(t) else 0
    ends = begins[1:] - 1
    word = np.ones(len(s), bool)
    word[0], word[ends] = False, False
    rank = suffix_ranks(s)
    other = np.where(word, offset + d - s, s)
    roots = []
    for r in (rank, suffix_ranks(other)):
        after = next_smaller(r)
        roots.append(np.stack([np.arange(len(s)), after], 1)[word])
    i, j = np.unique(np.concatenate(roots), axis=0).T
    right = Extensions(s, rank).of(i, j)
    back = s[::-1].copy()
    n = len(s)
    left = Extensions(back, suffix_ranks(back)).of(n - i, n - j)  # of the texts before i and before j, read backwards
    period, start, end = j - i, i - left, j + right
    good = (end - start >= 2 * period) & (end - start >= least)
    found = np.unique(np.stack([start, end - start, period], 1)[good], axis=0)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    cut = np.searchsorted(found[:, 0], begins)
    return [found[cut[k] : cut[k + 1]] - [begins[k], 0, 0] for k in range(d)]


def numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def may_run(ids: np.ndarray) -> bool:
    """Whether two stretches of REPEATED words may be equal: equal ones have equal sums."""
    n = len(ids) - REPEATED + 1
    if len(ids) < LEAST:
        return False
    u = ids.astype(np.uint64) + np.uint64(1)
    sums = np.sort(sum((u[k : k + n] * _MIX[k] for k in range(1, REPEATED)), u[:n] * _MIX[0]))
    return bool((sums[1:] == sums[:-1]).any())


def repeated_from(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """In a tenth of the documents, the place from which words repeat, and with which period."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _row(doc_id: int | None, words: list[bytes], found: np.ndarray) -> tuple:
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, found[:, 0] + found[:, 2], 1)
    np.add.at(drop, found[:, 0] + found[:, 1], -1)
    kept = words if not len(found) else [w for w, dropped in zip(words, np.cumsum(drop)[:-1].tolist(), strict=True) if not dropped]
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
    best: tuple = (None,) * 4
    if len(found):
        s, n, p = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist()
        best = s, n, p, 1000 * n // p
    return doc_id, len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


_NONE = np.empty((0, 3), np.int64)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    waiting: list[tuple] = []
    size = 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        words = (text.as_py() or "").encode("utf-8", "replace").split()
        repeat = repeated_from(doc_id, len(words))
        if repeat:
            a, p = repeat
            words = words[:a] + [words[a + i % p] for i in range(len(words) - a)]
        ids = numbers(words)
        if not may_run(ids):
            yield _row(doc_id, words, _NONE)
            continue
        waiting.append((doc_id, words, ids))
        size += len(words)
        if size >= TOGETHER:
            yield from _worked(waiting)
            waiting, size = [], 0
    yield from _worked(waiting)


def _worked(waiting: list[tuple]) -> Iterator[tuple]:
    if waiting:
        for (doc_id, words, _), found in zip(waiting, runs([ids for *_, ids in waiting]), strict=True):
            yield _row(doc_id, words, found)


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        columns = list(zip(*_rows(batch), strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, and checksums of all runs and of the text without repetitions: a row for each row of ``docs``.

    Defined results: a null or empty text has no words and no run; a null
    doc_id counts as an empty text, whose checksum is 0; runs equal in length
    rank by start, then period; repeated rows each get their row; texts are
    worked on whole, with memory that grows with n log n of one text or of
    TOGETHER words; an empty table gives an empty result; other columns are
    ignored.
    """
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _task, SCHEMA)
