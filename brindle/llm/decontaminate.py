"""Benchmark decontamination by q-gram lemma filtering.

A text within e edits of an item of m characters shares at least
m - q + 1 - q * e of its q-grams with it, all on diagonals that differ by at
most e. Shared q-grams are counted in overlapping bands of diagonals; bands
that meet the bound are verified by banded alignment of the whole item.

Texts are compared without case, and with every run of characters other than
letters and digits as one space. Items are the queries: the driver reads them
block by block, each of bounded size, and each block is matched with all
documents before the next one is read. Shared q-grams of a text are counted in
bounded slices of its positions; a band's count is complete, and let go, once
the positions have passed the end of its item.

Defined results: null and empty texts, and items without letters or digits,
match nothing; an item too short for q-grams must occur exactly; repeated rows
each get their matches; a null id is kept; very long texts are matched whole;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import drop_written, map_arrow, written

Q, EDITS = 10, 0.06
#: Characters of the items that are held by a task at once.
BLOCK_CHARS = 4_000_000
BITS = 22
#: Shared q-grams that are counted at once, and characters of a text that are hashed at once.
SLICE_HITS, SLICE_CHARS = 1_000_000, 1_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FOLD: list[np.ndarray] = []


def _tables() -> np.ndarray:
    """For each code point of the basic plane its folded form, or 0 if it is no letter or digit."""
    if not _FOLD:
        fold = np.zeros(1 << 16, np.uint32)
        for i in range(1 << 16):
            if (c := chr(i)).isalnum():
                fold[i] = ord(x) if len(x := c.lower()) == 1 else i
        _FOLD.append(fold)
    return _FOLD[0]


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points with single spaces (as 32), and the position of each in the text."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    folded = np.where(code < 1 << 16, _tables()[code & 0xFFFF], code)
    keep = folded > 0
    after = np.zeros(len(keep), bool)
    after[1:] = keep[:-1]
    at = np.flatnonzero(keep | after)
    out = folded[at]
    out[out == 0] = 32
    if len(out) and out[-1] == 32:
        out, at = out[:-1], at[:-1]
    return out, at


def grams(code: np.ndarray) -> np.ndarray:
    """Hash of each q-gram, by doubling."""
    if len(code) < Q:
        return np.zeros(0, np.uint64)
    span, width, power, out, done = code.astype(np.uint64) + np.uint64(1), 1, MULTIPLIER, None, 0
    left = Q
    while left:
        if left & 1:
            out = span.copy() if out is None else out[: len(span) - done] * power + span[done:] if done else span
            done += width
        left >>= 1
        if left:
            span = span[:-width] * power + span[width:]
            width *= 2
            power = np.uint64(int(power) ** 2 % (1 << 64))
    out = out[: len(code) - Q + 1]
    return out ^ (out >> np.uint64(29))


class Items:
    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids, self.code, self.edits, self.short = [], [], [], []
        hashes, which, place = [], [], []
        for item_id, text in items:
            code = normal(text or "")[0]
            m = len(code)
            if not m:
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.code.append(code)
            # as many edits as leave a q-gram to find
            self.edits.append(max(0, min(int(EDITS * m), (m - Q) // Q)))
            if m < Q:
                self.short.append(k)
                continue
            h = grams(code)
            hashes.append(h)
            which.append(np.full(len(h), k))
            place.append(np.arange(len(h)))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        hashes, which, place = cat(hashes, np.uint64), cat(which, np.int64), cat(place, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.which, self.place = hashes[order], which[order], place[order]
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[(self.hashes * MULTIPLIER) >> np.uint64(64 - BITS)] = True
        self.edit = np.array(self.edits, np.int64)
        self.length = np.array([len(c) for c in self.code], np.int64)

    def _shared(self, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions whose q-gram an item has, with the range of its places in ``hashes``: in slices with a bounded number of hits."""
        for start in range(0, len(code) - Q + 1, SLICE_CHARS):
            h = grams(code[start : start + SLICE_CHARS + Q - 1])
            at = np.flatnonzero(self.seen[(h * MULTIPLIER) >> np.uint64(64 - BITS)])
            low, high = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            some = high > low
            at, low, high = at[some] + start, low[some], high[some]
            if len(at):
                cuts = np.flatnonzero(np.diff(np.cumsum(high - low) // SLICE_HITS)) + 1
                yield from zip(*(np.split(x, cuts) for x in (at, low, high)), strict=True)

    def bands(self, code: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) of each band with enough shared q-grams."""
        if not len(self.hashes):
            return []
        # one number for (item, band), bands counted from the least that can occur
        lowest = -int(self.length.max()) - 2
        span = len(code) - lowest + 2
        keys, counts, out = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def first_of(keys: np.ndarray) -> np.ndarray:
            return (keys % span + lowest) * (self.edit[keys // span] + 1)

        def close(keys: np.ndarray, counts: np.ndarray) -> None:
            k = keys // span
            for x in keys[counts >= np.maximum(1, self.length[k] - Q + 1 - Q * self.edit[k])].tolist():
                first = int(first_of(np.array([x]))[0])
                out.append((x // span, first, first + 2 * self.edits[x // span]))

        for at, low, high in self._shared(code):
            n = high - low
            hit = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            item = self.which[hit]
            diagonal = np.repeat(at, n) - self.place[hit]
            e = self.edit[item]
            # bands start every e + 1 diagonals and are 2e + 1 wide: any e + 1 neighbours lie in one
            band = diagonal // (e + 1)
            again = (diagonal - band * (e + 1) < e) & (e > 0)
            key = item * span + band - lowest
            found, count = np.unique(np.concatenate([key, key[again] - 1]), return_counts=True)
            if len(keys):
                every, back = np.unique(np.concatenate([keys, found]), return_inverse=True)
                total = np.bincount(back, weights=np.concatenate([counts, count]), minlength=len(every)).astype(np.int64)
            else:
                every, total = found, count
            k = every // span
            passed = first_of(every) + 2 * self.edit[k] + self.length[k] <= at[-1]
            close(every[passed], total[passed])
            keys, counts = every[~passed], total[~passed]
        close(keys, counts)
        return sorted(out)

    def matches(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item_id, start, end, edits) in code points of ``text``, end exclusive."""
        code, at = normal(text)
        best: dict[int, list[tuple[int, int, int]]] = {}
        for k, first, last in self.bands(code):
            got = aligned(self.code[k], code, first, last, self.edits[k])
            if got:
                best.setdefault(k, []).append(got)
        for k in self.short:
            item, n = self.code[k], len(self.code[k])
            starts = np.flatnonzero(code[: len(code) - n + 1] == item[0]) if len(code) >= n else ()
            best.setdefault(k, []).extend((0, int(s), int(s) + n) for s in starts if np.array_equal(code[s : s + n], item))
        out = []
        for k, found in best.items():
            taken: list[tuple[int, int]] = []
            for edits, a, b in sorted(found):
                if b > a and all(b <= x or a >= y for x, y in taken):
                    taken.append((a, b))
                    out.append((self.ids[k], int(at[a]), int(at[b - 1]) + 1, edits))
        return out


def _band(item: np.ndarray, text: np.ndarray, first: int, last: int, free: bool) -> tuple[np.ndarray, int]:
    """Edit distances of the item to text ending on each diagonal of the band.

    free: the match may start on any diagonal; else it starts on diagonal 0.
    """
    width, big = last - first + 1, 1 << 20
    steps = np.arange(width)
    diagonals = first + steps
    row = np.where((diagonals >= 0) & (diagonals <= len(text)), 0 if free else np.abs(diagonals), big)
    padded = np.concatenate([text, [0]]).astype(np.int64)
    for i, c in enumerate(item):
        j = i + diagonals  # the text's character in this step
        inside = (j >= 0) & (j < len(text))
        same = padded[np.where(inside, j, len(text))] == c
        now = np.where(inside, row + ~same, big)
        now[:-1] = np.minimum(now[:-1], row[1:] + 1)
        end = j + 1
        now = np.where((end >= 0) & (end <= len(text)), now, big)
        row = np.minimum.accumulate(now - steps) + steps
    return row, first


def aligned(item: np.ndarray, text: np.ndarray, first: int, last: int, edits: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best match whose path stays near the band, if within ``edits``."""
    for d in range(max(0, first), min(last, len(text) - len(item)) + 1):
        if np.array_equal(text[d : d + len(item)], item):
            return 0, d, d + len(item)
    if not edits:
        return None
    row, low = _band(item, text, first - edits, last + edits, True)
    k = int(row.argmin())
    if row[k] > edits:
        return None
    end = len(item) + low + k
    # the start, by aligning backwards from the end
    back, low = _band(item[::-1], text[:end][::-1], -edits, edits, False)
    length = len(item) + low + int(back.argmin())
    return int(row[k]), end - length, end


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    block, held = [], 0
    for r in benchmark.select("item_id", "text").where("length(text) > 0").toLocalIterator():
        if block and held + len(r.text) > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((r.item_id, r.text))
        held += len(r.text)
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, edits: a row for each occurrence of an item in a document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, start long, end long, edits long"
    out = None
    for block, alone in _with_alone(blocks(benchmark)):

        def run(batches: Iterator[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            items = Items(block)
            for b in batches:
                rows = [(d, *m) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True) if t.is_valid for m in items.matches(t.as_py())]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in schema.split(", ")])

        part = map_arrow(docs, run, schema)
        # of several blocks each is done before the next one is read, so that none waits in a plan
        part = part if alone else written(part, "leaks", keep=True)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, whose text holds no item."""
    columns, schema = docs.columns, docs.schema
    earlier = None
    for block, alone in _with_alone(blocks(benchmark)):

        def run(batches: Iterator[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            items, at = Items(block), columns.index("text")
            for b in batches:
                yield b.filter(pa.array([not t.is_valid or not items.matches(t.as_py()) for t in b.column(at)], pa.bool_()))

        docs = map_arrow(docs, run, schema)
        if not alone:
            docs = written(docs, "clean", keep=True)
            if earlier is not None:
                drop_written(earlier)
            earlier = docs
    return docs


def _with_alone(found: Iterator[list]) -> Iterator[tuple[list, bool]]:
    """Each block, and whether it is the only one."""
    first, second = next(found, None), next(found, None)
    if first is not None:
        yield first, second is None
    while second is not None:
        yield second, False
        second = next(found, None)
