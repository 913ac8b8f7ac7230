"""Word shingles of whole texts as sorted arrays of 64-bit hashes, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; one longer text is hashed alone.
CHUNK = 1 << 21
_RANDOM = np.random.default_rng(20240229)
BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE, ORDER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of texts laid end to end, and the words before each text.

    raw: bytes; starts: where each text starts, and the end.
    """
    blank = SPACE[raw]
    opens = ~blank
    opens[1:] &= blank[:-1]
    inner = starts[1:-1]
    inner = inner[inner < len(raw)]
    opens[inner] = ~blank[inner]
    at = np.flatnonzero(opens)
    before = np.searchsorted(at, starts)
    if not len(at):
        return np.zeros(0, np.uint64), before
    which = np.cumsum(opens) - 1
    place = np.arange(len(raw)) - at[np.maximum(which, 0)]
    place[which < 0] = 0
    power = np.cumprod(np.full(int(place.max()) + 1, BASE))
    value = BYTE[LOWER[raw]] * power[place]
    value[blank] = 0
    return mix(np.add.reduceat(value, at)), before


def sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles.

    Fewer words than a shingle has count as one shingle of their own length;
    no words, or no text, as none.
    """
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid())
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        b = min(b, len(column))
        hashes, before = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        rolled = hashes.copy()
        for k in range(1, words):
            rolled = rolled[:-1] * ORDER + hashes[k:] if len(rolled) > 1 else rolled[:0]
        rolled = mix(rolled + np.uint64(words))
        for i in range(a, b):
            x, y = int(before[i - a]), int(before[i - a + 1])
            if not valid[i] or x == y:
                yield np.zeros(0, np.uint64)
            elif y - x < words:
                one = hashes[x : x + 1]
                for k in range(x + 1, y):
                    one = one * ORDER + hashes[k : k + 1]
                yield mix(one + np.uint64(y - x))
            else:
                yield np.unique(rolled[x : y - words + 1])
        a = b


def digest(members: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed longs."""
    with np.errstate(over="ignore"):
        first = int(mix(members + np.uint64(0xA5A5)).sum(dtype=np.uint64))
        second = int(np.bitwise_xor.reduce(mix(members ^ np.uint64(0x5DEECE66D)), initial=np.uint64(len(members))))
    return tuple(x - (1 << 64) if x >= 1 << 63 else x for x in (first, second))
