"""Best-fit packing of documents into sequences of tokens.

Pieces are packed from the longest to the shortest, each into the open sequence
in which the least room is left that still takes it; a segment tree over the
remaining capacities finds that room in logarithmic time. All that the packing
depends on is how many pieces have each length, so it runs over these counts,
of which there are no more than the capacity, whatever the corpus: sequences
with the same room and neighbouring numbers are one interval, and as many
pieces as fill them go in at once, in the places that one after the other would
get. The outcome says which pieces of a length, by number, go to which
sequences; the pieces look it up in their tasks.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import map_arrow, scratch, written

CAPACITY, END_ID = 4096, 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces of a length that are numbered together, on average.
RANGE_ROWS = 100_000
#: Words, about, whose ids a worker remembers.
REMEMBERED = 1_000_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Rooms:
    """Open sequences by the room that is left: intervals of numbers, and a segment tree that counts them."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.width)
        self.intervals: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _count(self, room: int, by: int) -> None:
        at = room + self.width
        while at:
            self.tree[at] += by
            at //= 2

    def put(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.intervals[room].append((first, n))
            self._count(room, 1)

    def take(self, room: int) -> tuple[int, int]:
        self._count(room, -1)
        return self.intervals[room].pop()

    def tightest(self, size: int) -> int | None:
        """The least room of at least this size: up to the first subtree to the right that has one, then down its left side."""
        at = size + self.width
        if not self.tree[at]:
            while at > 1 and (at % 2 or not self.tree[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.width


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows of (size, first, per, sequence, offset), by size and first.

    The pieces of a size from number ``first`` up to the next row's go to
    sequences from ``sequence`` on, ``per`` to each, from ``offset`` on.
    """
    rooms, out, opened = Rooms(capacity), [], 0
    for size in sorted(counts, reverse=True):
        first, left = 0, counts[size]
        while left:
            room = rooms.tightest(size)
            if room is None:
                room, sequence, n = capacity, opened, -(-left // (capacity // size))
                opened += n
            else:
                sequence, n = rooms.take(room)
            per = room // size
            full = min(n, left // per)
            if full:
                out.append((size, first, per, sequence, capacity - room))
                rooms.put(room - per * size, sequence, full)
                first, left = first + full * per, left - full * per
            if full < n:
                some = 0
                if left:  # too few to fill one more
                    out.append((size, first, per, sequence + full, capacity - room))
                    rooms.put(room - left * size, sequence + full, 1)
                    some, left = 1, 0
                rooms.put(room, sequence + full + some, n - full - some)
    return np.array(sorted(out), np.int64).reshape(-1, 5)


#: Words of these characters alone have no white space and no marks to be put together, and letters here have one lower case each.
PLAIN = regex.compile(r"[!-~\u00a1-\u012f\u0131-\u017f]+")
#: Fixed value: how the tokenizer cuts its text.
CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it shows, or else the next from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], bytes]:
    """Ids of a text as little-endian 32-bit numbers.

    Every pattern of the tokenizer ends at white space and its normalizers work
    within words, so the ids of a text are those of its words (split at ASCII
    white space), which are remembered, by all tasks of a worker. Plain words
    are cut here and their parts go to the tokenizer's model, others go through
    the whole tokenizer.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings within a text are text
    model, letter = tokenizer.model, byte_letters()
    words: dict[bytes, bytes] = {}
    parts: dict[str, bytes] = {}
    packed = lambda ids: struct.pack(f"<{len(ids)}I", *ids)

    def of_part(part: str) -> bytes:
        out = parts.get(part)
        if out is None:
            spelled = part if part.isascii() else "".join([letter[b] for b in part.encode()])
            out = parts[part] = packed([t.id for t in model.tokenize(spelled)])
        return out

    def of_word(word: bytes) -> bytes:
        text = word.decode()
        if PLAIN.fullmatch(text):
            return b"".join([of_part(p) for p in CUT.findall(text.lower())])
        return packed(tokenizer.encode(text, add_special_tokens=False).ids)

    def ids(text: str) -> bytes:
        out = []
        if len(words) > REMEMBERED:
            words.clear()
            parts.clear()
        for w in text.encode("utf-8", "replace").split():
            known = words.get(w)
            if known is None:
                known = words[w] = of_word(w)
            out.append(known)
        return b"".join(out)

    return ids


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and with ``keep_ids`` ids: the pieces of each row of ``docs``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    end = np.array([END_ID], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part)[: 5 + keep_ids])
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
            columns = list(zip(*rows, strict=True)) or [()] * (5 + keep_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=False)], list(kinds)[: 5 + keep_ids])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), task, PIECE + (", ids binary" if keep_ids else ""))


def placed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts``, read several times, with sequence_id and offset.

    The pieces of a length are numbered within ranges of a hash, as many as the
    length has pieces, and each range starts after those before it. The table
    of starts has a row for each length and for every RANGE_ROWS pieces.
    """
    # at most ``capacity`` lengths, whatever the corpus
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit(counts, capacity)
    if not counts:
        return parts.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    most = F.array(*[F.lit(-(-counts.get(k, 0) // RANGE_ROWS) or 1) for k in range(capacity + 1)])
    rows = parts.withColumn("range", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(most, F.col("length").cast("int"))).cast("int"))
    earlier = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("length", "range").agg(F.count("*").alias("n"))
    starts = starts.select("length", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    here = Window.partitionBy("length", "range").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.withColumn("number", F.row_number().over(here)).join(F.broadcast(starts), ["length", "range"])
    rows = rows.select(*parts.columns, (F.col("ahead") + F.col("number") - 1).alias("number"))

    # the number of a piece of any size is below this
    step = max(counts.values()) + 1
    keys = plan[:, 0] * step + plan[:, 1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            _, first, per, sequence, offset = plan[np.searchsorted(keys, size * step + number, side="right") - 1].T
            at = batch.schema.get_field_index("number")
            batch = batch.set_column(at, "sequence_id", pa.array(sequence + (number - first) // per))
            yield batch.append_column("offset", pa.array(offset + (number - first) % per * size))

    kinds = ", ".join(f"`{n}` {k}" for n, k in parts.dtypes)
    return map_arrow(rows, task, f"{kinds}, sequence_id long, offset long")


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece.

    Defined results: a null or empty text has the end id alone; a null doc_id
    is kept; a text of more than ``capacity`` ids, its end included, is cut
    into pieces of that many, the last may be shorter; repeated rows each have
    their pieces; pieces of one length take their places in an order of hashes;
    long texts are read whole; an empty table gives an empty result; other
    columns are ignored.
    """
    with scratch(docs.sparkSession):
        return placed(written(pieces(docs, path, capacity), "pieces", keep=True), capacity)


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids (array of int), doc_ids, lengths: the packed sequences themselves, their documents in order of place."""
    with scratch(docs.sparkSession):
        parts = pieces(docs, path, capacity, keep_ids=True).withColumn("row", F.monotonically_increasing_id())
        parts = written(parts, "pieces", keep=True)
        places = placed(parts.drop("ids"), capacity).select("row", "sequence_id", "offset")
        rows = parts.join(places, "row")
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    rows = rows.groupBy("sequence_id").agg(inside.alias("inside"))
    # hex of little-endian numbers, eight digits each
    hexed = F.array_join(F.transform("inside", lambda x: F.hex(x["ids"])), "")
    number = lambda i: F.conv(F.concat(*[F.substr(hexed, i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)]), 16, 10).cast("int")
    ids = F.transform(F.sequence(F.lit(0), (F.length(hexed) / 8).cast("int") - 1), number)
    return rows.select("sequence_id", ids.alias("ids"), F.transform("inside", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("inside", lambda x: x["length"]).alias("lengths"))


def digest(docs: DataFrame) -> DataFrame:
    return packed(docs)
