"""WARC archives, and an external merge of their capture index.

Captures are written as gzip members, one WARC record each, through Spark's
text writer, so any store that Spark writes to will do. Payloads equal to one
of a smaller id become revisit records. Reading back, each task checks the
records it reads and leaves capture runs of bounded length, sorted by (URL key,
timestamp, id) and stored in blocks. Key ranges are chosen from the blocks' first
keys, the few blocks that cross a bound are cut there, and each task merges a
range with a loser tree. Spark orders whole blocks only, by their first keys:
that is the order in which the merge needs them, so a task holds one block of
each run, and the Arrow batches that it reads and writes. More than FAN_IN runs are merged level by level,
FAN_IN into one. The ranges are in order, so their merged parts laid end to end
are the globally ordered capture histories.

Defined results: a null payload is empty; a null url has the empty key; any id
has a capture time, the first or last one there is if its own cannot be written;
rows with a null id come first in a history and never have revisits refer to them;
repeated rows are captures of their own, and rows that share the smallest id of
equal payloads are all responses; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import map_arrow, new_path, row_hash, scratch, written

#: Smaller payloads are always stored.
LEAST_SHARED = 100
#: Groups of equal payloads up to this many are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000
#: Page n of a table without capture times was captured n seconds after this.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
FIRST, LAST = datetime(1, 1, 2, tzinfo=UTC), datetime(9999, 12, 30, tzinfo=UTC)
#: Captures of a run, and of a block of a run; runs that a task merges at once: it holds FAN_IN * BLOCK_ROWS captures at most.
RUN_ROWS, BLOCK_ROWS, FAN_IN = 50_000, 100, 64
#: Blocks of an Arrow batch; a run's number is that of its task, then of the run there; a merged run's places are its ranges', then the place there.
BATCH_BLOCKS, TASK_BITS, RANGE_BITS = 50, 24, 36
#: Captures of a key range, expected; small tables have as many ranges as a shuffle has partitions.
RANGE_ROWS = 500_000
#: First keys that the driver sorts to find the bounds of ranges: so many for each, and at most so many.
RANGE_HEADS, MOST_HEADS = 20, 1_000_000
#: An empty gzip member. It ends each record's own member, and cannot occur
#: in stored UTF-8 text, as no character has these first two bytes.
SEPARATOR = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
LATIN = SEPARATOR.decode("latin-1")


def url_key(url: Column) -> Column:
    """Sort-friendly form: host labels reversed, then path and query; scheme, fragment and www left out."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "(?s)#.*$", "")
    host = F.regexp_extract(rest, "^[^/?]*", 0)
    path = F.substr(rest, F.length(host) + 1)
    name = F.regexp_replace(F.lower(host), r"^www[0-9]*\.", "")
    key = F.concat(F.array_join(F.reverse(F.split(name, r"\.")), ","), F.lit(")"), F.when(path == "", F.lit("/")).otherwise(path))
    return F.when(rest == "", F.lit("")).otherwise(key)


def described(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html.cast("binary"), 256).alias("payload_digest"),
    )


def planned(pages: DataFrame) -> DataFrame:
    """Adds refers_to: the least id with an equal payload, where that is another."""
    d = described(pages)
    firsts = d.where(F.col("payload_bytes") >= LEAST_SHARED).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = written(firsts.where("n > 1 and first is not null").select("payload_digest", "payload_bytes", "first"), "firsts")
    if firsts.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        firsts = F.broadcast(firsts)
    other = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))
    return d.join(firsts, ["payload_digest", "payload_bytes"], "left").withColumn("refers_to", other).drop("first")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def captured(page_id: int | None) -> str:
    """Times in the order of the ids; 20 characters for all of them."""
    seconds = min(max(page_id or 0, int((FIRST - EPOCH).total_seconds())), int((LAST - EPOCH).total_seconds()))
    return (EPOCH + timedelta(seconds=seconds)).replace(tzinfo=None).isoformat(timespec="seconds") + "Z"


def record(page_id: int | None, url: str | None, key: str, html: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header alone."""
    when = captured(page_id)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block = http if refers_to is not None else http + html
    clean = lambda s: re.sub(r"[\r\n]", " ", s)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {when}",
        f"WARC-Target-URI: {clean(url or '')}", f"X-URL-Key: {clean(key)}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """A record's fields; its length, and the digest of a stored payload, are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.partition(": ")[::2] for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"malformed record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    ident = lambda s: None if s in (None, "<urn:page:none>") else int(s[10:-1])
    return {
        "page_id": ident(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "url_key": fields["X-URL-Key"], "captured": fields["WARC-Date"], "payload": payload,
        "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": ident(fields.get("WARC-Refers-To")),
    }


def write(pages: DataFrame, path: str) -> None:
    """Archives below ``path``: each file a run of gzip members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                out = []
                for r in b.slice(at, 200).to_pylist():
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = record(r["page_id"], r["url"], r["url_key"], r["html"].encode("utf-8", "replace"), r["payload_digest"], r["refers_to"])
                    out.append(z.compress(raw) + z.flush())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    rows = planned(pages).withColumn("url_key", url_key(F.col("url"))).select("page_id", "url", "url_key", "html", "payload_digest", "refers_to")
    members = map_arrow(rows, run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", LATIN).option("encoding", "ISO-8859-1").text(path)


INDEX = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_FIELDS = [x.split()[0] for x in INDEX.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
_TYPES |= {f"array<{t}>": pa.list_(a) for t, a in _TYPES.items()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def sort_key(row: tuple) -> tuple:
    """Of a row that starts with URL key, timestamp and id."""
    return row[0], row[1], row[2] is not None, row[2] or 0


#: A block is one row: its run, the place of its first capture there, the first and the last key, and its captures by columns.
_KEYS = [f"{end}_{x}" for end in ("first", "last") for x in ("url_key string", "captured string", "page_id long")]
BLOCKS = ", ".join(["run long", "pos long", *_KEYS, "n long", *(f"{x.split()[0]} array<{x.split()[1]}>" for x in INDEX.split(", "))])
_BLOCK = [x.split()[0] for x in BLOCKS.split(", ")]
_HEAD = len(_BLOCK) - len(_FIELDS)


def blocked(run: int, pos: int, rows: list[tuple]) -> Iterator[tuple]:
    """Blocks of neighbouring captures of a run, the first of which has place ``pos`` in it."""
    for at in range(0, len(rows), BLOCK_ROWS):
        block = rows[at : at + BLOCK_ROWS]
        yield run, pos + at, *block[0][:3], *block[-1][:3], len(block), *zip(*block, strict=True)


def captures(block: tuple) -> list[tuple]:
    """A block's captures, each with its run and place."""
    return [(*c, block[0], block[1] + i) for i, c in enumerate(zip(*block[_HEAD:], strict=True))]


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Sorted runs of at most RUN_ROWS captures, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows = TaskContext.get().partitionId() << TASK_BITS, []
        for b in batches:
            for member in b.column("member"):
                if raw := member.as_py():
                    got = parsed(zlib.decompress(raw, 31))
                    rows.append(tuple(got[f] for f in _FIELDS))
                if len(rows) == RUN_ROWS:
                    yield from sent(number, rows)
                    number, rows = number + 1, []
        yield from sent(number, rows)

    def sent(number: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=sort_key)
        for at in range(0, len(rows), BATCH_BLOCKS * BLOCK_ROWS):
            yield _batch(list(blocked(number, at, rows[at : at + BATCH_BLOCKS * BLOCK_ROWS])), BLOCKS)

    members = spark.read.option("lineSep", LATIN).option("encoding", "ISO-8859-1").text(path).select(F.col("value").cast("binary").alias("member"))
    return map_arrow(members, run, BLOCKS)


class LoserTree:
    """Merges sorted iterators: inner nodes hold losers, and only the path of the last winner is replayed."""

    def __init__(self, runs: Iterable[Iterable[tuple]] = (), key: Callable[[tuple], tuple] = sort_key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.size = 1
        while self.size < len(self.runs):
            self.size *= 2
        self.heads = [self._next(i) for i in range(self.size)]
        self.losers = [-1] * self.size
        self.winner = self._play(1)

    def _next(self, i: int) -> tuple[bool, tuple, tuple | None]:
        row = next(self.runs[i], None) if i < len(self.runs) else None
        return (True, (), None) if row is None else (False, self.key(row), row)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return (a[0], a[1], i) < (b[0], b[1], j)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        left, right = self._play(2 * node), self._play(2 * node + 1)
        winner, loser = (left, right) if self._beats(left, right) else (right, left)
        self.losers[node] = loser
        return winner

    def load(self, i: int, rows: Iterable[tuple]) -> None:
        """Gives run i, which has to be at its end or the next new one, more rows, and plays all matches anew."""
        if i == len(self.runs):
            self.runs.append(iter(()))
            if i == self.size:
                self.heads += [(True, (), None)] * self.size
                self.size *= 2
                self.losers = [-1] * self.size
        if not self.heads[i][0]:
            raise ValueError(f"run {i} is not at its end")
        self.runs[i] = iter(rows)
        self.heads[i] = self._next(i)
        self.winner = self._play(1)

    def __iter__(self) -> Iterator[tuple]:
        return self.until(None)

    def until(self, limit: tuple | None) -> Iterator[tuple]:
        """Rows in order, up to the first whose key is not less than ``limit``."""
        while not self.heads[self.winner][0] and (limit is None or self.heads[self.winner][1] < limit):
            i = self.winner
            yield self.heads[i][2]
            self.heads[i] = self._next(i)
            node = (i + self.size) // 2
            while node:
                if self._beats(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def place(row: tuple) -> tuple:
    """Of a capture with its run and place."""
    return *sort_key(row), row[-2], row[-1]


def streamed(blocks: Iterable[tuple]) -> Iterator[tuple]:
    """Merges runs whose blocks come in the order of their first captures' places.

    Everything before the first capture of the next block has arrived and is
    handed on before that block is taken in. So a run's last block is at its end
    when its next one comes, and of each run no more than one block waits.
    """
    tree, leaf = LoserTree(key=place), {}
    for block in blocks:
        rows = captures(block)
        yield from tree.until(place(rows[0]))
        tree.load(leaf.setdefault(block[0], len(leaf)), rows)
    yield from tree


def bounds(blocks: DataFrame, ranges: int) -> list[tuple]:
    """Places that part the captures into about equal ranges, from the first keys of some of the blocks."""
    if ranges < 2:
        return []
    wanted, total = min(RANGE_HEADS * ranges, MOST_HEADS), blocks.count()
    share = min(1 << 62, (1 << 63) * wanted // max(1, total))
    some = blocks if total <= wanted else blocks.where(row_hash("run", "pos") < share)
    heads = sorted(place(tuple(r)) for r in some.select(*_BLOCK[2:5], "run", "pos").collect())
    return sorted({heads[len(heads) * i // ranges] for i in range(1, ranges)}) if heads else []


def level(blocks: DataFrame, runs: int, schema: str, group: Column) -> DataFrame:
    """One level of the merge: the runs of a ``group`` become one, range by range.

    With ``schema`` BLOCKS these are blocks of the longer runs; with HISTORIES,
    which is for one group only, captures with their range and place in it.
    """
    spark = blocks.sparkSession
    groups = -(-runs // FAN_IN)
    total = blocks.agg(F.sum("n")).first()[0] or 0
    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, -(-cores // groups), -(-total // (groups * RANGE_ROWS)))
    shared = spark.sparkContext.broadcast(bounds(blocks, ranges))
    cut_schema = f"range long, {BLOCKS}, group long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = shared.value
        for b in batches:
            out = []
            for at, (r, pos, *ends, n) in enumerate(zip(*(c.to_pylist() for c in b.columns[:_HEAD]), strict=True)):
                low = bisect.bisect_right(limits, place((*ends[:3], r, pos)))
                if low == bisect.bisect_right(limits, place((*ends[3:], r, pos + n - 1))):
                    out.append((low, at, 0, n))
                    continue
                found = [bisect.bisect_right(limits, place(c)) for c in captures(tuple(c[at].as_py() for c in b.columns[:-1]))]
                edges = [0, *(i for i in range(1, n) if found[i] != found[i - 1]), n]
                out += [(found[x], at, x, y) for x, y in itertools.pairwise(edges)]
            whole = [(low, at) for low, at, x, y in out if y - x == b.column("n")[at].as_py()]
            kept = b.take(pa.array([at for _, at in whole], pa.int64()))
            names = [x.split()[0] for x in cut_schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([low for low, _ in whole], pa.int64()), *kept.columns], names)
            parts = []
            for low, at, x, y in out:
                if y - x < b.column("n")[at].as_py():
                    block = tuple(c[at].as_py() for c in b.columns)
                    rows = list(zip(*block[_HEAD:-1], strict=True))[x:y]
                    parts.append((low, *next(blocked(block[0], block[1] + x, rows)), block[-1]))
            if parts:
                yield _batch(parts, cut_schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = (b.slice(at, 10) for b in batches for at in range(0, b.num_rows, 10))
        incoming = (r for b in few for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (group_number, part), of_part in itertools.groupby(incoming, key=lambda r: (r[-1], r[0])):
            at, rows = 0, streamed(r[1:-1] for r in of_part)
            while chunk := [r[:-2] for r in itertools.islice(rows, BATCH_BLOCKS * BLOCK_ROWS)]:
                if schema == BLOCKS:
                    yield _batch(list(blocked(group_number, (part << RANGE_BITS) + at, chunk)), BLOCKS)
                else:
                    yield _batch([(part, at + i, *r) for i, r in enumerate(chunk)], schema)
                at += len(chunk)

    pieces = map_arrow(blocks.withColumn("group", group), cut, cut_schema)
    pieces = pieces.repartitionById(groups * ranges, (F.col("group") * ranges + F.col("range")).cast("int"))
    pieces = pieces.sortWithinPartitions("group", "range", *_BLOCK[2:5], "run", "pos")
    return map_arrow(pieces, merge, schema)


HISTORIES = "part long, at long, " + INDEX


def merged(blocks: DataFrame) -> DataFrame:
    """All captures with ``position``, their place in the global order by (url_key, captured, page_id).

    ``blocks`` are those of ``read_runs``, written. While there are more than
    FAN_IN runs, each FAN_IN of them are merged into one and written.
    """
    # a row for each task that read archives; its runs follow those of the tasks before it
    tasks = blocks.groupBy(F.shiftright("run", TASK_BITS).alias("task")).agg((F.max(F.col("run").bitwiseAND((1 << TASK_BITS) - 1)) + 1).alias("runs"))
    tasks = written(tasks, "tasks")
    runs = tasks.agg(F.sum("runs")).first()[0] or 0
    if runs > FAN_IN:
        before = F.coalesce(F.sum("runs").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = tasks.select("task", before.alias("start"))
        blocks = blocks.withColumn("task", F.shiftright("run", TASK_BITS)).join(F.broadcast(starts), "task")
        blocks = blocks.select((F.col("start") + F.col("run").bitwiseAND((1 << TASK_BITS) - 1)).alias("run"), *_BLOCK[1:])
    while runs > FAN_IN:
        blocks = written(level(blocks, runs, BLOCKS, F.floor(F.col("run") / FAN_IN)), "level")
        runs = -(-runs // FAN_IN)
    out = written(level(blocks, max(1, runs), HISTORIES, F.lit(0).cast("long")), "histories", keep=True)
    # a row for each range
    counts = out.groupBy("part").agg(F.count("*").alias("rows"))
    start = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", start.alias("start"))
    return out.join(F.broadcast(starts), "part").select(*_FIELDS, (F.col("start") + F.col("at")).alias("position"))


def digest(pages: DataFrame) -> DataFrame:
    """Archives written and read back, and their merged index."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    with scratch(spark):
        write(pages, path)
        histories = merged(written(read_runs(spark, path), "runs"))
    return histories.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")
