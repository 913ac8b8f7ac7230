"""Changes applied in the order of their numbers, by event-time timers.

The changes of each client are numbered by the dense rank of their sequence
number. They arrive in batches by day; a change is held until all numbers
before it have been applied, and when a held change has waited for ``wait``
days of the watermark the missing numbers are given up.

The stream: the batches lie in a folder each, and a stateful query is started
anew for each of them on one checkpoint. Its watermark is the largest day minus
the wait. ``transformWithState`` holds the changes and registers a timer at the
earliest held day; Spark calls back in the batch without data that follows the
one that moved the watermark, and the callback jumps the gaps. What it applies
so belongs to the start of the following batch, whose number it tells from the
watermark. A last, far later row fires the timer of the end, which every key
registers.

A key of the state is a group of some CLIENTS clients, not a single one: the
state is read and written once for a group instead of several times for each
client. A change whose number has come before in the same batch is rejected
whatever the state is, so it is sent to any key. Such changes are most of those
of a client with very many, and are marked by a sort over ranges of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from brindle.llm.common import new_path, scratch, shipped, written

#: Columns of a change; other columns are ignored.
COLUMNS = ("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance")
#: Clients of a key of the state, on average, and the least number of keys.
CLIENTS, KEYS = 256, 64
DAY_MS = 86_400_000
#: Days are moved by so many, as the first watermark is 0 and timers before it would fire at once. The last row comes at END.
SHIFT, END = 1_000_000, 4_000_000
#: State stores that can hold timers; those of earlier starts are let go soon, and take no disk before they have data. A batch adds
#: what it changed, in one file for each store, without a second one for its checksum: the checkpoint serves one call.
STORES = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.maintenanceInterval": "2s",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
}
OUTPUT = "change_id long, client_id long, status string, batch int, missed long, city string, balance double, current boolean"
_CLIENT = "client_id long, next long, city string, balance double, change_id long, batch int, missed long, op string"
_HELD = "client_id long, n long, change_id long, day long, op string, city string, balance double"


@dataclass(frozen=True)
class Cut:
    """How days are cut into batches, and how long held changes wait."""

    first_day: int = 19723
    days: int = 160
    batches: int = 8
    wait: int = 5

    def batch(self, day: int) -> int:
        return max(1, min(self.batches, 1 + (day - self.first_day) * self.batches // self.days))

    def batch_column(self, day: Any) -> Any:
        number = F.floor((day - self.first_day) * self.batches / F.lit(self.days)) + 1
        return F.greatest(F.lit(1), F.least(F.lit(self.batches), number)).cast("int")


class Client:
    """A client's next number and values, and its last applied change, which is given out when another follows or at the end."""

    def __init__(self, client_id: int | None, next_: int = 1, city: str | None = None, balance: float | None = None, *last: Any) -> None:
        self.id, self.next, self.city, self.balance = client_id, next_, city, balance
        self.last = last if last and last[1] is not None else None

    def stored(self) -> tuple:
        return (self.id, self.next, self.city, self.balance, *(self.last or (None,) * 4))

    def given_out(self, final: bool = False) -> Iterator[Row]:
        if self.last is not None:
            change_id, batch, missed, op = self.last
            yield Row(change_id=change_id, client_id=self.id, status="applied", batch=batch, missed=missed, city=self.city, balance=self.balance, current=final and op != "D")

    def apply(self, held: dict[int, tuple], batch: int) -> Iterator[Row]:
        """Applies held changes as long as they have the next number."""
        while self.next in held:
            yield from self._apply(held.pop(self.next), batch, 0)

    def jump(self, held: dict[int, tuple], batch: int) -> Iterator[Row]:
        """Gives up the numbers before the smallest held one."""
        n = min(held)
        missed, self.next = n - self.next, n
        yield from self._apply(held.pop(n), batch, missed)
        yield from self.apply(held, batch)

    def _apply(self, change: tuple, batch: int, missed: int) -> Iterator[Row]:
        yield from self.given_out()
        change_id, _, op, city, balance = change
        if op == "I" or op == "D":
            self.city, self.balance = (city, balance) if op == "I" else (None, None)
        elif op == "U":
            self.city = self.city if city is None else city
            self.balance = self.balance if balance is None else balance
        self.last = (change_id, batch, missed, op)
        self.next += 1


class Applier(StatefulProcessor):
    def __init__(self, cut: Cut) -> None:
        self.cut = cut

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clients = handle.getListState("clients", _CLIENT)
        self.held = handle.getListState("held", _HELD)

    def _load(self) -> tuple[dict[int | None, Client], dict[int | None, dict[int, tuple]]]:
        clients = {row[0]: Client(*row) for row in self.clients.get()} if self.clients.exists() else {}
        held: dict[int | None, dict[int, tuple]] = {}
        if self.held.exists():
            for client_id, n, *change in self.held.get():
                held.setdefault(client_id, {})[n] = tuple(change)
        return clients, held

    def _store(self, clients: dict[int | None, Client], held: dict[int | None, dict[int, tuple]]) -> None:
        self.clients.put([c.stored() for c in clients.values()])
        rows = [(k, n, *change) for k, of in held.items() for n, change in of.items()]
        self.held.put(rows) if rows else self.held.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rows:
            self.handle.registerTimer(self._timer(min(row[3] for row in rows)))
        self.handle.registerTimer(self._timer(END))

    @staticmethod
    def _timer(day: int) -> int:
        """Just before the day: whether a timer fires at the watermark or before it, this one does when the day is reached."""
        return (day + SHIFT) * DAY_MS - 1

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # loaded with the first change that needs it: a key of the last row, or with rejected changes only, has no state
        clients = held = None
        touched: dict[int | None, int] = {}
        for r in rows:
            if r.n is None:
                continue
            if not r.again:
                if clients is None:
                    clients, held = self._load()
                client = clients.setdefault(r.client_id, Client(r.client_id))
                of = held.setdefault(r.client_id, {})
                if r.n >= client.next and r.n not in of:
                    of[r.n] = (r.change_id, r.day, r.op, r.city, r.balance)
                    touched[r.client_id] = r.batch
                    continue
            yield Row(change_id=r.change_id, client_id=r.client_id, status="rejected", batch=r.batch, missed=0, city=None, balance=None, current=False)
        for k, batch in touched.items():
            yield from clients[k].apply(held[k], batch)
        if clients is not None:
            self._store(clients, held)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        reached = timerValues.getCurrentWatermarkInMs() // DAY_MS - SHIFT
        end = reached >= END
        batch = self.cut.batch(reached + self.cut.wait) + 1
        clients, held = self._load()
        for k, of in held.items():
            while of and (end or min(change[1] for change in of.values()) <= reached):
                yield from clients[k].jump(of, batch)
        if not end:
            self._store(clients, held)
            return
        for client in clients.values():
            yield from client.given_out(final=True)
        self.clients.clear()
        self.held.clear()


def numbered(changes: DataFrame, cut: Cut) -> DataFrame:
    """Distinct changes that take part: n, day, batch, key, and whether their number has come before in the batch.

    Rows are dealt out by ranges of their order, so that no client is one task,
    and ranked within a range. What stands before a range is added: a client
    that begins before a range is the only one to need it, so that the table of
    it has at most one row for each range, and is broadcast.
    """
    h = F.crc32(F.coalesce(F.col("change_id").cast("string"), F.lit("")).cast("binary"))
    rows = changes.select(*COLUMNS).distinct().withColumn("h", h)
    rows = rows.withColumn("day", (F.unix_date(F.to_date("valid_at")) + 2 * (F.col("h") % 4)).cast("long"))
    rows = rows.withColumn("batch", F.when((F.col("h") % 11 != 0) & F.col("day").isNotNull(), cut.batch_column(F.col("day"))))
    order = ["seq", "day", "change_id", "op", "valid_at", "city", "balance", "source", "segment"]
    keep = ["client_id", *order[:4], "city", "balance", "batch"]
    ranges = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(ranges, "client_id", *order).select(*rows.drop("h").columns, F.spark_partition_id().alias("range"))
    rows = written(rows, "changes")

    last = F.when(F.col("batch").isNotNull(), F.struct("seq", "batch"))
    seqs = rows.groupBy("client_id", "range", "seq").agg(F.max(last).alias("last"))
    spans = seqs.groupBy("client_id", "range").agg(F.count("*").alias("seqs"), F.min(F.struct("seq")).alias("least"), F.max(F.struct("seq")).alias("most"), F.max("last").alias("last"))
    along = Window.partitionBy("client_id").orderBy("range")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    shared = (F.col("least") == F.lag("most").over(along)).cast("long")
    spans = spans.withColumn("shared", F.coalesce(shared, F.lit(0)))
    spans = spans.withColumn("ahead", F.sum(F.col("seqs") - F.col("shared")).over(earlier) - F.col("shared")).withColumn("before", F.max("last").over(earlier))
    spans = spans.where("ahead is not null").select(F.col("client_id").alias("_client"), F.col("range").alias("_range"), "ahead", "before")

    here = Window.partitionBy("range", "client_id").orderBy(*order)
    rows = rows.withColumn("new", F.coalesce((~F.struct("seq").eqNullSafe(F.lag(F.struct("seq")).over(here))).cast("long"), F.lit(1)))
    rows = rows.withColumn("n", F.sum("new").over(here)).withColumn("prior", F.max(last).over(here.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.where("batch is not null")
    rows = rows.join(F.broadcast(spans), F.col("client_id").eqNullSafe(F.col("_client")) & (F.col("range") == F.col("_range")), "left")
    again = F.coalesce(F.col("prior"), F.col("before")).eqNullSafe(F.struct("seq", "batch"))
    rows = rows.withColumn("n", F.col("n") + F.coalesce("ahead", F.lit(0))).withColumn("again", again)
    return rows.select(*keep, "n", "again")


def applied(changes: DataFrame, cut: Cut = Cut()) -> DataFrame:
    """change_id, client_id, status, batch, missed, city, balance, current: a row for each distinct change that takes part.

    Defined results: changes with a null valid_at, or a checksum of the id that
    is a multiple of 11, take no part, but their sequence numbers count in the
    ranks. A null change_id counts as an empty text, whose checksum is 0. A null
    client_id is a client, a null seq the first number. Days before the first
    go to the first batch. Rows equal in all columns of COLUMNS are one; of rows
    equal in client, number, day and id the first by op, valid_at, city and
    balance comes first. An op other than I, U and D is applied and changes
    nothing. Texts are carried whole. An empty table gives an empty result;
    other columns, whatever their names, are ignored.

    A client's changes are applied one after the other, so a task holds what its
    clients' numbers bring in one batch, each number once, and what they hold.
    """
    spark = changes.sparkSession
    shipped(spark)
    folder, out = new_path(spark, "changes"), new_path(spark, "applied")
    with scratch(spark):
        rows = numbered(changes, cut)
        clients = changes.select(F.approx_count_distinct("client_id")).first()[0]
        keys = max(KEYS, -(-clients // CLIENTS))
        of = F.when(F.col("again"), F.xxhash64("change_id", "day", "n")).otherwise(F.xxhash64("client_id"))
        rows = rows.withColumn("key", F.pmod(of, F.lit(keys))).withColumn("at", F.timestamp_millis((F.col("day") + SHIFT) * DAY_MS))
        rows.withColumn("part", F.col("batch")).write.partitionBy("part").parquet(f"{folder}/in")
    last = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    last = last.withColumn("key", F.lit(-1).cast("long")).withColumn("at", F.timestamp_millis(F.lit((END + SHIFT + cut.wait) * DAY_MS)))
    last.write.parquet(f"{folder}/in/part={cut.batches + 1}")
    schema = StructType(rows.schema.fields)
    for number in range(1, cut.batches + 2):
        _feed(spark, folder, out, number, schema, cut)
    return spark.read.parquet(out)


def _feed(spark: SparkSession, folder: str, out: str, number: int, schema: StructType, cut: Cut) -> None:
    """Starts the query anew, on its checkpoint, for all batches up to a number; it knows which it has seen."""
    own = _session(spark, STORES)
    path = own.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/in/part={number}")
    path.getFileSystem(own.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)  # a batch may be empty
    rows = own.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in/part={{{','.join(str(i) for i in range(1, number + 1))}}}")
    rows = rows.withWatermark("at", f"{cut.wait} days").drop("at").groupBy("key").transformWithState(Applier(cut), OUTPUT, "Append", "EventTime")
    query = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(out)
    try:
        query.awaitTermination()
    finally:
        query.stop()


def _session(spark: SparkSession, more: dict[str, str]) -> SparkSession:
    """A session with the same settings and some more, which the caller's does not keep."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in more.items():
        own.conf.set(key, value)
    return own


def digest(changes: DataFrame) -> DataFrame:
    """The contract's columns: balance in cents."""
    out = applied(changes)
    return out.select("change_id", "client_id", "status", "batch", "missed", "city", F.floor(F.col("balance") * 100 + 0.5).cast("long").alias("cents"), "current")
