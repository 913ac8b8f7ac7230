"""A table replayed as a stream: rows arrive in parts, and a query is fed one part after the other.

Each part lies in a folder of its own, and the query is started anew for every
part on one checkpoint, with all folders so far as its source; the checkpoint
knows which files it has seen. A part is one batch with data, after which Spark
runs one without data if the watermark has moved. Everything lies below
``spark.checkpoint.dir``, in a new folder at each call.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.shared import new_folder

#: Settings of the session in which queries run: state in RocksDB, which timers need, without disk taken in advance.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.maintenanceInterval": "2s",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def own_session(spark: SparkSession) -> SparkSession:
    """A session with the caller's settings and those of SETTINGS, which the caller's does not keep."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in SETTINGS.items():
        own.conf.set(key, value)
    return own


@dataclass
class Replay:
    """What a replay wrote, and what its batches reported."""

    table: DataFrame
    progress: list[dict[str, Any]] = field(default_factory=list)

    def dropped(self) -> int:
        """Rows that came later than the watermark, as each operator with state counts what it is given."""
        return sum(o["numRowsDroppedByWatermark"] for p in self.progress for o in p["stateOperators"])

    def state_rows(self) -> list[int]:
        """Rows in state after each batch."""
        return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in self.progress if p["stateOperators"]]


def replay(rows: DataFrame, part: Column, parts: int, build: Callable[[Callable[[], DataFrame]], DataFrame], last: DataFrame | None = None) -> Replay:
    """Feeds ``rows``, those with part 1 first, up to ``parts``, and then ``last``, to the query that ``build`` makes.

    ``build`` gets a function that reads the stream, once for each use of it.
    ``last`` are far later rows that let the watermark pass all others.
    """
    spark = rows.sparkSession
    folder = new_folder(spark, "replay")
    # neighbours in a part may go to any file: what is within a part has no order
    rows.withColumn("part", part).write.partitionBy("part").parquet(f"{folder}/in")
    if last is not None:
        last.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema]).write.parquet(f"{folder}/in/part={parts + 1}")
        parts += 1
    own = own_session(spark)
    out = Replay(spark.createDataFrame([], "x int"))
    for number in range(1, parts + 1):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/in/part={number}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)  # a part may be empty
        names = ",".join(map(str, range(1, number + 1)))

        def read(names: str = names) -> DataFrame:
            return own.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in/part={{{names}}}")

        sink = build(read).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out")
        query = sink.trigger(availableNow=True).start()
        try:
            query.awaitTermination()
            out.progress += query.recentProgress
        finally:
            query.stop()
    out.table = spark.read.parquet(f"{folder}/out")
    return out
