"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and the session runs in one process, as in local tests, is a temporary
    folder made and set for the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


#: Each thread has scopes of its own, so operators that run side by side do not share folders.
_LOCAL = threading.local()


def _scopes() -> list[str]:
    return _LOCAL.__dict__.setdefault("scopes", [])


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is ``written`` within, unless it is to be kept, is deleted at the end: no frame that is used later may rest on it."""
    path = new_path(spark, "scratch")
    _scopes().append(path)
    try:
        yield
    finally:
        _scopes().remove(path)
        _delete(spark, path)


#: By this setting the files of a shuffle go with the query that wrote them; else they stay until the driver happens to collect its garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Each query built and run within leaves no shuffle files behind."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: whatever reads the result starts from files that
    outlive any executor.
    """
    spark = df.sparkSession
    path = f"{_scopes()[-1]}/{label}-{uuid.uuid4().hex}" if _scopes() and not keep else new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files below a frame that ``written`` returned."""
    files = df.inputFiles()
    if files:
        _delete(df.sparkSession, os.path.dirname(files[0]))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()
#: Rows of an Arrow batch at most: texts are long, and a batch lies in memory on both sides.
BATCH_ROWS, _ROWS = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_arrow(df: DataFrame, f: Callable, schema) -> DataFrame:
    """``df.mapInArrow``, after this package has been sent to the executors once.

    The session's Arrow batches are set to BATCH_ROWS if they are larger or
    unbounded.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ROWS, "10000")) <= BATCH_ROWS:
        conf.set(_ROWS, str(BATCH_ROWS))
    shipped(df.sparkSession)
    return df.mapInArrow(f, schema)


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors, once for an application.

    Spark's file server hands the archive out, so executors need no copy of the
    repository and no folder shared with the driver.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="brindle-package-")  # the driver's own; it serves the file from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{package.name}-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Tables of at most so many bytes, by Catalyst's estimate, may be dealt out anew.
DEAL_BYTES = 1 << 30


def dealt(df: DataFrame) -> DataFrame:
    """The same rows, over all cores if rows come in fewer than half as many tasks as there are cores.

    A scan splits files between row groups only, so a small table may come in
    one task. Which tasks have rows is told by the files' footers; tables that
    are not small are left as they are.
    """
    spark = df.sparkSession
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > DEAL_BYTES:
        return df
    cores = spark.sparkContext.defaultParallelism
    busy = df.select(F.spark_partition_id().alias("task")).distinct().count()
    return df.repartition(cores) if 2 * busy <= cores else df


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of the frame's."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(WORD)).cast("long")


def least_hashes(df: DataFrame, n: int, *columns: str) -> list[int]:
    """The n least of the different 63-bit hashes of ``row_hash`` over the columns, in order: a sample of rows that repeated rows do not weigh on.

    Only hashes are sorted, and in a large table only the lowest of them.
    """
    key = row_hash(*columns)
    share, total = 8 * n, df.count()
    while True:
        low = df.where(key < (1 << 63) * share // total) if total > share else df
        found = [r[0] for r in low.select(key.alias("h")).distinct().orderBy("h").limit(n).collect()]
        if len(found) == n or total <= share:
            return found
        share *= 64


def row_hash(*columns: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


#: A key with more rows than this, and than its part of all rows, is hot; there are never more hot keys than that.
HOT_ROWS, HOT_KEYS = 10_000, 50_000


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row for each key and in ``n`` how many rows have it.

    The few hot keys are broadcast, so their rows stay where they are; the rest
    is shuffled. ``table`` is read several times and should be a written one.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    heavy = table.where(F.col(n) > max(HOT_ROWS, total // HOT_KEYS))
    table = table.drop(n)
    if heavy.isEmpty():
        return rows.join(table, keys)
    names = heavy.select(*keys)
    hot = rows.join(F.broadcast(heavy.drop(n)), keys)
    return hot.unionByName(rows.join(F.broadcast(names), keys, "left_anti").join(table.join(F.broadcast(names), keys, "left_anti"), keys))


#: Rows that one task makes of a counted row at once.
EXPAND = 10_000


def expanded(rows: DataFrame, n: str, number: str) -> DataFrame:
    """Each row n times, numbered from 0 in ``number``; a row that stands for very many is dealt over tasks in parts."""
    (first,) = fresh(rows.drop(n), "first")
    last = F.col(n).cast("long") - 1
    few = rows.where(F.col(n) <= EXPAND).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), last)))
    many = rows.where(F.col(n) > EXPAND).withColumn(first, F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(EXPAND).cast("long"))))
    many = many.repartition(F.col(first), F.xxhash64(*rows.columns))
    many = many.withColumn(number, F.explode(F.sequence(first, F.least(F.col(first) + EXPAND - 1, last)))).drop(first)
    return few.unionByName(many)


def hash_sample(df: DataFrame, n: int, *ids: str, total: int | None = None) -> DataFrame:
    """The n rows, of about ``total``, with the least hash of their ids; equal ones in the order of all ids.

    In a large table only rows with a hash low enough for some 8 n rows are
    sorted, so what tasks hand on for sorting does not grow with the table.
    """
    key = F.shiftrightunsigned(F.xxhash64(*ids), 1)
    total = df.count() if total is None else total
    if total > 8 * n:
        df = df.where(key < (1 << 63) * 8 * n // total)
    return df.orderBy(key, *ids).limit(n)
