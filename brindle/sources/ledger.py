"""Sinks that keep one copy of a batch, whatever fails between writing and committing.

A stream that is started again after a failure gives the same batch, with the
same number, once more. Each batch is written into a folder of its own, which
the next attempt overwrites, and is entered in a ledger when it is whole; the
reader takes batches of the ledger only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "batch long, rows long"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_batch(rows: DataFrame, batch: int, path: str, between: Callable[[], None] = lambda: None) -> None:
    """Writes a batch once: nothing is done if the ledger has it.

    ``between`` is called after the rows and before the entry.
    """
    spark = rows.sparkSession
    if _exists(spark, f"{path}/ledger/batch={batch}/_SUCCESS"):
        return
    # the folder of the batch is the unit: what a failed attempt left there goes
    rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    between()
    entry = spark.read.schema(rows.schema).parquet(f"{path}/rows/batch={batch}").agg(F.count("*").alias("rows"))
    entry.write.mode("overwrite").parquet(f"{path}/ledger/batch={batch}")


def write_stream(rows: DataFrame, path: str, checkpoint: str, between: Callable[[], None] = lambda: None):
    """A started query that writes the stream's batches so, all that is there now."""
    sink = rows.writeStream.foreachBatch(lambda df, batch: write_batch(df, batch, path, between))
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the batches in the ledger, with their ``batch``."""
    if not _exists(spark, f"{path}/ledger"):
        return spark.createDataFrame([], f"{schema}, batch long")
    done = [r.batch for r in spark.read.schema(LEDGER).option("basePath", f"{path}/ledger").parquet(f"{path}/ledger").select("batch").distinct().collect()]
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    # the entries are as many as batches; the filter on the folder leaves out the others before any file is opened
    return rows.where(F.col("batch").isin(done))
