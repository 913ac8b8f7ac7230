from collections import Counter

from pyspark.sql import functions as F

from brindle.llm.common import dealt


def tasks(df):
    return df.select(F.spark_partition_id().alias("task")).distinct().count()


def test_a_table_of_one_row_group_is_dealt_over_the_cores(spark, tmp_path):
    rows = [(i % 7, None if i % 5 == 0 else f"text {i % 3}") for i in range(500)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    assert tasks(one) == 1
    out = dealt(one)
    assert out.schema == one.schema and Counter(map(tuple, out.collect())) == Counter(rows)
    assert tasks(out) == cores or cores < 2


def test_a_table_of_many_tasks_or_without_rows_keeps_its_rows_and_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(1000, numPartitions=cores)
    assert dealt(many) is many
    assert dealt(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_tables_stay_as_they_are(spark, monkeypatch):
    monkeypatch.setattr("brindle.llm.common.DEAL_BYTES", 0)
    one = spark.range(100, numPartitions=1)
    assert dealt(one) is one


def test_scopes_of_threads_are_their_own(spark):
    """Two operators side by side: the one that ends first leaves the other's tables alone."""
    import threading

    from brindle.llm.common import scratch, written

    first, second = threading.Event(), threading.Event()
    seen = []

    def one():
        with scratch(spark):
            df = written(spark.range(5), "one")
            first.set()
            second.wait(60)
            seen.append(df.count())

    t = threading.Thread(target=one)
    t.start()
    first.wait(60)
    with scratch(spark):
        other = written(spark.range(3), "two")
        assert other.count() == 3
    second.set()
    t.join()
    assert seen == [5]
