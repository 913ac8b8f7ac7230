"""Ranked search: an inverted index in stored tables, BM25, suggestions of terms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weights of BM25: how soon more occurrences count less, and how much a long text counts against them.
K1, B = 1.2, 0.75
#: Files of postings are split by the hash of the term into so many folders, so a search reads those of its terms.
SHARDS = 64


def terms(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


@dataclass
class Index:
    """Tables of an index: postings (term, doc, n, size), vocabulary (term, docs), and the whole's (docs, mean)."""

    postings: DataFrame
    vocabulary: DataFrame
    whole: DataFrame


def _shard(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SHARDS)).cast("int")


def write_index(docs: DataFrame, doc: str, text: str, path: str) -> Index:
    """Indexes the texts of ``docs``, one row for each ``doc``, below ``path``.

    Terms are counted within a text before anything is shuffled, so a word that
    every text has is one posting for each of them and no group of its own:
    the rows of a shard are dealt over tasks by document as well.
    """
    t = docs.select(F.col(doc).alias("doc"), terms(F.col(text)).alias("terms"))
    t = t.withColumn("size", F.size("terms").cast("long"))
    # before a plain explode Spark puts a test for empty arrays, which cuts each text once more
    rows = t.select("doc", "size", F.explode_outer("terms").alias("term")).where("term is not null").groupBy("doc", "size", "term").agg(F.count("*").alias("n"))
    rows = rows.select("term", "doc", "n", "size", _shard(F.col("term")).alias("shard"))
    rows.repartition(F.col("shard"), F.pmod(F.xxhash64("doc"), F.lit(8))).sortWithinPartitions("shard", "term").write.partitionBy("shard").parquet(f"{path}/postings")
    postings = docs.sparkSession.read.parquet(f"{path}/postings")
    postings.groupBy("term").agg(F.count("*").alias("docs")).orderBy("term").write.parquet(f"{path}/vocabulary")
    # texts are cut into terms once: their sizes add up to what the postings count, and texts without any have none
    sizes = postings.agg(F.sum("n").alias("all"))
    whole = docs.agg(F.count("*").alias("docs")).join(F.broadcast(sizes))
    whole.select("docs", (F.coalesce("all", F.lit(0)) / F.when(F.col("docs") > 0, F.col("docs"))).alias("mean")).write.parquet(f"{path}/whole")
    return read_index(docs.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "vocabulary", "whole")])


def ranked(index: Index, words: Sequence[str], k: int | None = None) -> DataFrame:
    """doc, score, matched: documents with any of the words, by BM25; with ``k`` only the best, ties by doc.

    Only postings of the words are read: their folders and, within these, the
    row groups that may have them. The best come from the heads of the tasks,
    not from a sort of all.
    """
    asked = sorted({w.lower() for w in words})
    spark = index.postings.sparkSession
    shards = sorted({r[0] for r in spark.createDataFrame([(w,) for w in asked], "term string").select(_shard(F.col("term"))).collect()}) if asked else []
    rows = index.postings.where(F.col("shard").isin(shards) & F.col("term").isin(asked))
    df = index.vocabulary.where(F.col("term").isin(asked)).join(F.broadcast(index.whole.withColumnRenamed("docs", "all")))
    df = df.select("term", "mean", F.log(F.lit(1.0) + (F.col("all") - F.col("docs") + 0.5) / (F.col("docs") + 0.5)).alias("idf"))
    rows = rows.join(F.broadcast(df), "term")  # a row for each word asked for
    long = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("size") / F.col("mean"))
    rows = rows.withColumn("part", F.col("idf") * F.col("n") * F.lit(K1 + 1) / (F.col("n") + long))
    out = rows.groupBy("doc").agg(F.sum("part").alias("score"), F.count("*").alias("matched"))
    return out if k is None else out.orderBy(F.col("score").desc(), "doc").limit(k)


def suggested(index: Index, beginning: str, k: int) -> DataFrame:
    """term, docs: the terms that most documents have, of those that begin so. The vocabulary is sorted, so few of its row groups are read."""
    low = beginning.lower()
    rows = index.vocabulary.where((F.col("term") >= low) & F.col("term").startswith(low))
    return rows.orderBy(F.col("docs").desc(), "term").limit(k)
