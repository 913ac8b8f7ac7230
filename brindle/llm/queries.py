"""Queries of the training-data operators over whole tables, and their SQL where SQL can tell them.

The operators state what nulls, empty and long texts, ties, repeated rows, empty
tables and clashing columns give.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import changes, decontaminate, licenses, mixing, packing, pii, quality, runs, secrets, sharding, simjoin, toxicity, warc
from brindle.llm.common import dealt, read
from brindle.llm.oracles import ORACLES


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(read(spark, sf_dir, "documents"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return toxicity.scored(_documents(spark, sf_dir), read(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as the archives have it, with its place in the capture histories."""
    return warc.digest(read(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a benchmark item in a document: doc_id, item_id, start, end, edits."""
    return decontaminate.leaks(_documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets of every document."""
    return secrets.digest(_documents(spark, sf_dir))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: four words, 85 per cent."""
    return simjoin.similar(_documents(spark, sf_dir), words=4, percent=85)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mixing.mixed(_documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by the law `key`."""
    return sharding.digest(_documents(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License sentences and licenses of every document."""
    return licenses.digest(_documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the base rules and the verdict."""
    return quality.digest(_documents(spark, sf_dir), read(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data of every document."""
    return pii.digest(_documents(spark, sf_dir))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 4096 tokens."""
    return packing.digest(_documents(spark, sf_dir))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, the longest of them, and checksums of all and of the text without repetitions."""
    return runs.digest(_documents(spark, sf_dir))


def op13_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change that takes part: applied or rejected, in which batch, and the client's values afterwards."""
    return changes.digest(read(spark, sf_dir, "client_changes"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_warc, op3_decontamination, op4_secrets, op5_ngram_jaccard,
        op6_mixing, op7_sharding, op8_licenses, op9_quality, op10_pii,
        op11_packing, op12_runs, op13_changes,
    )
}
__all__ = ["ORACLES", "QUERIES"]
