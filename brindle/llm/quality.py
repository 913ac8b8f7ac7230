"""Quality rules with risk-controlled thresholds.

Counts of each text give a badness, the largest of several measures over their
fixed scales. In each stratum (language) a cutoff on the badness is selected
from a fixed grid: of the labelled good documents of the stratum, how many
would it reject? Rejections are nested, so cutoffs are tested as a fixed
sequence, from the most lenient on: each is valid if the exact binomial upper
bound on that share is within ``RISK``, and the first that is not ends the
sequence. The level is divided by the strata with labels enough for a bound;
one whose whole sequence is valid hands its part on to the others (Holm). The
chance that any stratum uses a cutoff with a greater risk is at most ``LEVEL``.
Among valid cutoffs the one that rejects most labelled bad documents is used,
the most lenient of those that do nearly as well. A stratum with too few labels
has no valid cutoff, and there the method rejects nothing. Labelled documents
with equal texts are one draw, not several, and count once.

Defined results: a null or empty text has no words and fails the base rules; a
null lang is a stratum; repeated rows each get their row; ids labelled more
than once count with their least label; texts are read whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import map_arrow, scratch, written

RISK, LEVEL = 0.01, 0.05
CUTOFFS = (0.25, 0.4, 0.55, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0)
#: A lenient cutoff may miss this share of the bad documents that the best one rejects.
SLACK = 0.005
FEW_WORDS, MOST_REPEATED = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    if v < 1 << 20:
        windows = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * v + ids[2:]
    _, back, often = np.unique(windows, return_inverse=True, return_counts=True)
    twice = often[back] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def counts(text: str) -> tuple[int, ...]:
    words = text.encode("utf-8", "replace").split()
    word_chars = len(text) - sum(map(text.count, "\t\n\x0b\x0c\r "))
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip("\t\n\x0b\x0c\r "):
            lines += 1
            dup += line in seen
            seen.add(line)
    upper = sum(c.isupper() for c in text) if words else 0
    return len(words), word_chars, sum(map(text.count, "#*$%&|<>")), dup, repeated_words(words), lines, upper, text.count("!")


def measured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [counts(x.as_py() or "") for x in b.column("text")]
            columns = [pa.array([g[i] for g in got], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("text_hash"), *columns], ["doc_id", "lang", "text_hash", *COUNTS])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.xxhash64("text").alias("text_hash"))
    return map_arrow(docs, run, "doc_id long, lang string, text_hash long, " + ", ".join(f"{c} long" for c in COUNTS))


def badness() -> Column:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    length = F.col("word_chars") / words
    return F.greatest(
        F.col("n_symbols") / words / 0.3,
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)) / 0.5,
        F.col("n_repeat_words") / words / 0.4,
        F.col("n_upper") / chars / 0.4,
        F.col("n_marks") / words / 0.5,
        F.greatest((length - 6.5) / 5.0, (3.5 - length) / 2.0, F.lit(0.0)),
    )


def base_failed() -> Column:
    return (F.col("n_words") < FEW_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def upper_bound(k: int, n: int, level: float) -> float:
    """Exact (Clopper-Pearson) upper bound on a share of which k of n were seen."""
    if n == 0 or k >= n:
        return 1.0

    def tail(p: float) -> float:
        # P(X <= k) for n trials
        terms = (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1))
        return math.fsum(math.exp(t) for t in terms)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if 0 < mid < 1 and tail(mid) > level:
            low = mid
        else:
            high = mid
    return high


def valid(good: list[int], n_good: int, level: float) -> int:
    """How many cutoffs, from the most lenient on, have a bound within RISK at this level."""
    n = 0
    for k in reversed(good):
        # a share of more than RISK cannot have a bound within it; this also keeps the sums short
        if k > RISK * n_good or upper_bound(k, n_good, level) > RISK:
            break
        n += 1
    return n


def chosen(bad: list[int], n: int) -> float | None:
    """A cutoff from the n most lenient ones, or none if they reject no bad documents."""
    first = len(CUTOFFS) - n
    most = max(bad[first:], default=0)
    return CUTOFFS[max(i for i in range(first, len(CUTOFFS)) if bad[i] >= (1 - SLACK) * most)] if most else None


def select(good: list[int], n_good: int, bad: list[int], tests: int) -> float | None:
    """The cutoff of one stratum of ``tests`` from the labelled documents that each cutoff rejects, or none."""
    return chosen(bad, valid(good, n_good, LEVEL / tests))


def enough(level: float) -> float:
    """Labelled good documents that a bound within RISK takes when none is rejected."""
    return math.log(level) / math.log1p(-RISK)


def tested(sizes: list[int]) -> int:
    """How many strata, the largest first, can have a cutoff if the level is divided by them; it depends on their sizes alone."""
    sizes = sorted(sizes, reverse=True)
    return max((m for m in range(1, len(sizes) + 1) if sizes[m - 1] >= enough(LEVEL / m)), default=0)


def strata(held: DataFrame) -> DataFrame:
    """lang, n_good, good, bad: labelled good documents of each language, and how many good and bad ones each cutoff rejects; equal texts count once."""
    once = held.groupBy("lang", "quality", "text_hash").agg(F.max("badness").alias("badness"))
    rejected = lambda quality: F.array(*[F.sum(((F.col("badness") > c) & (F.col("quality") == quality)).cast("long")) for c in CUTOFFS])
    return once.groupBy("lang").agg(F.sum((F.col("quality") == 1).cast("long")).alias("n_good"), rejected(1).alias("good"), rejected(0).alias("bad"))


def cutoffs(table: DataFrame) -> DataFrame:
    """(lang, cutoff) of the languages that have one.

    Only languages with labels enough for a bound within RISK at the whole
    level are read, so their number is bounded by that of the labels, not of
    the languages.
    """
    rows = sorted(table.where(F.col("n_good") >= enough(LEVEL)).collect(), key=lambda r: (-r.n_good, r.lang))
    rows = rows[: tested([r.n_good for r in rows])]
    level, done, depth = LEVEL / max(1, len(rows)), set(), {}
    while True:
        depth = {r.lang: valid(r.good, r.n_good, level) for r in rows}
        whole = {lang for lang, n in depth.items() if n == len(CUTOFFS)}
        if whole == done or len(whole) == len(rows):
            break
        # strata whose sequence is through leave their part to the others
        done, level = whole, LEVEL / (len(rows) - len(whole))
    found = [(r.lang, cut) for r in rows if (cut := chosen(r.bad, depth[r.lang])) is not None]
    return table.sparkSession.createDataFrame(found, "lang string, cutoff double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base_failed and kept: one row per row of ``docs``."""
    stats = written(measured(docs).withColumn("badness", badness()), "quality", keep=True)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = stats.where(~base_failed()).join(known, "doc_id")
    with scratch(docs.sparkSession):
        cuts = cutoffs(written(strata(held), "strata"))
    stats = stats.join(F.broadcast(cuts), "lang", "left")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("badness") > F.col("cutoff"), F.lit(False))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", kept)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
