"""Mixing sources to target weights by Pareto order sampling.

A source that is to give r times its words gives floor(r) certain whole copies
of every document; for the rest its documents are ranked by random odds over
inclusion odds, U / (1 - U) : p / (1 - p), and the first in that order are
taken once more until the target's words are reached. Inclusion probabilities
are unequal: they grow with a document's size. Documents whose probability
would exceed 1 are certain, and the others' are set anew, so that the words
expected are the words wanted. The sample's size is fixed in words, to within
half of the last document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import expanded, fresh, scratch, text_or_empty, word_count, written

WEIGHTS = (5, 2, 1)
#: Words wanted, as a share of all words, and the most copies of a source.
SHARE, MOST = 1.5, 2
#: The cut of a source is found among so many bins of its ranks, and again among so many of the bin it falls into.
BINS = 4096
#: More sources than this are joined by a shuffle instead of being broadcast.
BROADCAST_SOURCES = 50_000


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Adds ``number``, from 0 in the order given: ranges are numbered by themselves and start after the rows of those before."""
    ranged = df.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1), "ranged")
    # a row for each range
    counts = ranged.groupBy("part").agg(F.count("*").alias("rows"))
    start = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", start.alias("start"))
    return ranged.join(F.broadcast(starts), "part").withColumn("number", F.col("start") + F.col("at")).drop("part", "at", "start")


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds target to (source, source_size, ...): a row per source.

    Weights repeat along the sources by code point, null last. A target is
    weight x level, at most ``most`` times the source's size. The level rises
    from where no source is at its bound, until no more sources reach theirs:
    each step is one aggregate, so no task holds all sources.
    """
    number = F.col("number")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    t = numbered(totals, F.col("source").asc_nulls_last()).withColumn("weight", w).withColumn("bound", (F.col("source_size") * most).cast("double"))
    t = written(t.withColumn("ratio", F.col("bound") / F.col("weight")).drop("number"), "weights")
    level, full = 0.0, 0
    whole = F.sum("source_size").cast("double") * share
    while True:
        at = F.col("ratio") < level
        sums = t.agg(whole.alias("whole"), F.sum(F.when(at, F.col("bound"))).alias("below"), F.sum(F.when(~at, F.col("weight"))).alias("left"), F.count_if(at).alias("full")).first()
        if not sums.left or (level and sums.full == full):
            break
        level, full = (sums.whole - (sums.below or 0.0)) / sums.left, sums.full
    return t.withColumn("target", F.least("bound", F.col("weight") * F.lit(float(level)))).drop("weight", "bound", "ratio")


def uniform(doc_id: Column, size: Column) -> Column:
    """A number in (0, 1) that depends on the document alone, with 52 bits."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), size.cast("string"))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def _rank(doc_id: Column, size: Column) -> Column:
    """Pareto order as q / (1 + q), between 0 and 1; sampled sources only. Certain documents come first."""
    p = F.col("factor") * (size.cast("double") + F.col("mean"))
    u = uniform(doc_id, size)
    return F.when(p >= 1, F.lit(0.0)).otherwise(u * (1 - p) / (u * (1 - p) + (1 - u) * p))


def factors(t: DataFrame, histogram: DataFrame) -> DataFrame:
    """Adds factor: a document's probability is factor x (size + mean), at most 1, and the words expected are ``rest``.

    ``histogram`` counts a source's documents by size, so its rows grow with
    the spread of sizes only.
    """
    h = _with_plan(histogram.where("size > 0"), t.select("source", "rest", "mean")).where("rest > 0")
    n, size = F.col("n").cast("double"), F.col("size").cast("double")
    larger = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    certain = F.coalesce(F.sum(n * size).over(larger), F.lit(0.0))
    h = h.withColumn("factor", (F.col("rest") - certain) / (F.sum(n * size * size).over(rest) + F.col("mean") * F.sum(n * size).over(rest)))
    # the largest size that is not certain when all larger ones are
    found = h.where(F.col("factor") * (size + F.col("mean")) < 1).groupBy("source").agg(F.max_by("factor", "size").alias("factor"))
    return t.alias("t").join(found.alias("f"), F.col("t.source").eqNullSafe(F.col("f.source")), "left").select("t.*", "factor")


def plan(sizes: DataFrame) -> DataFrame:
    """A row per source: target, whole copies, and the last group of equal rows, by rank, of which some are taken once more.

    last is that group's key, last_n its rows and last_k how many of them are taken.
    """
    histogram = written(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    totals = histogram.groupBy("source").agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("source_size"), F.sum("n").alias("source_rows"))
    t = targets(totals)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    t = t.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    t = written(t.withColumn("mean", F.col("source_size").cast("double") / F.col("source_rows")), "targets")
    t = written(factors(t, histogram), "factors")
    t = written(_cut(sizes, t.withColumn("before", F.lit(0).cast("long")), 1), "cuts")
    t = written(_cut(sizes, t, 2), "cuts")
    # one bin of a bin's: few rows, whatever the source's
    last = _ranked(sizes, t).where(_bin(F.col("rank"), 2) == F.col("bin2"))
    key = F.struct("rank", F.coalesce("doc_id", F.lit(-1 << 63)).alias("id"), "size")
    last = last.groupBy("source", key.alias("key"), "size").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    run = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(run), F.lit(0))
    k = F.floor((F.col("rest") - F.col("earlier") - F.col("size") / F.lit(2.0)) / F.col("size")) + 1
    last = last.withColumn("earlier", earlier).withColumn("k", F.least(F.col("n"), k.cast("long"))).where("k > 0")
    last = last.groupBy("source").agg(F.max(F.struct("key", "n", "k")).alias("x")).select("source", F.col("x.key").alias("last"), F.col("x.n").alias("last_n"), F.col("x.k").alias("last_k"))
    return t.alias("t").join(last.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left").select("t.*", "last", "last_n", "last_k")


def _bin(rank: Column, level: int) -> Column:
    """Number of a rank's bin: level 2 cuts each bin of level 1."""
    fine = F.least(F.floor(rank * float(BINS * BINS)).cast("long"), F.lit(BINS * BINS - 1).cast("long"))
    return fine if level > 1 else F.floor(fine / BINS).cast("long")


def _ranked(sizes: DataFrame, t: DataFrame) -> DataFrame:
    return _with_plan(sizes.where("size > 0"), t).where("rest > 0").withColumn("rank", _rank(F.col("doc_id"), F.col("size")))


def _cut(sizes: DataFrame, t: DataFrame, level: int) -> DataFrame:
    """Adds the bin in which a source's wanted words end, and replaces before by the words of those ahead of it."""
    ranked = _ranked(sizes, t)
    if level > 1:
        ranked = ranked.where(_bin(F.col("rank"), 1) == F.col("bin1"))
    bins = ranked.groupBy("source", _bin(F.col("rank"), level).alias("bin")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    upto = Window.partitionBy("source").orderBy("bin")
    bins = bins.withColumn("after", F.col("before") + F.sum("words").over(upto)).where("after > rest")
    cut = bins.groupBy("source").agg(F.min(F.struct("bin", (F.col("after") - F.col("words")).alias("ahead"))).alias("cut"))
    cut = cut.select("source", F.col("cut.bin").alias(f"bin{level}"), F.col("cut.ahead").alias("ahead"))
    out = t.alias("t").join(cut.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left").select("t.*", f"bin{level}", "ahead")
    return out.withColumn("before", F.coalesce("ahead", "before")).drop("ahead")


def _with_plan(rows: DataFrame, t: DataFrame) -> DataFrame:
    """Rows with their source's row of ``t``, which is broadcast only if it is small."""
    small = t.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    t = t.withColumnRenamed("source", "_plan_source")
    return rows.join(F.broadcast(t) if small else t, F.col("source").eqNullSafe(F.col("_plan_source"))).drop("_plan_source")


def copies(doc_id: Column, size: Column) -> Column:
    """Copies of a document, next to its source's plan; null for the rows of a group that is taken in part."""
    rank = _rank(doc_id, size)
    key = F.struct(rank.alias("rank"), F.coalesce(doc_id, F.lit(-1 << 63)).alias("id"), size.alias("size"))
    drawn = (F.col("rest") > 0) & (size > 0)
    place = _bin(rank, 2)
    more = F.when(~drawn, F.lit(0)).when(place != F.col("bin2"), (place < F.col("bin2")).cast("int"))
    more = more.when(F.col("last").isNull() | (key > F.col("last")), F.lit(0))
    more = more.when((key < F.col("last")) | (F.col("last_k") == F.col("last_n")), F.lit(1))
    # without words there is nothing to take
    return F.when(size == 0, F.lit(0).cast("long")).otherwise(F.col("whole") + more)


def sizes_of(docs: DataFrame) -> DataFrame:
    size = word_count(text_or_empty("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), "source")


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of ``docs``.

    Defined results: a null text has size 0; a null source is a source, the
    last; a null doc_id ranks first among equal ranks; of rows equal in source,
    id and size as many are taken once more as the target asks for; documents
    without words take none; an empty table gives an empty result; very long
    texts are counted whole; other columns are ignored.
    """
    sizes = written(sizes_of(docs), "sizes", keep=True)
    with scratch(docs.sparkSession):
        chosen = written(plan(sizes), "mix", keep=True)
    out = _with_plan(sizes, chosen).withColumn("copies", copies(F.col("doc_id"), F.col("size")))
    names = ["doc_id", "size", "source_size", "target"]
    whole = out.where("copies is not null").select(*names, (F.col("copies") * F.col("size")).alias("taken"))
    # of a group that is taken in part, at most one of a source, all rows are the same
    part = chosen.where("last_k < last_n").withColumns({"size": F.col("last.size"), "doc_id": F.nullif(F.col("last.id"), F.lit(-1 << 63))})
    part = expanded(part.select(*names, "whole", "last_k", "last_n"), "last_n", "i")
    return whole.unionAll(part.select(*names, ((F.col("whole") + (F.col("i") < F.col("last_k")).cast("int")) * F.col("size")).alias("taken")))


def mix(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, each as often as the mix takes it.

    Defined results: those of ``mixed``; a row that is taken twice stands there
    twice, one that is not taken is left out. Among rows equal in source, id and
    size the hash of their other columns decides.
    """
    with scratch(docs.sparkSession):
        chosen = written(plan(written(sizes_of(docs), "sizes")), "mix", keep=True)
    columns = docs.columns
    held, size, copy, key, n, at = fresh(docs, "held", "size_", "copy", "key_", "n_", "at_")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias(held), F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    split = chosen.where("last_k < last_n")

    def counted(rows: DataFrame, t: DataFrame) -> DataFrame:
        sized = rows.withColumn(size, word_count(text_or_empty("text"))).drop("text")
        return _with_plan(sized, t).withColumn(copy, copies(F.col("doc_id"), F.col(size)))

    whole = counted(rows, chosen).where(F.col(copy) > 0).select(held, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy).cast("long"))).alias(copy)).select(held)
    if split.isEmpty():
        return whole.select(*[F.col(f"{held}.`{c}`").alias(c) for c in columns])
    # rows of groups that are taken in part, equal ones counted; a source has at most one such group, so few ids are read again
    ids = split.select(F.nullif(F.col("last.id"), F.lit(-1 << 63)).alias(key)).distinct()
    some = ids.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    again = rows.join(F.broadcast(ids) if some else ids, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")
    part = counted(again, split).where(F.col(copy).isNull())
    json = F.to_json(held)
    part = part.groupBy("source", F.xxhash64(json).alias(key), F.sha2(json.cast("binary"), 256).alias(at))
    part = part.agg(F.first(held).alias(held), F.count("*").alias(n), F.first("whole").alias("whole"), F.first("last_k").alias("last_k"))
    ahead = Window.partitionBy("source").orderBy(key, at).rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("more", F.greatest(F.lit(0), F.least(F.col(n), F.col("last_k") - F.coalesce(F.sum(n).over(ahead), F.lit(0)))))
    part = part.select(held, (F.col("whole") * F.col(n) + F.col("more")).alias(n)).where(F.col(n) > 0)
    rows = whole.unionAll(expanded(part, n, at).select(held))
    return rows.select(*[F.col(f"{held}.`{c}`").alias(c) for c in columns])
