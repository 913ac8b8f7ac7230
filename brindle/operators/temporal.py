"""Joins and frames over time: the last row before, rows within an interval, sums over the last days.

Keys may be skewed: one client may have a third of all rows. So a key's history
is cut into buckets of time, each of which is a group of its own, and what a
bucket needs of those before it is worked out from one small row for each
bucket and handed on to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.shared import stored

#: Rows of both sides that a bucket of time is meant for, and the most buckets there are.
BUCKET_ROWS, BUCKETS = 200_000, 100_000
#: An interval is matched in at most about so many bins.
BINS = 8
#: Points or intervals of a bin that are compared in one group, and pairs that a task of a join is meant for.
SIDE, PAIRS = 2_000, 1_000_000


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone, or of a date."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


def bucket_width(times: DataFrame, column: str) -> int:
    """Microseconds of a bucket, so that a column of times, evenly spread, has BUCKET_ROWS of them in each."""
    n, low, high = times.agg(F.count(column), F.min(column), F.max(column)).first()
    return max(1, (high - low) // min(BUCKETS, max(1, n // BUCKET_ROWS)) + 1) if n else 1


def asof(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
    values: Sequence[str], order: Sequence[str] = (), before: bool = False, within: int | None = None, width: int | None = None,
) -> DataFrame:
    """Every row of ``left`` with the ``values`` of the last row of ``right`` that is not later.

    Rows match on equal ``keys``; among rows of ``right`` of one time the last
    in ``order`` counts. ``before`` asks for an earlier one; with ``within``
    (microseconds) one that is further back counts as none. Values are null
    where there is none, and for null keys or times; rows of ``right`` without
    a time match nothing. No name of ``values`` may be one of ``left``.

    Both sides are put in one order instead of being joined by a range: the
    last value seen is carried forward within a bucket of time. Where a bucket
    begins, the last value of the key's earlier buckets is put in as one more
    row; it comes from maxima that are aggregated before they are shuffled.
    """
    row, at, value = F.struct(*[F.col(f"`{c}`") for c in left.columns]), micros(F.col(left_time)), F.struct(micros(F.col(right_time)).alias("at"), *values)
    names = [f"k{i}" for i in range(len(keys))]
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    ours = left.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], at.alias("at"), row.alias("row"), (complete & at.isNotNull()).alias("known"))
    theirs = right.where(complete & F.col(right_time).isNotNull())
    theirs = theirs.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.struct(micros(F.col(right_time)).alias("at"), *order).alias("place"), value.alias("value"))
    if width is None:
        width = bucket_width(ours.select("at").unionAll(theirs.select("place.at")), "at")
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long").alias("bucket")

    known = ours.where("known").select(*names, bucket(F.col("at")), "at", F.lit(0 if before else 2).alias("side"), "row")
    theirs = theirs.select(*names, bucket(F.col("place.at")), F.col("place.at").alias("at"), "place", "value")
    last = theirs.groupBy(*names, "bucket").agg(F.max_by("value", "place").alias("value"))
    asked = known.select(*names, "bucket").distinct()
    along = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = last.unionByName(asked, allowMissingColumns=True).groupBy(*names, "bucket").agg(F.first("value", ignorenulls=True).alias("value"))
    # the start of a bucket comes before everything in it
    carried = buckets.select(*names, "bucket", F.last("value", ignorenulls=True).over(along).alias("value")).where("value is not null")
    carried = carried.select("*", F.lit(None).cast("long").alias("at"), F.lit(-1).alias("side"))
    rows = known.unionByName(theirs.withColumn("side", F.lit(1)), allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    seen = Window.partitionBy(*names, "bucket").orderBy(F.col("at").asc_nulls_first(), "side", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("value", F.last("value", ignorenulls=True).over(seen)).where("row is not null").select("row", "at", "value")
    rows = rows.unionByName(ours.where("not known").select("row", "at"), allowMissingColumns=True)
    near = F.lit(True) if within is None else F.coalesce(F.col("at") - F.col("value.at") <= within, F.lit(False))
    return rows.select("row.*", *[F.when(near, F.col(f"value.`{v}`")).alias(v) for v in values])


def covered(points: DataFrame, intervals: DataFrame, time: str, start: str, end: str, name: str = "intervals") -> DataFrame:
    """Every row of ``points`` with the number of ``intervals`` that contain its time, ends included; 0 for a null time.

    An interval with a null end, or one that ends before it starts, contains nothing.

    No pair is made: a start adds one from its time on, an end takes one away
    after its time, and a point gets the sum up to its own time. As in ``asof``,
    sums are taken within a bucket of time, and what stands before a bucket is
    one more row in it, from one row for each bucket.
    """
    low, high = micros(F.col(start)), micros(F.col(end))
    ends = F.array(F.struct(low.alias("at"), F.lit(1).alias("by")), F.struct((high + 1).alias("at"), F.lit(-1).alias("by")))
    steps = intervals.where(low <= high).select(F.explode(ends).alias("x")).groupBy("x.at").agg(F.sum("x.by").alias("by"))
    ours = points.select(micros(F.col(time)).alias("at"), F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("row"))
    width = bucket_width(ours.select("at").unionAll(steps.select("at")), "at")
    bucket = F.floor(F.col("at") / F.lit(width)).cast("long")
    known, steps = ours.where("at is not null").withColumn("bucket", bucket), steps.withColumn("bucket", bucket)
    asked = known.select("bucket", F.lit(0).cast("long").alias("by")).distinct()
    buckets = steps.select("bucket", "by").unionByName(asked).groupBy("bucket").agg(F.sum("by").alias("by"))
    before = F.sum("by").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = buckets.select("bucket", before.alias("by")).where("by is not null")
    rows = known.unionByName(steps, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    # all of a time and before it, in which a row that is carried has no time
    upto = Window.partitionBy("bucket").orderBy(F.col("at").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("n", F.coalesce(F.sum("by").over(upto), F.lit(0))).where("row is not null").select("row", "n")
    rows = rows.unionByName(ours.where("at is null").select("row", F.lit(0).cast("long").alias("n")))
    return rows.select("row.*", F.col("n").alias(name))


def within_interval(
    points: DataFrame, intervals: DataFrame, time: str, start: str, end: str, keys: Sequence[str] = (), width: int | None = None
) -> DataFrame:
    """Pairs of a row of ``points`` and one of ``intervals`` that contains its time, ends included, with equal ``keys``.

    The columns are those of both, keys once. Null keys and times match
    nothing; an interval that ends before it starts contains nothing.

    An interval is looked for in bins of about its own length: those of level 0
    are ``width`` microseconds wide (by default the median length), and each
    level is BINS times as wide, so an interval takes part in BINS + 2 bins at
    most however long it is, and a point in one for each level that occurs.
    That makes an equality join on level and bin, and what it finds is checked.

    A key may have very many of both in one bin. There, points and intervals are
    dealt into blocks of about SIDE rows, and each block of the ones meets each
    block of the others in a group of its own. Groups are dealt over tasks by
    the number of pairs they hold, not by their bytes: the result may be far
    larger than what is joined.
    """
    inside = [F.col(c).isNotNull() for c in (start, end, *keys)]
    taken = {c.lower() for c in (*points.columns, *intervals.columns)}
    free = lambda x: next(n for n in (x, *(f"{x}_{i}" for i in range(len(taken) + 1))) if n not in taken)
    lv, bn, ours, theirs, own, at, low, high = map(free, ("level", "bin", "points", "intervals", "own", "at", "low", "high"))
    # times are turned into numbers once for a row, not once for a pair; what makes the intervals is worked out once
    rows = intervals.withColumns({low: micros(F.col(start)), high: micros(F.col(end))}).where(F.col(low) <= F.col(high))
    for c in inside:
        rows = rows.where(c)
    rows, length = stored(rows, "intervals"), F.col(high) - F.col(low)
    if width is None:
        median = rows.select(length.alias("n")).agg(F.percentile_approx("n", 0.5, 1000)).first()[0]
        width = max(1, int(median or 0) // 2)
    # the least level on which it is not longer than BINS bins
    bins = F.greatest(F.lit(1.0), (length + 1) / F.lit(float(width * BINS)))
    level = F.ceil(F.log(float(BINS), bins) - 1e-9).cast("int")
    scale = lambda lv: F.lit(width) * F.pow(F.lit(float(BINS)), lv).cast("long")
    rows = rows.withColumn(lv, level)
    first, last = F.floor(F.col(low) / scale(F.col(lv))).cast("long"), F.floor(F.col(high) / scale(F.col(lv))).cast("long")
    rows = rows.withColumn(bn, F.explode(F.sequence(first, last)))
    levels = sorted(r[0] for r in rows.select(lv).distinct().collect())  # a few: log of the longest interval
    dots = points.withColumn(at, micros(F.col(time))).where(F.col(at).isNotNull()).withColumn(lv, F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    dots = dots.withColumn(bn, F.floor(F.col(at) / scale(F.col(lv))).cast("long"))
    group = [*keys, lv, bn]
    counts = [df.groupBy(*group).agg(F.count("*").alias(n)) for df, n in ((dots, ours), (rows, theirs))]
    counts = stored(counts[0].join(counts[1], group), "bins")
    held = counts.agg(F.sum(F.col(ours) * F.col(theirs) + F.col(ours) + F.col(theirs))).first()[0] or 0
    blocks = {n: F.ceil(F.col(n) / F.lit(SIDE)).cast("int") for n in (ours, theirs)}
    # one row for each SIDE rows of either table at most
    many = counts.where((F.col(ours) > SIDE) | (F.col(theirs) > SIDE)).select(*group, *[c.alias(n) for n, c in blocks.items()])
    tasks = max(1, min(100_000, -(-int(held) // PAIRS)))

    def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
        """Each row in a block of its own side, once for each block of the other."""
        df = df.withColumn(own, F.xxhash64(F.monotonically_increasing_id())).join(F.broadcast(many), group, "left")
        df = df.withColumn(mine, F.coalesce(F.pmod(F.col(own), F.col(mine)), F.lit(0)).cast("int"))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)))
        return df.drop(own).repartition(tasks, *group, ours, theirs)

    out = dealt(dots, ours, theirs).join(dealt(rows, theirs, ours), [*group, ours, theirs])
    return out.where(F.col(at).between(F.col(low), F.col(high))).drop(lv, bn, ours, theirs, at, low, high)


def rolling_sum(df: DataFrame, keys: Sequence[str], time: str, amount: str, span: int, bucket: int, name: str = "rolling") -> DataFrame:
    """Every row with the sum of ``amount`` over the last ``span`` microseconds of its key up to its own time, both ends included.

    ``span`` is a multiple of ``bucket``: a key's history is summed into
    buckets, and a row takes the sum of whole buckets within its span from one
    sort of these, and the rest from the rows of two buckets, its own and the
    one in which its span begins. Those are sorted for each bucket, so no
    history is one sort. Null times get null; amounts that are null add nothing.
    Sums of floating numbers are those of exact ones up to rounding.
    """
    if span % bucket:
        raise ValueError("the span has to be a multiple of the bucket")
    steps = span // bucket
    at = micros(F.col(time))
    names = [f"k{i}" for i in range(len(keys))]
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], at.alias("at"), F.col(amount).alias("amount"))
    known = base.where("at is not null").withColumn("bucket", F.floor(F.col("at") / F.lit(bucket)).cast("long"))
    # whole buckets strictly between that in which the span begins and the row's own
    sums = known.groupBy(*names, "bucket").agg(F.sum("amount").alias("total"))
    between = Window.partitionBy(*names).orderBy("bucket").rangeBetween(-(steps - 1), -1)
    whole = sums.select(*names, "bucket", F.sum("total").over(between).alias("whole"))
    # of its own bucket all up to the row; of the first one all from the row's place in it on
    own = known.select("*", F.lit(True).alias("asks"), F.col("at").alias("from"))
    first = known.select(*names, (F.col("bucket") + steps).alias("bucket"), (F.col("at") + span).alias("at"), "amount", F.lit(False).alias("asks"))
    both = own.drop("from").unionByName(first, allowMissingColumns=True)
    same = Window.partitionBy(*names, "bucket").orderBy("at")
    upto = F.sum(F.when(F.col("asks"), F.col("amount"))).over(same.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.sum(F.when(~F.col("asks"), F.col("amount"))).over(same.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    both = both.withColumns({"upto": upto, "after": after}).where("asks")
    same_keys = F.col("b.bucket") == F.col("w.bucket")
    for n in names:
        same_keys = same_keys & F.col(f"b.{n}").eqNullSafe(F.col(f"w.{n}"))
    both = both.alias("b").join(whole.alias("w"), same_keys, "left")
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("w.whole", "b.after")), F.coalesce(F.col("b.upto"), F.lit(0)))
    out = both.select("b.row.*", total.alias(name))
    return out.unionByName(base.where("at is null").select("row.*"), allowMissingColumns=True)
