"""Jaccard similarity join on word shingles by PartEnum signatures.

Sets fall into bands by size. Two sets in reach of each other, in one band or
in neighbouring ones, differ in at most k elements, k following from the
similarity and the band's largest size. The domain of shingles is dealt into n1
groups of n2 parts; as the k differences cannot spoil all groups, some group
has at most k2 parts that differ, so among the enumerated subsets of n2 - k2
parts one has the same elements in both sets. That projection's hash is a
signature both share.

Empty projections say nothing, and projections of shingles from passages that
many documents share say little; both would gather unlike sets. With t groups
more than needed, similar sets agree in t + 1 groups; a set with at most t
groups that have such projections leaves those out, since one of the others
must agree. Here t follows from the set's own size: a small one of the band has
fewer differences to any partner, so more groups to spare for its many empty
projections. A set with more such groups uses a scheme of another seed as well: a
partner that agrees with it in those projections only has more of them than
either can spare, and goes there too. The first seeds leave out empty projections and common
shingles, the next ones empty projections only, the last nothing, so no link is
lost. Which shingles are common is learnt from a sample; any choice is right, as
long as it is the same for all documents.

Documents that share a signature are candidates. A signature that many documents
of the sample share is hot: each task picks a head for it and links its own
documents with that, so only the heads of tasks meet. Components of candidates
are checked exactly, in blocks of bounded size dealt over tasks, by
prefix-filtered comparison of whole sets; a check emits a spanning forest of the
links, never all pairs. A component that is larger than a block is checked in two
rounds. First each block is compared within itself and with a few documents of
the whole component, which connects the members of a large group of near copies.
Then only documents outside the component's largest group meet all blocks in
reach: those within it are connected already. Documents with equal sets are
merged before any of this.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import freed, hot_join, map_arrow, scratch, written
from brindle.llm.components import components
from brindle.llm.shingles import digest, mix, sets

LEAST = 1
#: Seeds that leave out common shingles, and seeds in all.
SHY, SEEDS = 2, 6
#: Documents whose shingles are counted, expected number; a shingle of COMMON different sets among them is common; at most so many are kept.
SAMPLE_DOCS, COMMON, MOST_COMMON = 8000, 3, 300_000
#: Common shingles are told by so many bits of their hash; a few others are taken for common with them.
COMMON_BITS = 22
#: A signature of so many different sets among the sample is hot.
HOT = 80
#: Shingles of the documents that one task compares with each other.
BLOCK = 2_000_000
#: Documents, expected number, of each size class of a large component that meet all its blocks at first.
HUB = 50
#: Up to this many rows of (id, block) are broadcast to the scan of the texts, some 60 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


class Scheme:
    """Parameters of one instance, for sets up to ``largest`` elements: those with the fewest signatures."""

    def __init__(self, largest: int, percent: int):
        self.largest, self.percent = largest, percent
        self.k = self._differences(largest)
        p = percent / 100
        # sets of the band and of the one below, from end to end
        usual = [(n, self._differences(n)) for n in (max(1, round(largest * p**x)) for x in (2, 1.5, 1, 0.5, 0))]
        cost, self.n1, self.n2, self.k2 = min(
            (sum(self._cost(size, k, n1, n2, k2) for size, k in usual), n1, n2, k2)
            for k2 in range(min(self.k, 1), min(self.k, 6) + 1)
            for n2 in range(k2 + 1, k2 + 4)
            for need in [self.k // (k2 + 1) + 1]
            for n1 in sorted({need + need * x // 40 for x in range(41)})
        )
        subsets = list(itertools.combinations(range(self.n2), self.n2 - self.k2))
        self.choose = np.zeros((self.n2, len(subsets)), bool)
        for j, parts in enumerate(subsets):
            self.choose[list(parts), j] = True

    def _differences(self, size: int) -> int:
        """In how many elements a set can differ from a similar one of at most ``largest``."""
        return (100 - self.percent) * (size + min(size * 100 // self.percent, self.largest)) // (100 + self.percent)

    def spare(self, size: int) -> int:
        """Groups that a set of that size can do without: one more agrees with any similar set."""
        return self.n1 - 1 - self._differences(size) // (self.k2 + 1)

    @staticmethod
    def _cost(size: int, k: int, n1: int, n2: int, k2: int) -> float:
        """Signatures to expect of a set that differs in at most k elements, with those of further seeds."""
        subsets = math.comb(n2, k2)
        mean = size * (n2 - k2) / (n1 * n2)
        small = math.exp(-mean) * sum(mean**i / math.factorial(i) for i in range(LEAST))
        group = min(1.0, small * subsets)
        spread = math.sqrt(n1 * group * (1 - group)) + 1e-9
        further = 0.5 * math.erfc((n1 - 1 - k // (k2 + 1) + 0.5 - n1 * group) / spread / math.sqrt(2))
        return n1 * subsets / max(0.02, 1 - further)


@functools.cache
def band_of(size: int, percent: int) -> tuple[int, int, int]:
    """Number, least and largest size of the band that holds ``size``."""
    number, low = 0, 1
    while True:
        high = max(low, low * 100 // percent)
        if size <= high:
            return number, low, high
        number, low = number + 1, high + 1


@functools.cache
def scheme_of(high: int, percent: int) -> Scheme:
    return Scheme(high, percent)


def table_of(common: np.ndarray) -> np.ndarray:
    """For each hash prefix 0 if a common shingle has it, else 1."""
    table = np.ones(1 << COMMON_BITS, np.float32)
    table[common >> np.uint64(64 - COMMON_BITS)] = 0
    return table


def signatures(members: np.ndarray, percent: int, table: np.ndarray | None = None) -> np.ndarray:
    """Signatures of a set, for its own band and, where a partner may lie there, the next."""
    number, _, high = band_of(len(members), percent)
    instances = [(number, high)]
    if len(members) * 100 // percent > high:
        instances.append((number + 1, band_of(high + 1, percent)[2]))
    rare = np.ones(len(members)) if table is None else table[members >> np.uint64(64 - COMMON_BITS)]
    out = [_instance(members, rare, i, scheme_of(h, percent)) for i, h in instances]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _instance(members: np.ndarray, rare: np.ndarray, instance: int, s: Scheme) -> np.ndarray:
    if not s.k:  # equal sets only, which are merged elsewhere
        return np.zeros(0, np.uint64)
    parts, low32, kept = s.n1 * s.n2, np.uint64(0xFFFFFFFF), []
    for seed in range(SEEDS):
        dealt = mix(members + np.uint64(0x51ED270B * (seed + 1) + instance))
        part = (dealt >> np.uint64(20)) % np.uint64(parts)
        part = part.astype(np.int64)
        count = np.bincount(part, minlength=parts)
        # sums of halves stay below 2**53 and are exact in doubles
        halves = [np.bincount(part, weights=x.astype(np.float64), minlength=parts) for x in (members & low32, members >> np.uint64(32))]
        telling = np.bincount(part, weights=rare, minlength=parts) if seed < SHY else count
        count, telling, first, second = (x.reshape(s.n1, s.n2) @ s.choose for x in (count, telling, *halves))
        small = telling < LEAST
        last = seed == SEEDS - 1
        keep = np.ones_like(small) if last else ~small
        place = np.arange(count.size, dtype=np.uint64).reshape(count.shape) + np.uint64(seed << 40) + np.uint64(instance << 48)
        sig = mix(mix(first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place) + second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + count.astype(np.uint64))
        kept.append(sig[keep])
        if small.any(axis=1).sum() <= s.spare(len(members)):
            break
    return np.concatenate(kept)


def _features(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2 = [], [], []
            for s in sets(b.column("text"), words):
                x, y = digest(s)
                n.append(len(s))
                h1.append(x)
                h2.append(y)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, h1, h2))], ["doc_id", "n_shingles", "h1", "h2"])

    return map_arrow(docs, run, "doc_id long, n_shingles long, h1 long, h2 long")


def _sample(docs: DataFrame) -> DataFrame:
    """About SAMPLE_DOCS documents, by hash of their id; the same ones of a table always."""
    total = docs.count()
    if total > SAMPLE_DOCS:
        docs = docs.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) < (1 << 63) * SAMPLE_DOCS // total)
    return written(docs, "sample")


def _common(sample: DataFrame, words: int) -> np.ndarray:
    """Shingles of several different sets among a sample of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in sets(b.column("text"), words):
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array([digest(s)[0]]), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], ["h", "s"])

    found = map_arrow(sample, run, "h long, s array<long>").dropDuplicates(["h"]).select(F.explode("s").alias("s"))
    found = found.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "s").limit(MOST_COMMON)
    return np.array([r.s for r in found.collect()], np.int64).view(np.uint64)


def _hot(sample: DataFrame, words: int, percent: int, common: np.ndarray) -> np.ndarray:
    """Signatures of at least HOT sets of the sample: so few that the driver can hand them to all tasks."""
    found = _signed(sample, words, percent, common, np.zeros(0, np.int64)).groupBy("sig").agg(F.approx_count_distinct("doc_id").alias("n"))
    return np.sort(np.array([r.sig for r in found.where(F.col("n") >= HOT).collect()], np.int64))


def _signed(docs: DataFrame, words: int, percent: int, common: np.ndarray, hot: np.ndarray) -> DataFrame:
    """(sig, doc_id, head); of equal sets within a task only the first is given signatures.

    head is null but for documents with a hot signature: there it is the first
    such document of the task, which alone keeps the signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[int, int]] = set()
        first: dict[int, int] = {}
        table = table_of(common)
        for b in batches:
            sigs, ids, held, pairs = [], [], 0, []
            for doc_id, s in zip(b.column("doc_id").to_pylist(), sets(b.column("text"), words), strict=True):
                if len(s) and (d := digest(s)) not in known:
                    known.add(d)
                    x = signatures(s, percent, table).view(np.int64)
                    if len(hot) and len(x):
                        is_hot = hot[np.minimum(np.searchsorted(hot, x), len(hot) - 1)] == x
                        met = {first[h] for h in x[is_hot].tolist() if h in first}
                        pairs += [(doc_id, head) for head in met if head != doc_id]
                        new = [h for h in x[is_hot].tolist() if h not in first]
                        first.update((h, doc_id) for h in new)
                        x = np.concatenate([x[~is_hot], np.array(sorted(set(new)), np.int64)])
                    if len(x):
                        sigs.append(x)
                        ids.append(np.full(len(x), doc_id, np.int64))
                        held += len(x)
                if held > 500_000:
                    yield _rows(sigs, ids, pairs)
                    sigs, ids, held, pairs = [], [], 0, []
            if held or pairs:
                yield _rows(sigs, ids, pairs)

    return map_arrow(docs, run, "sig long, doc_id long, head long")


def _rows(sigs: list[np.ndarray], ids: list[np.ndarray], pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    # pairs are dealt like signatures, by a hash of their own that meets none of them
    own = [hash(p) for p in pairs]
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    sig, doc = pa.array(np.concatenate([cat(sigs), np.array(own, np.int64)])), pa.array(np.concatenate([cat(ids), np.array([p[0] for p in pairs], np.int64)]))
    return pa.RecordBatch.from_arrays([sig, doc, pa.array([None] * (len(sig) - len(pairs)) + [p[1] for p in pairs], pa.int64())], ["sig", "doc_id", "head"])


# --- exact comparison of candidates ---------------------------------------


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def linked(members: list[np.ndarray], sides: list[int], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; with two sides, of those between them.

    Rare elements come first, so that sets in reach share one of their first
    n - ceil(n * percent / 100) + 1; pairs already connected are not compared.
    """
    two = len(set(sides)) > 1
    flat, back, often = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    rank = np.empty(len(flat), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(flat))
    ranks = np.split(rank[back], np.cumsum([len(m) for m in members])[:-1])
    shared = often[np.argsort(often, kind="stable")] > 1
    forest, out = Forest(len(members)), []
    # for each element the earlier sets that have it, by their group at that time
    index: dict[int, dict[int, list[int]]] = {}
    order = sorted(range(len(members)), key=lambda i: (len(members[i]), i))
    for i in order:
        n = len(members[i])
        first = np.sort(ranks[i])[: n - (n * percent + 99) // 100 + 1]
        first = first[shared[first]].tolist()
        tried = set()
        for token in first:
            for group, sets_of in index.get(token, {}).items():
                for j in sets_of:
                    # a group that is connected by now is passed over at once
                    if forest.root(i) == forest.root(group):
                        break
                    if j in tried:
                        continue
                    tried.add(j)
                    m = len(members[j])
                    if (two and sides[i] == sides[j]) or m * 100 < n * percent:
                        continue
                    both = len(np.intersect1d(members[i], members[j], assume_unique=True))
                    if 100 * both >= percent * (n + m - both):
                        forest.link(i, j)
                        out.append((i, j))
        group = forest.root(i)
        for token in first:
            index.setdefault(token, {}).setdefault(group, []).append(i)
    return out


def _lows(percent: int) -> list[int]:
    """Least sizes of the size classes, which are the bands of the signatures: sets in reach lie in one or in neighbouring ones."""
    lows, size = [], 1
    while size < 1 << 31:
        lows.append(size)
        size = band_of(size, percent)[2] + 1
    return lows


def _checked(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) within each group of ``rows`` (key, side, class, doc_id, text), which arrive sorted by key.

    A document's texts are joined to the blocks of all its classes; a text
    counts in those of its own class only.
    """
    lows = _lows(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held, sides = None, [], [], []

        def close():
            # a document may come in several rows; its texts are one node elsewhere
            found = linked(held, sides, percent) if len(held) > 1 else []
            pairs = [(ids[i], ids[j]) for i, j in found if ids[i] != ids[j]]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64())], ["a", "b"])

        for b in batches:
            for k, side, c, doc_id, s in zip(*[b.column(x).to_pylist() for x in ("key", "side", "class", "doc_id")], sets(b.column("text"), words), strict=True):
                if k != key:
                    if len(ids) > 1:
                        yield close()
                    key, ids, held, sides = k, [], [], []
                if len(s) and bisect.bisect_right(lows, len(s)) == c:
                    ids.append(doc_id)
                    held.append(s)
                    sides.append(side)
        if len(ids) > 1:
            yield close()

    return map_arrow(rows, run, "a long, b long")


def _key(*parts: Column | str) -> Column:
    return F.concat_ws("/", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def _upto(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _neighbours(t: DataFrame, *columns: str) -> DataFrame:
    """Adds next_ and last_ columns: those of the same label's next and last size class, 0 where there is none. A label has few classes."""
    w = Window.partitionBy("label").orderBy("class")
    for name, f, by in (("next", F.lead, 1), ("last", F.lag, -1)):
        t = t.withColumns({f"{name}_{c}": F.coalesce(F.when(f("class").over(w) == F.col("class") + by, f(c).over(w)), F.lit(0)) for c in columns})
    return t


def _sizes(candidates: DataFrame) -> DataFrame:
    """label, class, w (shingles), n (documents), whole (shingles of the label), s (blocks of the class)."""
    t = candidates.groupBy("label", "class").agg(F.sum("n_shingles").alias("w"), F.count("*").alias("n"))
    t = t.withColumn("whole", F.sum("w").over(Window.partitionBy("label"))).withColumn("s", F.ceil(F.col("w") / (BLOCK // 2)).cast("int"))
    return _neighbours(t, "s")


def _own_blocks(candidates: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, key, side, class) of the first round.

    A component of at most BLOCK shingles is one group. A larger one is split
    by size class and salt, and about HUB documents of each class join all
    blocks of its own and the neighbouring classes.
    """
    joined = candidates.join(F.broadcast(sizes) if sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else sizes, ["label", "class"])
    c, hashed = F.col("class"), F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    own = F.pmod(F.xxhash64("doc_id"), F.col("s")).cast("int")
    at = lambda offset, n: F.transform(_upto(F.col(n)), lambda b: _key(F.col("label"), c + offset, b))
    mine = F.array(_key(F.col("label"), c, own))
    hub = hashed.cast("double") * F.col("n") < float(1 << 63) * HUB
    keys = F.when(F.col("whole") <= BLOCK, F.array(_key(F.col("label")))).when(hub, F.concat(at(0, "s"), at(1, "next_s"), at(-1, "last_s"))).otherwise(mine)
    return joined.select("doc_id", F.explode(keys).alias("key"), F.lit(0).alias("side"), "class")


def _other_blocks(candidates: DataFrame, group: DataFrame) -> DataFrame:
    """(doc_id, key, side, class) of the second round, for components larger than a block.

    ``group`` is (node, label): what the first round connected. Documents outside
    a component's largest group meet each other and that group, in blocks; two
    of the largest group need not meet.
    """
    group = group.select(F.col("node").alias("doc_id"), F.col("label").alias("group"))
    c = written(candidates.join(group, "doc_id", "left").withColumn("group", F.coalesce("group", "doc_id")), "grouped")
    largest = c.groupBy("label", "group").agg(F.sum("n_shingles").alias("w")).groupBy("label").agg(F.max_by("group", F.struct("w", "group")).alias("largest"))
    c = c.join(largest, "label").withColumn("out", F.col("group") != F.col("largest"))
    c = written(c.drop("group", "largest"), "sides")
    w = lambda out: F.ceil(F.sum(F.when(F.col("out") == out, F.col("n_shingles"))) / (BLOCK // 2)).cast("int")
    t = c.groupBy("label", "class").agg(F.coalesce(w(True), F.lit(0)).alias("u"), F.coalesce(w(False), F.lit(0)).alias("m"))
    t = _neighbours(t.join(t.groupBy("label").agg(F.sum("u").alias("some")).where("some > 0").select("label"), "label"), "u", "m")
    j = c.join(t, ["label", "class"])
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("out"), F.col("u")).otherwise(F.col("m"))).cast("int")
    label, at = F.col("label"), F.col("class")
    meet = lambda n, key, side: F.transform(_upto(F.col(n)), lambda b: F.struct(key(b).alias("key"), (side(b) if callable(side) else F.lit(side)).cast("int").alias("side")))
    # among each other: within a class, and with the next and the last one
    among = [
        meet("u", lambda b: _key(label, "u", at, F.least(own, b), at, F.greatest(own, b)), lambda b: own > b),
        meet("next_u", lambda b: _key(label, "u", at, own, at + 1, b), 0),
        meet("last_u", lambda b: _key(label, "u", at - 1, b, at, own), 1),
    ]
    # with the largest group: the outer documents' class and block first
    outer = [meet(n, lambda b, d=d: _key(label, "m", at, own, at + d, b), 0) for d, n in ((0, "m"), (1, "next_m"), (-1, "last_m"))]
    inner = [meet(n, lambda b, d=d: _key(label, "m", at + d, b, at, own), 1) for d, n in ((0, "u"), (1, "next_u"), (-1, "last_u"))]
    spread = j.withColumn("x", F.explode(F.when(F.col("out"), F.concat(*among, *outer)).otherwise(F.concat(*inner))))
    return spread.select("doc_id", "x.key", "x.side", "class")


def _links(docs: DataFrame, blocks: DataFrame, words: int, percent: int) -> DataFrame:
    """What the comparisons within each group of ``blocks`` find."""
    blocks = written(blocks, "blocks")
    if blocks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        # texts of other documents end at the scan; without this all texts are shuffled by id first
        blocks = F.broadcast(blocks)
    rows = docs.join(blocks, "doc_id").repartition("key").sortWithinPartitions("key")
    return written(_checked(rows.select("key", "side", "class", "doc_id", "text"), words, percent), "links")


def _components(docs: DataFrame, named: DataFrame, words: int, percent: int) -> DataFrame:
    """(h1, h2, component, n): the component of each set among ``named``, and how many rows have the set."""
    groups = named.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.count("*").alias("n"))
    groups = written(groups, "groups")
    rep_of = hot_join(named.select("doc_id", "h1", "h2"), groups.select("h1", "h2", "rep", "n"), ["h1", "h2"], "n").select("doc_id", "rep")
    once = rep_of.distinct()
    several = rep_of.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    apart = written(once.join(several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "apart")

    known = docs.where("doc_id is not null")
    sample = _sample(known)
    common = _common(sample, words)
    signed = _signed(known, words, percent, common, _hot(sample, words, percent, common)).repartition(F.col("sig"))
    run = Window.partitionBy("sig").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stars = signed.select("doc_id", F.coalesce("head", F.first("doc_id").over(run)).alias("head")).where("doc_id <> head").distinct()
    stars = written(stars, "stars")
    close = stars.join(once, "doc_id").select("head", F.col("rep").alias("a")).join(once.withColumnRenamed("doc_id", "head"), "head").select("a", F.col("rep").alias("b"))
    labels = components(close.unionAll(apart))
    size_class = F.size(F.filter(F.array(*map(F.lit, _lows(percent))), lambda low: low <= F.col("n_shingles")))
    by_size = groups.groupBy(F.col("rep").alias("doc_id"), size_class.alias("class")).agg(F.sum("n_shingles").alias("n_shingles"))
    candidates = written(labels.withColumnRenamed("node", "doc_id").join(by_size, "doc_id"), "candidates")
    sizes = written(_sizes(candidates), "sizes")
    links = _links(docs, _own_blocks(candidates, sizes), words, percent)
    large = sizes.where(F.col("whole") > BLOCK).select("label").distinct()
    if not large.isEmpty():
        split = written(candidates.join(large, "label"), "large")
        links = links.unionAll(_links(docs, _other_blocks(split, components(links.unionAll(apart))), words, percent))
    label = components(links.unionAll(apart)).withColumnRenamed("node", "rep")
    return groups.join(label, "rep", "left").select("h1", "h2", F.coalesce("label", "rep").alias("component"), "n")


def similar(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``.

    Two documents link when 100 * intersection >= percent * union of their sets
    of ``words``-word shingles. component_id is the least doc_id reachable.

    Defined results: null and empty texts, and texts without words, have no
    shingles and link with nothing; rows that repeat a doc_id are one document
    with several texts; a row with a null doc_id cannot be named, so it links
    with nothing and its component_id is null; an empty table gives an empty
    result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = written(_features(docs, words), "features", keep=True)
    named = features.where("n_shingles > 0 and doc_id is not null")
    with freed(docs.sparkSession), scratch(docs.sparkSession):
        named_groups = written(_components(docs, named, words, percent), "named", keep=True)
    empty = F.col("n_shingles") == 0
    out = hot_join(named, named_groups, ["h1", "h2"], "n").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    # rows without words are their own component, rows without an id have none
    none = features.where(empty | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionAll(none)


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, all columns: of each group of linked documents the one with the least id, once.

    Rows without an id, and documents without words, stay.
    """
    found = similar(docs, words, percent)
    keep = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    columns = docs.columns
    rank = "_" * max(map(len, columns)) + "_rank"
    named = named.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).select(*columns)
    return named.unionAll(docs.where("doc_id is null"))
