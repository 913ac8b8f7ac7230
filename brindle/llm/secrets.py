"""Secret scan: patterns, and character Markov models of random and of ordinary strings.

Patterns find the base spans. Besides, every long token is scored by the
log-likelihood ratio of its character pairs under two first-order Markov models
trained from labelled samples, one of random strings and one of ordinary
identifiers. A token counts as random if its mean ratio (of a longer one, that of
any 64 characters) exceeds a threshold, or if somewhere in it the ratios beyond
that threshold add up to more than a bar, as they do at a key within a path.
Both limits are calibrated on samples that did not train the models. Tokens that
touch no base span are added as kind ``random``.
All of it is built-in functions.

Spans of a kind come from the text split at its matches: each start is the sum
of the lengths before it, in code points. A base assign span is its whole match.

Defined results: a null text counts as empty and has no spans; repeated rows
each get their row; a null doc_id is kept; texts are scanned whole; other
columns are ignored; with an empty table, or samples without any strings, the
method adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import least_hashes, row_hash, scratch, text_or_empty, written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Where ASSIGN can match at all.
ASSIGN_CUE = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
#: Runs cannot be cut short by the pattern, so the least length can stand in it.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGNED = 12
#: Tokens that the models judge. Longer ones than MODEL_CHARS are judged by each part of that length.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
MODEL_CHARS = 64
#: Documents, the first by hash of their id and text, and places in the whole text of each, from whose words ordinary identifiers are made; random strings made.
SAMPLE_DOCS, SAMPLE_PLACES, SAMPLE_RANDOM = 300, 200, 3000
#: Names and rulers of each form made.
SAMPLE_NAMES, SAMPLE_RULERS = 12000, 1280
#: One labelled sample in so many calibrates the limits and trains nothing.
HELD_OUT = 4
#: Words of identifiers, as samples of ordinary ones, and abbreviations with digits that stand among them.
WORDS = (
    "account action address agent alert amount archive area array asset author average backup badge balance bank batch binary block board body border branch bridge browser bucket budget bundle button "
    "calendar call cancel capacity card category cell chain change channel check child choice circle class client clock cloud cluster code collection color column command comment commit company compare "
    "component compute condition connect console contact container content context contract control convert copy cost country create credit current cursor custom database date debug decimal decode delay "
    "delete delivery depth detail device dialog directory discount display document domain download draft driver edge element email enable encode engine entity entry environment error event exception "
    "execute exit expire export factor failure feature fetch field file filter final flag folder format frame function group hash height image input interval job key language level limit link lock matrix memory message"
)
SHORT = "ipv4 udp png gif xml json html css sql api uri url cpu gpu ram io id md5 crc32 utf16 ascii x86 arm64 aes256 rsa ssl tls http2 s3 v2 3d 64bit"
#: What rulers and separators repeat.
RULERS = "= - _ + / =- -= +- -+ -_ =+ -/ /- =_ a=b= x- 0- 0 x X A +/"
#: A base span of each kind is looked for among the sorted ones in so many halvings.
HALVINGS = 31
ASCII = 128

Spans = Column


#: Lengths are summed in runs of this many, so that a text with very many matches does not sum all of them for each.
RUN = 256


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _running(lengths: Column) -> Column:
    """Sums of an array's elements up to each of them."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int")), lambda j: total(F.slice(lengths, j * RUN + 1, F.lit(RUN))))
    before = lambda sums: F.transform(sums, lambda _, j: total(F.slice(sums, F.lit(1), j)))

    def one(earlier: Column, i: Column) -> Column:
        j = F.floor(i / RUN).cast("int")
        return F.get(earlier, j) + total(F.slice(lengths, j * RUN + 1, i - j * RUN + 1))

    return _let(_let(runs, before), lambda earlier: F.transform(lengths, lambda _, i: one(earlier, i)))


def spans(text: Column, kind: str, pattern: str, ok: Callable[[Column], Column] | None = None) -> Spans:
    """Array of (start, rank, end, kind, value) of the pattern's matches that ``ok`` accepts."""
    pieces = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))

    def placed(p: Column) -> Column:
        # from each match's start to the next one's: its own length and the gap after it
        steps = F.transform(p["found"], lambda _, i: F.length(F.get(p["gaps"], i)) + F.coalesce(F.length(F.get(p["found"], i - 1)), F.lit(0)))
        starts = F.when(F.size(p["found"]) > 0, _let(steps, _running)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.zip_with(p["found"], starts, lambda m, at: F.struct(at.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (at + F.length(m)).alias("end"), F.lit(kind).alias("kind"), m.alias("value")))

    every = _let(pieces, placed)
    return F.filter(every, lambda s: ok(s["value"])) if ok is not None else every


NONE = "cast(array() as array<struct<start:int,rank:int,end:int,kind:string,value:string>>)"


def base(text: Column) -> tuple[Spans, Spans, Spans]:
    """Assign, access and hex spans; a cheap search first passes by the texts that have none."""
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_ASSIGNED
    return (
        F.when(F.rlike(text, F.lit(ASSIGN_CUE)), spans(text, "assign", ASSIGN, long_enough)).otherwise(F.expr(NONE)),
        F.when(F.instr(text, "AKIA") > 0, spans(text, "access", ACCESS)).otherwise(F.expr(NONE)),
        F.when(F.rlike(text, F.lit(HEX)), spans(text, "hex", HEX)).otherwise(F.expr(NONE)),
    )


def samples(docs: DataFrame) -> DataFrame:
    """(string, random): labelled samples when the caller has none.

    Random strings are encodings of hashes: hexadecimal, base 64 and capitals
    with digits. Ordinary identifiers are words of a bounded sample of the
    documents, by themselves and joined as identifiers are, among them constants
    and camel-case names with abbreviations and digits; and rulers, which are
    one or two characters over and over.
    """
    spark = docs.sparkSession
    h = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")).cast("binary"), 256)
    b64 = F.translate(F.base64(F.unhex(h)), "=", "")
    forms = F.array(F.substring(h, 1, 40), F.substring(b64, 1, 32), F.substring(F.regexp_replace(F.upper(F.base64(F.unhex(h))), "[^A-Z0-9]", ""), 1, 24), F.substring(F.regexp_replace(b64, "[+/]", ""), 3, 20))
    randoms = spark.range(0, SAMPLE_RANDOM, 1, 1).select(F.explode(forms).alias("string"), F.lit(True).alias("random"))
    texts = docs.select("doc_id", "text").where("length(text) > 0").withColumn("h", row_hash("doc_id", "text"))
    texts = texts.where(F.col("h").isin(least_hashes(texts, SAMPLE_DOCS, "doc_id", "text"))).dropDuplicates(["h"])
    words = F.filter(F.split("text", r"[^\p{L}]+"), lambda w: (F.length(w) >= 2) & w.rlike(r"^[A-Za-z]+$"))
    words = texts.select(words.alias("w")).withColumn("n", F.size("w")).where("n > 3")
    pick = lambda i: F.get(F.col("w"), F.pmod(i, F.col("n")))
    short = lambda i: F.substring(pick(i), 1, 4)
    digits = lambda i: F.pmod(i * 7, F.lit(100)).cast("string")
    made = lambda i: F.array(
        F.concat(pick(i), pick(i + 1)), F.lower(F.concat_ws("_", pick(i), pick(i + 1), pick(i + 2))), F.upper(F.concat_ws("_", pick(i), pick(i + 1))),
        F.concat(F.lower(pick(i)), F.initcap(pick(i + 1)), F.initcap(pick(i + 2))), F.concat_ws("-", pick(i), pick(i + 1), F.pmod(i * 7, F.lit(100)).cast("string")), F.concat_ws("/", pick(i), pick(i + 1), pick(i + 2)),
        F.concat(pick(i), pick(i + 1), pick(i + 2), pick(i + 3)), F.concat_ws("/", *[pick(i + j) for j in range(12)]), F.lower(F.concat_ws("-", *[pick(i + j) for j in range(9)])),
        F.upper(F.concat_ws("_", pick(i), short(i + 1), pick(i + 2), short(i + 3))), F.upper(F.concat_ws("_", short(i), F.concat(short(i + 1), digits(i)), short(i + 2), short(i + 3), pick(i + 4))),
        F.concat(F.lower(pick(i)), F.initcap(pick(i + 1)), F.upper(short(i + 2)), F.initcap(pick(i + 3)), digits(i)), F.concat(F.initcap(short(i)), F.initcap(pick(i + 1)), digits(i), F.initcap(pick(i + 2)), F.upper(short(i + 3))),
    )
    # places from the whole text, evenly
    places = F.least(F.col("n"), F.lit(SAMPLE_PLACES))
    place = lambda k: F.floor(k * F.col("n") / places).cast("int")
    ordinary = words.select(F.explode(F.flatten(F.transform(F.sequence(F.lit(0), places - 1), lambda k: made(place(k))))).alias("string"))
    # names of the words above, drawn by hash
    known, few = F.split(F.lit(WORDS), " "), F.split(F.lit(SHORT), " ")
    draw = lambda a, k: F.get(a, F.pmod(F.xxhash64("id", F.lit(k)), F.size(a)).cast("int"))
    # some cut short at either end, as identifiers abbreviate, so that all letters meet where words do
    cut = lambda k: F.substring(draw(known, k), F.pmod(F.xxhash64("id", F.lit(k + 20)), F.lit(4)).cast("int") + 1, F.pmod(F.xxhash64("id", F.lit(k + 40)), F.lit(4)).cast("int") + 3)
    w = [F.when(F.pmod(F.col("id") + k, F.lit(3)) == 0, draw(known, k)).otherwise(cut(k)) for k in range(4)]
    some = F.when(F.col("id") % 2 == 0, draw(few, 9)).otherwise(draw(known, 9))
    names = F.array(
        F.concat(w[0], F.initcap(w[1]), F.initcap(some), F.initcap(w[2])), F.concat(F.initcap(w[3]), F.initcap(some), F.initcap(w[0])), F.concat(some, F.initcap(w[1]), F.initcap(w[3]), F.initcap(some)),
        F.upper(F.concat_ws("_", w[0], some, w[2])), F.upper(F.concat_ws("_", some, w[1], w[2], w[3])), F.concat_ws("_", w[3], some, w[1]), F.concat_ws("-", w[2], w[0], some),
    )
    named = spark.range(0, SAMPLE_NAMES, 1, 1).select(F.explode(names).alias("string"))
    ruler = F.explode(F.transform(F.split(F.lit(RULERS), " "), lambda r: F.repeat(r, (8 + F.col("id") % 32).cast("int"))))
    rulers = spark.range(0, SAMPLE_RULERS, 1, 1).select(ruler.alias("string"))
    return randoms.unionAll(ordinary.unionAll(named).unionAll(rulers).select("string", F.lit(False).alias("random")))


def _pairs(s: Column) -> Column:
    """Index of each pair of neighbouring ASCII characters."""
    # characters by one split: to find one by its place takes time in proportion to the place
    codes = F.transform(F.split(s, ""), F.ascii)
    return _let(codes, lambda c: F.transform(F.sequence(F.lit(0), F.length(s) - 2), lambda i: F.get(c, i) * ASCII + F.get(c, i + 1)))


class Model:
    def __init__(self, ratios: list[float], threshold: float, bar: float = float("inf")):
        # one literal; it becomes an array once, when the plan is optimised
        self.table = ",".join(f"{x:.4f}" for x in ratios)
        self.threshold, self.bar = threshold, bar

    def _ratios(self) -> Column:
        return F.split(F.lit(self.table), ",").cast("array<double>")

    def score(self, s: Column) -> Column:
        """Mean log-likelihood ratio of the pairs of an ASCII string."""
        table = self._ratios()
        return F.aggregate(_pairs(s), F.lit(0.0), lambda a, p: a + F.get(table, p), lambda a: a / (F.length(s) - 1))

    def best(self, s: Column) -> Column:
        """The largest score of all parts of MODEL_CHARS characters, in one pass over a string that is longer."""
        table, n = self._ratios(), MODEL_CHARS - 1

        def largest(ratios: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                total = acc["total"] + F.get(ratios, i) - F.coalesce(F.get(ratios, i - n), F.lit(0.0))
                return F.struct(total.alias("total"), F.when(i >= n - 1, F.greatest(acc["most"], total)).otherwise(acc["most"]).alias("most"))

            start = F.struct(F.lit(0.0).alias("total"), F.lit(float("-inf")).alias("most"))
            return F.aggregate(F.sequence(F.lit(0), F.size(ratios) - 1), start, step, lambda acc: acc["most"] / n)

        return _let(F.transform(_pairs(s), lambda p: F.get(table, p)), largest)

    def peak(self, s: Column) -> Column:
        """The largest sum of neighbouring ratios, each less the threshold: high at a random part of any length, wherever it stands."""
        table = self._ratios()

        def step(acc: Column, p: Column) -> Column:
            total = F.greatest(F.lit(0.0), acc["total"] + F.get(table, p) - F.lit(self.threshold))
            return F.struct(total.alias("total"), F.greatest(acc["most"], total).alias("most"))

        start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("most"))
        return F.aggregate(_pairs(s), start, step, lambda acc: acc["most"])

    def random(self, token: Column) -> Column:
        whole = F.when(F.length(token) > MODEL_CHARS, self.best(token)).otherwise(self.score(token)) > self.threshold
        return whole | (self.peak(token) > self.bar) if self.bar < float("inf") else whole


def train(labelled: DataFrame) -> Model:
    """Models from (string, random). The counts collected are bounded by the alphabet's pairs.

    Both limits lie between nearly all ordinary and nearly all random samples,
    nearer to the random ones: identifiers are as many as texts have words,
    and keys are few. The bar may miss more of the random samples, as whole
    tokens are found by the threshold. Only samples count that were held out and are long enough
    to be tokens.
    """
    labelled = labelled.where(F.col("string").rlike(r"^[\x21-\x7E]{2,}$")).withColumn("held", F.pmod(F.xxhash64("string"), F.lit(HELD_OUT)) == 0)
    pairs = labelled.where("not held").select("random", F.explode(_pairs(F.col("string"))).alias("pair")).groupBy("random", "pair").agg(F.count("*").alias("n"))
    n = {True: [0.0] * ASCII**2, False: [0.0] * ASCII**2}
    for r in pairs.toLocalIterator():
        n[r.random][r.pair] = float(r.n)
    if not (any(n[True]) and any(n[False])):
        return Model([0.0] * ASCII**2, float("inf"))
    logs = {}
    for kind, counts in n.items():
        logs[kind] = _smoothed(counts)
    # a pair that neither class has shown tells nothing
    ratios = [a - b if n[True][i] or n[False][i] else 0.0 for i, (a, b) in enumerate(zip(logs[True], logs[False], strict=True))]
    tokens = labelled.where(F.col("held") & F.col("string").rlike("^" + TOKEN + "$"))

    def limits(value: Column, lost: float) -> tuple[float | None, float | None]:
        scored = tokens.select("random", value.alias("s"))
        at = scored.agg(F.percentile(F.when(~F.col("random"), F.col("s")), 0.9995).alias("o"), F.percentile(F.when(F.col("random"), F.col("s")), lost).alias("r")).first()
        return at.o, at.r

    most, least = limits(Model(ratios, 0.0).score(F.col("string")), 0.02)
    if most is None or least is None:
        return Model(ratios, 0.5)
    threshold = max(most + 0.05, (most + 3 * least) / 4)
    most, least = limits(Model(ratios, threshold).peak(F.col("string")), 0.06)
    return Model(ratios, threshold, max(most + 1.0, least))


def _smoothed(counts: list[float], strength: float = 20.0) -> list[float]:
    """Log probabilities of the second character given the first, shrunk to its overall share."""
    from math import log

    share = [0.5] * ASCII
    for i, c in enumerate(counts):
        share[i % ASCII] += c
    whole = sum(share)
    out = []
    for a in range(ASCII):
        row = counts[a * ASCII : (a + 1) * ASCII]
        total = sum(row) + strength
        out += [log((c + strength * share[b] / whole) / total) for b, c in enumerate(row)]
    return out


def find(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, and arrays of spans: assign, access, hex, added."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    with scratch(docs.sparkSession):
        model = train(labelled if labelled is not None else written(samples(docs), "samples"))
    text = F.col("text")
    assign, access, hexes = base(text)
    out = docs.select("doc_id", assign.alias("assign"), access.alias("access"), hexes.alias("hex"), spans(text, "random", TOKEN, model.random).alias("added"))
    # spans of a kind do not overlap: only the last one that starts before another's end can touch it
    touches = lambda s, known: F.coalesce(F.get(known, _earlier(known, s["end"]) - 1)["end"] > s["start"], F.lit(False))
    clear = F.filter("added", lambda s: ~(touches(s, F.col("assign")) | touches(s, F.col("access")) | touches(s, F.col("hex"))))
    return out.withColumn("added", F.when(F.size("added") > 0, clear).otherwise(F.col("added")))


def _earlier(spans: Spans, end: Column) -> Column:
    """How many of the spans, which are in order, start before ``end``: by halving."""

    def step(low: Column, bit: Column) -> Column:
        at = low + F.pow(F.lit(2.0), bit).cast("long")
        return F.when((at <= F.size(spans)) & (F.get(spans, (at - 1).cast("int"))["start"] < end), at).otherwise(low)

    return F.aggregate(F.sequence(F.lit(HALVINGS - 1), F.lit(0), F.lit(-1)), F.lit(0).cast("long"), step).cast("int")


def joined(*arrays: str) -> Column:
    every = F.array_sort(F.concat(*arrays))
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    out = find(docs)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return out.select("doc_id", *counts, F.sha2(joined("assign", "access", "hex").cast("binary"), 256).alias("base_sha256"), joined("assign", "access", "hex", "added").alias("spans"))
