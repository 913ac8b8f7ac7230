import hashlib
import random
import re

from brindle.llm import queries, secrets

ASSIGN = re.compile(r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def brute(text):
    text = text or ""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check(rows, found):
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, by.values())) == len(rows)
    for i, text in rows:
        base = brute(text)
        r = next(x for x in by[i] if x.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest())
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in secrets.KINDS[:3])
        every = [tuple(x.split(":")) for x in r.spans.split(",")] if r.spans else []
        assert [(k, int(a), int(b)) for k, a, b in every if k != "random"] == base
        for k, a, b in every:
            assert k != "random" or all(int(b) <= x or int(a) >= y for _, x, y in base)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, queries.op4_secrets(spark, sf).collect())


def test_random_texts(spark, sf):
    r = random.Random(4)
    parts = ["password", "PassWd", "token", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMN", "x", "é😀", "\n", "0f0f", "-", "/+"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(25)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, secrets.digest(docs).collect())


def test_models_tell_random_strings(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    r = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(r.choice(letters) for _ in range(32)) for _ in range(60)]
    words = [w for x in docs.select("text").collect() for w in re.findall(r"[A-Za-z]{4,9}", x.text)][:600]
    names = ["_".join(words[i : i + 4]) for i in range(0, 400, 4)] + ["".join(words[i : i + 3]) for i in range(0, 300, 3)]
    names = [n for n in names if len(n) >= 16]
    model = secrets.train(secrets.samples(docs))
    from pyspark.sql import functions as F

    score = lambda xs: [x.r for x in spark.createDataFrame([(x,) for x in xs], "t string").select(model.random(F.col("t")).alias("r")).collect()]
    assert sum(score(keys)) >= 0.9 * len(keys)
    assert sum(score(names)) <= 0.03 * len(names)


def test_rulers_constants_and_names_are_ordinary(spark, sf01):
    """Heading lines, diff marks, constants and camel-case names of words that no sample has; keys of 16 to 40 characters are found."""
    r = random.Random(21)
    model = secrets.train(secrets.samples(spark.read.parquet(f"{sf01}/documents.parquet")))
    words = "max min utf8 tcp jpeg http buffer size default retry count user session cache index parser stream handler config socket timeout value base64 sha256 node tree list map factory builder".split()
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rulers = [c * n for c in "=-_+/" for n in range(16, 56)] + ["a=b=c=d=e=f=g=h=i=", "=-" * 12, "+-" * 30, "/" * 70, "-=" * 40]
    pick = lambda k: [r.choice(words) for _ in range(k)]
    constants = [c for c in ("_".join(pick(r.randint(3, 5))).upper() for _ in range(600)) if len(c) >= 16][:400]
    camel = [c for c in ("".join(w if i == 0 else w.capitalize() for i, w in enumerate(pick(r.randint(3, 5)))) for _ in range(600)) if len(c) >= 16][:400]
    keys = ["".join(r.choice(letters) for _ in range(r.randint(16, 40))) for _ in range(400)]
    from pyspark.sql import functions as F

    rows = [(k, t) for k, ts in (("ruler", rulers), ("constant", constants), ("camel", camel), ("key", keys)) for t in ts]
    got = spark.createDataFrame(rows, "k string, t string").select("k", model.random(F.col("t")).alias("r")).groupBy("k").agg(F.avg(F.col("r").cast("int")).alias("share"))
    share = {x.k: x.share for x in got.collect()}
    assert share["ruler"] == 0 and share["constant"] <= 0.01 and share["camel"] <= 0.03 and share["key"] >= 0.98


def test_long_tokens_are_read_whole(spark, sf):
    """A key counts wherever it stands in a long token; each part of 64 characters has its score."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    r = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda: "".join(r.choice(letters) for _ in range(64))
    name = "the_other_people_number_" * 6
    model = secrets.train(secrets.samples(docs))
    tokens = [name[:at] + "/" + key() + "/" + name for at in range(65, 145, 4)] + [name + name, "-" * 5000, "deadbeef" * 20]
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", model.random(F.col("t")).alias("r"), model.best(F.col("t")).alias("best")).collect()
    assert [x.r for x in got[:20]] == [True] * 20 and not got[20].r
    ratios = [float(x) for x in model.table.split(",")]
    for x in got:
        pairs = [ratios[ord(a) * secrets.ASCII + ord(b)] for a, b in zip(x.t, x.t[1:], strict=False)]
        assert abs(x.best - max(sum(pairs[i : i + 63]) / 63 for i in range(len(pairs) - 62))) < 1e-6
    spans = secrets.digest(docs.select("doc_id", "text").where("doc_id < 200").unionAll(spark.createDataFrame([(10**9, "see " + tokens[9] + " there")], "doc_id long, text string")))
    assert spans.where("doc_id = 1000000000").first().spans == f"random:4:{4 + len(tokens[9])}"


def test_clean_documents_stay_clean(spark, sf):
    rows = queries.op4_secrets(spark, sf).collect()
    flagged = sum("random" in r.spans for r in rows)
    assert flagged <= 0.02 * len(rows)


def test_odd_rows(odd, odd_rows, none):
    check([(i, t) for i, t, *_ in odd_rows], secrets.digest(odd).collect())
    assert secrets.digest(none).count() == 0


def test_native(odd):
    plan = secrets.digest(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_very_many_matches(spark):
    """Positions take time in proportion to a text, however many matches it has."""
    rows = [(1, "enthonthreandedin " * 60_000), (2, "deadbeefdeadbeef " * 3000 + "token=abcdefghijkl " * 2000)]
    check(rows, secrets.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_keys_within_paths(spark, sf):
    """A short key is found in a long token, far from its ends and from 64 random characters."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    r = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = [w for x in docs.select("text").limit(60).collect() for w in re.findall(r"[a-z]{4,9}", x.text)]
    model = secrets.train(secrets.samples(docs))
    paths = []
    for _ in range(100):
        w = [r.choice(words) for _ in range(30)]
        key = "".join(r.choice(letters) for _ in range(24))
        paths += [("/".join([*w[:15], key, *w[15:]]), True), ("/".join(w), False)]
    from pyspark.sql import functions as F

    got = spark.createDataFrame(paths, "t string, y boolean").select("y", model.random(F.col("t")).alias("p")).collect()
    assert sum(x.p for x in got if x.y) >= 98 and sum(x.p for x in got if not x.y) <= 1


def test_random_spans_of_whole_texts(spark, sf):
    """The added spans are, by brute force, the tokens over either limit that touch no base span."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    r = random.Random(13)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    model = secrets.train(secrets.samples(docs))
    ratios = [float(x) for x in model.table.split(",")]

    def is_random(token):
        pairs = [ratios[ord(a) * secrets.ASCII + ord(b)] for a, b in zip(token, token[1:], strict=False)]
        n = secrets.MODEL_CHARS - 1
        mean = max(sum(pairs[i : i + n]) / n for i in range(len(pairs) - n + 1)) if len(token) > n + 1 else sum(pairs) / len(pairs)
        total = most = 0.0
        for x in pairs:
            total = max(0.0, total + x - model.threshold)
            most = max(most, total)
        return mean > model.threshold or most > model.bar

    rows = []
    for i, row in enumerate(docs.collect()):
        words = row.text.split()
        for _ in range(r.randrange(4)):
            made = "".join(r.choice(letters) for _ in range(r.randint(10, 90)))
            words.insert(r.randrange(len(words) + 1), r.choice([made, "token=" + made, "/".join([*words[:9], made]), "0123456789abcdef" + made, "-".join(words[:12])]))
        rows.append((i, " ".join(words)))
    sample = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.find(sample, secrets.samples(docs)).select("doc_id", "added").collect()
    some = 0
    for got in found:
        text = rows[got.doc_id][1]
        base = brute(text)
        expected = [m.span() for m in re.finditer(secrets.TOKEN, text) if is_random(m[0])]
        expected = [(a, b) for a, b in expected if all(b <= x or a >= y for _, x, y in base)]
        assert [(x.start, x.end) for x in got.added] == expected
        some += len(expected)
    assert some > 50
