import hashlib
import random
from urllib.parse import urlsplit

import pytest

from brindle.llm import queries, warc
from brindle.llm.common import new_path


def brute_key(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else url
    rest = rest.split("#", 1)[0]
    if not rest:
        return ""
    cut = min([rest.find(c) for c in "/?" if c in rest] or [len(rest)])
    host, path = rest[:cut].lower(), rest[cut:] or "/"
    host = host.split(".", 1)[1] if host.startswith("www.") else host
    return ",".join(reversed(host.split("."))) + ")" + path


def brute(pages):
    first = {}
    for i, _, html in pages:
        raw = (html or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(first.get(raw, i), i)
    out = []
    for i, url, html in pages:
        raw = (html or "").encode()
        to = first.get(raw)
        to = to if to is not None and (i is None or i > to) else None
        out.append((brute_key(url), i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=lambda x: (x[0], x[1] is not None, x[1] or 0))


def test_round_trip(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted(queries.op2_warc(spark, sf).collect(), key=lambda r: r.position)
    assert [(r.url_key, r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got] == brute(rows)
    assert [r.position for r in got] == list(range(len(rows)))


def test_odd_pages(spark):
    long = "<p>" + "ü" * 200
    rows = [
        (1, "http://www.A.example/x?q=1#f", long, "n"), (2, "https://a.example/x?q=1", long, "n"), (2, "https://a.example/x?q=1", long, "n"), (None, "http://b.example", long, None),
        (3, None, None, None), (4, "", "", ""), (5, "c.example\r\n", "\r\n\r\nWARC/1.1\r\n\r\n" * 20, "x"), (6, "http://d.example/", "x" * 300_000, "x"), (7, "http://d.example/", "short", "x"), (8, "http://d.example/", "short", "x"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, position string")
    got = sorted(warc.digest(df).collect(), key=lambda r: r.position)
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in got) == sorted((i or -1, n, d, t, to or -1) for _, i, n, d, t, to in brute([r[:3] for r in rows]))
    keys = [(r.url_key, r.page_id is not None, r.page_id or 0) for r in got]
    assert keys == sorted(keys)
    assert warc.digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_payloads_come_back(spark):
    rows = [(i, f"http://h{i % 3}.example/{i}", "".join(random.Random(i).choice("abc\r\né😀\x1f") for _ in range(i * 37))) for i in range(40)]
    path = new_path(spark, "test")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    members = spark.read.option("lineSep", warc.LATIN).option("encoding", "ISO-8859-1").text(path).selectExpr("cast(value as binary) as m").collect()
    import zlib

    back = {(x := warc.parsed(zlib.decompress(bytes(r.m), 31)))["page_id"]: x["payload"].decode() for r in members}
    assert back == {i: html for i, _, html in rows}


def test_damage_is_seen():
    raw = warc.record(1, "http://a.example", "k", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parsed(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parsed(raw.replace(b"payload", b"paylaod"))


def test_loser_tree():
    r = random.Random(2)
    for _ in range(300):
        runs = [sorted([(r.choice("abc"), r.choice("xy"), r.choice([None, *range(5)])) for _ in range(r.randrange(7))], key=warc.sort_key) for _ in range(r.randrange(10))]
        assert list(warc.LoserTree(runs)) == sorted((x for run in runs for x in run), key=warc.sort_key)


def test_keys_follow_urls():
    assert urlsplit("http://x.example/a").netloc == "x.example"
    assert brute_key("https://www.b.a.example/p?q#f") == "example,a,b)/p?q"


def test_sql_tells_the_same(spark, sf):
    import duckdb

    from tests.test_queries import TABLES, same

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        same(queries.QUERIES[name](spark, sf), con, sql)


def test_ids_of_any_size(spark):
    ids = [-(1 << 63), -(1 << 40), -1, 0, 10**12, (1 << 63) - 1]
    rows = [(i, "http://a.example/", "p" * 150) for i in ids] + [(10**12, "http://a.example/", "q" * 150)]
    got = sorted(warc.digest(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r.position)
    assert [r.page_id for r in got] == sorted(i for i, _, _ in rows)
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {-(1 << 63)}
    times = [warc.captured(i) for i in ids]
    assert times == sorted(times) and {len(t) for t in times} == {20}


def _blocks(runs):
    out = []
    for number, run in enumerate(runs):
        out += warc.blocked(number, 0, sorted(((*c, *[None] * (7 - len(c))) for c in run), key=warc.sort_key))
    return sorted(out, key=lambda b: (*warc.sort_key(b[2:5]), b[0], b[1]))


def test_streamed_merge(monkeypatch):
    r = random.Random(6)
    monkeypatch.setattr(warc, "BLOCK_ROWS", 3)
    for _ in range(200):
        keys = r.choice(["a", "ab", "abcdef"])
        runs = [[(r.choice(keys), r.choice("xy"), r.choice([None, *range(r.choice([1, 40]))])) for _ in range(r.randrange(40))] for _ in range(r.randrange(6))]
        got = [x[:3] for x in warc.streamed(_blocks(runs))]
        assert got == sorted((x for run in runs for x in run), key=warc.sort_key)


def _held(runs):
    """Captures taken in and not handed on yet, at most; and all of them in order."""
    taken = given = most = 0

    def incoming():
        nonlocal taken, most
        for block in _blocks(runs):
            taken += len(block[-1])
            most = max(most, taken - given)
            yield block

    rows = []
    for row in warc.streamed(incoming()):
        given += 1
        rows.append(row[:3])
    return most, rows


def test_merge_holds_little():
    """1,000 runs of 200 captures each, which all overlap: level by level no task holds 5 % of them."""
    r = random.Random(9)
    keys = list(range(200_000))
    r.shuffle(keys)
    runs = [[("k", "t", k) for k in keys[at : at + 200]] for at in range(0, len(keys), 200)]
    most = 0
    while len(runs) > 1:
        groups = [runs[at : at + warc.FAN_IN] for at in range(0, len(runs), warc.FAN_IN)]
        found = [_held(group) for group in groups]
        most, runs = max(most, *(m for m, _ in found)), [rows for _, rows in found]
    assert runs == [[("k", "t", k) for k in range(200_000)]]
    assert most < 0.05 * 200_000


def test_levels_of_the_merge(spark, monkeypatch):
    """More runs than are merged at once, blocks cut at the bounds of ranges, one URL in most captures, repeated captures."""
    r = random.Random(4)
    captures = [(r.choice(["hot", "hot", "hot", f"k{r.randrange(60)}"]), r.choice("xy"), r.choice([None, *range(30), r.randrange(10**9)]), 1, "d", "response", None) for _ in range(3000)]
    monkeypatch.setattr(warc, "BLOCK_ROWS", 7)
    monkeypatch.setattr(warc, "FAN_IN", 3)
    monkeypatch.setattr(warc, "RANGE_ROWS", 100)
    blocks = []
    for task in range(7):
        for number in range(r.choice([1, 4, 6])):
            run = [captures.pop() for _ in range(min(len(captures), r.randrange(1, 110)))]
            blocks += [((task << warc.TASK_BITS) + number, run)]
    rows = [b for number, run in blocks for b in warc.blocked(number, 0, sorted(run, key=warc.sort_key))]
    sizes = {b[8] for b in rows}
    assert 7 in sizes
    with warc.scratch(spark):
        written = warc.written(spark.createDataFrame(rows, warc.BLOCKS), "test")
        got = sorted(warc.merged(written).collect(), key=lambda x: x.position)
    wanted = sorted((c for _, run in blocks for c in run), key=warc.sort_key)
    assert [tuple(x)[:3] for x in got] == [c[:3] for c in wanted]
    assert [x.position for x in got] == list(range(len(wanted)))
