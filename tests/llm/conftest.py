import os
import random

import pytest

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

#: Columns that clash with names the operators use inside.
EXTRA = "size long, label long, key string, score double, shard int, rank double, target double, n long, h1 long, copy int, held int, source_size long, sig long"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("driver tables are not here")
    return SF


@pytest.fixture(scope="session")
def sf01():
    if not os.path.isdir(SF01):
        pytest.skip("driver tables are not here")
    return SF01


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "ä", "日本", "😀"]
    prose = lambda n: " ".join(r.choice(words) + r.choice(["", "", ".", ","]) for _ in range(n))
    long = prose(30_000)
    base = prose(60)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, None, None, None), (4, "", "", ""), (5, " \t\n\x0b\x0c\r ", "de", "b"),
        (None, base, "en", "a"), (None, None, None, None), (6, long, "fr", "c"), (7, long + " end", "fr", "c"), (8, "one", "en", "b"), (9, "one", "en", "b"),
        (10, "x" * 50_000, "en", "b"), (11, "1" * 3000 + "@" * 50, "en", "b"), (12, "a b c", "en", "b"), (13, prose(200), "en", "d"), (14, prose(200) + "\n" + base, "en", None),
    ]
    return rows


@pytest.fixture
def odd(spark, odd_rows):
    names = [c.split()[0] for c in EXTRA.split(", ")]
    rows = [(*r, len(r[1] or ""), *[None] * len(names)) for r in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (6, None, None), (None, 1, 1), (13, 1, 1)], "doc_id long, quality int, toxic int")
