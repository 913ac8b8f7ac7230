"""Each query against its SQL in DuckDB, on the smallest driver tables."""

import decimal
import math
import os

import duckdb
import pytest

from brindle.plans import registry, storefront

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, decimal.Decimal):
        return float(v)
    return list(v) if isinstance(v, (list, tuple)) else v


def same(df, con, sql):
    cols = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    theirs = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in got.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    same(registry.queries()[name](spark, SF), duck, registry.oracles()[name])


@pytest.mark.parametrize("name", sorted(storefront.SHOWN))
def test_what_the_pages_show(spark, duck, name):
    query, sql = storefront.SHOWN[name]
    same(query(spark, SF), duck, sql)


def test_flagship(spark):
    rows = registry.flagship(spark, SF).collect()
    assert rows and [r.p_partkey for r in rows] == sorted(r.p_partkey for r in rows)


def test_facets_reach_the_scan(spark):
    from brindle.operators import filters

    df = filters.facets(spark.read.parquet(f"{SF}/part.parquet"), registry.SPEC, nullable=False).select("p_partkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "In(p_type" in plan and "LessThanOrEqual(p_size" in plan
    assert "p_retailprice" not in plan
