"""Queries for what is shown but not wired up: sort orders, counts under choices, ranked search, edits, totals by level, safe sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import aggregates, browse, search
from brindle.operators.filters import FacetSpec
from brindle.plans.history import cents
from brindle.sources import ledger, sinks
from brindle.sources.shared import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- sort orders -----------------------------------------------------------


def _sorted(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    weeks = F.col("p_size") % 7
    part = _read(spark, sf_dir, "part").withColumn("lead_time", F.concat(weeks + 1, F.lit("–"), weeks + 1 + F.col("p_partkey") % 3, F.lit(" weeks")))
    keys = browse.sort_keys(by, price="p_retailprice", moq="p_size")
    return browse.placed(part, keys, "p_partkey").select("p_partkey", F.col("position").cast("long").alias("position"))


_PLACE = "SELECT p_partkey, row_number() OVER (ORDER BY {}) AS position FROM part"


@query(_PLACE.format("p_partkey"))
def sort_recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G01."""
    return _sorted(spark, sf_dir, "recommended")


@query(_PLACE.format("p_retailprice, p_partkey"))
def sort_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G01."""
    return _sorted(spark, sf_dir, "price")


@query(_PLACE.format("p_size % 7, p_size % 7 + p_partkey % 3, p_partkey"))
def sort_lead_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G01."""
    return _sorted(spark, sf_dir, "lead time")


@query(_PLACE.format("p_size, p_partkey"))
def sort_moq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G01."""
    return _sorted(spark, sf_dir, "moq")


# --- counts and totals -----------------------------------------------------

_CHOSEN = FacetSpec({"p_type": ["ECONOMY", "PROMO"], "p_brand": ["Brand#2", "Brand#17", "Brand#5"]}, bounds={"p_size": 25})
_TYPE, _BRAND, _SIZE = "p_type IN ('ECONOMY', 'PROMO')", "p_brand IN ('Brand#2', 'Brand#17', 'Brand#5')", "p_size <= 25"


@query(f"""
SELECT 'p_type' AS facet, p_type AS option, count(*) AS n FROM part WHERE {_BRAND} AND {_SIZE} GROUP BY p_type
UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part WHERE {_TYPE} AND {_SIZE} GROUP BY p_brand
UNION ALL SELECT 'p_name', p_name, count(*) FROM part WHERE {_TYPE} AND {_BRAND} AND {_SIZE} GROUP BY p_name""")
def facet_counts_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two facets with choices, one without, and a bound."""
    return browse.option_counts_chosen(_read(spark, sf_dir, "part"), _CHOSEN, ["p_type", "p_brand", "p_name"])


_REVENUE = """
SELECT l_returnflag, l_linestatus, year(l_shipdate) AS year, CAST(grouping_id(l_returnflag, l_linestatus, year(l_shipdate)) AS BIGINT) AS level,
  count(*) AS n, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5::DOUBLE) AS BIGINT)) AS BIGINT) AS revenue
FROM lineitem GROUP BY {} (l_returnflag, l_linestatus, year(l_shipdate))"""


def _revenue(spark: SparkSession, sf_dir: str, sets: Callable) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("year"), cents("l_extendedprice").alias("cents"))
    columns = ["l_returnflag", "l_linestatus", "year"]
    return aggregates.by_levels(rows, columns, sets(columns), n=F.count("*"), revenue=F.sum("cents"))


@query(_REVENUE.format("CUBE"))
def revenue_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by return flag, line status and year, and over all of any of them."""
    return _revenue(spark, sf_dir, aggregates.cube_sets)


@query(_REVENUE.format("ROLLUP"))
def revenue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the last, the last two, or all."""
    return _revenue(spark, sf_dir, aggregates.rollup_sets)


@query("""
SELECT source, segment, CAST(grouping_id(source, segment) AS BIGINT) AS level, count(*) AS n, count(DISTINCT client_id) AS clients FROM clients
GROUP BY GROUPING SETS ((source, segment), (segment), ())""")
def clients_by_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and clients by source and segment, with nulls in both, at three levels."""
    return aggregates.by_levels(_read(spark, sf_dir, "clients"), ["source", "segment"], [["source", "segment"], ["segment"], []], n=F.count("*"), clients=F.count_distinct("client_id"))


@query("SELECT kind, count(*) AS n, true AS distinct_near, true AS median_near FROM clicks GROUP BY kind")
def clicks_from_daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients and the median value of each kind of click, from states stored by day: within 5 % and 3 % of ranks of the exact ones."""
    clicks = _read(spark, sf_dir, "clicks")
    daily = aggregates.sketched(clicks.withColumn("day", F.to_date("ts")), ["kind", "day"], {"clients": "client_id"}, {"value_state": "value"})
    path = new_folder(spark, "sketches")
    daily.write.parquet(path)
    whole = aggregates.merged(spark.read.parquet(path), ["kind"], ["clients"], ["value_state"])
    exact = clicks.groupBy("kind").agg(F.count_distinct("client_id").alias("exact"))
    out = whole.alias("w").join(exact.alias("e"), F.col("w.kind").eqNullSafe(F.col("e.kind")))
    near = F.abs(F.hll_sketch_estimate("clients") - F.col("exact")) <= 0.05 * F.col("exact") + 1
    # the shares of values below and up to what the state gives as the median: half of all lies between
    given = out.select("w.kind", F.col("w.n").alias("n"), near.alias("distinct_near"), aggregates.quantile_of("value_state", 0.5).alias("given"))
    at = clicks.select(F.col("kind").alias("of"), "value").join(F.broadcast(given), F.col("of").eqNullSafe(F.col("kind")))
    below, upto = (F.count_if(c) / F.count("value") for c in (F.col("value") < F.col("given"), F.col("value") <= F.col("given")))
    half = (below <= 0.53) & (upto >= 0.47)
    return at.groupBy("kind", "n", "distinct_near").agg(half.alias("median_near"))


_SLICES = "a AS (SELECT o_custkey, o_orderstatus FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT o_custkey, o_orderstatus FROM orders WHERE year(o_orderdate) = 1997)"


def _slices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = _read(spark, sf_dir, "orders")
    return tuple(orders.where(F.year("o_orderdate") == y).select("o_custkey", "o_orderstatus") for y in (1996, 1997))


@query(f"WITH {_SLICES} SELECT * , 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def status_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' order states of one year that the next has less often, or more often."""
    return aggregates.multiset(*_slices(spark, sf_dir), keep="moved")


@query(f"WITH {_SLICES} SELECT * FROM a INTERSECT ALL SELECT * FROM b")
def status_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those that both years have, as often as both have them."""
    return aggregates.multiset(*_slices(spark, sf_dir), keep="both")


@query("SELECT client_id, status FROM sales EXCEPT ALL SELECT client_id, 'done' FROM sales WHERE priority > 2")
def sales_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with nulls and a client with very many equal ones."""
    sales = _read(spark, sf_dir, "sales")
    return aggregates.multiset(sales.select("client_id", "status"), sales.where("priority > 2").select("client_id", F.lit("done").alias("status")), keep="rest")


# --- search ----------------------------------------------------------------

_TERMS = r"""
t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS term FROM documents),
s AS (SELECT doc_id, count(*) AS size FROM t GROUP BY doc_id),
p AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL)"""
_WORDS = ("the", "lorem", "is", "être", "und")


@query(f"""
WITH {_TERMS}, g AS (SELECT count(*) AS docs, (SELECT count(*) FROM t) / count(*) AS mean FROM documents),
v AS (SELECT term, count(*) AS docs FROM p GROUP BY term)
SELECT p.doc_id, round(sum(ln(1.0::DOUBLE + (g.docs - v.docs + 0.5::DOUBLE) / (v.docs + 0.5::DOUBLE)) * n * 2.2::DOUBLE / (n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / g.mean))), 6) AS score, count(*) AS matched
FROM p JOIN v USING (term) JOIN s ON s.doc_id = p.doc_id, g WHERE term IN {_WORDS} GROUP BY p.doc_id""")
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with any of the words, by BM25."""
    index = search.write_index(_read(spark, sf_dir, "documents"), "doc_id", "text", new_folder(spark, "index"))
    return search.ranked(index, _WORDS).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "matched")


@query(f"WITH {_TERMS} SELECT term, count(*) AS docs FROM p WHERE starts_with(term, 'th') GROUP BY term ORDER BY docs DESC, term LIMIT 8")
def search_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most frequent terms that begin as typed."""
    index = search.write_index(_read(spark, sf_dir, "documents"), "doc_id", "text", new_folder(spark, "index"))
    return search.suggested(index, "Th", 8)


# --- edits and sinks -------------------------------------------------------


@query("""
WITH e AS (SELECT client_id, change_id, op, city, balance FROM (SELECT DISTINCT * FROM client_changes)),
c AS (SELECT client_id, max((change_id, city IS NOT NULL, city)) FILTER (city IS NOT NULL OR op = 'D') AS city, max((change_id, balance IS NOT NULL, balance)) FILTER (balance IS NOT NULL OR op = 'D') AS balance FROM e GROUP BY client_id)
SELECT k.client_id, k.updated_at, CASE WHEN c.city IS NOT NULL THEN c.city[3] ELSE k.city END AS city, CASE WHEN c.balance IS NOT NULL THEN c.balance[3] ELSE k.balance END AS balance
FROM clients k LEFT JOIN c ON k.client_id = c.client_id""")
def edit_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last edit of each cell, some of which clear it; several edits of a row."""
    gone = F.when(F.col("op") == "D", F.array(F.lit("city"), F.lit("balance")))
    edits = _read(spark, sf_dir, "client_changes").select("client_id", "change_id", "city", "balance", gone.alias("cleared"))
    return browse.edited(_read(spark, sf_dir, "clients"), edits, "client_id", ["city", "balance"], order="change_id", clear="cleared").select("client_id", "updated_at", "city", "balance")


@query(r"""
SELECT client_id, name, segment AS company, email FROM clients
WHERE trim(coalesce(name, '')) <> '' AND trim(coalesce(segment, '')) <> '' AND trim(coalesce(email, '')) <> '' AND regexp_matches(email, '^[^\s@]+@[^\s@]+$')""")
def enquiries_stored_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete forms from a stream whose first attempt fails between the rows and their entry; each is there once."""
    forms = _read(spark, sf_dir, "clients").select("client_id", "name", F.col("segment").alias("company"), "email")
    folder = new_folder(spark, "forms")
    forms.write.parquet(f"{folder}/in")
    stream = lambda: sinks.complete(spark.readStream.schema(forms.schema).parquet(f"{folder}/in"))

    def fail() -> None:
        raise RuntimeError("stopped before the entry")

    try:
        ledger.write_stream(stream(), f"{folder}/out", f"{folder}/checkpoint", fail).awaitTermination()
    except Exception as error:
        if "stopped before the entry" not in str(error):
            raise
    ledger.write_stream(stream(), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return ledger.committed(spark, f"{folder}/out", "client_id long, name string, company string, email string").drop("batch")

