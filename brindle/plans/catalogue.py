"""Rules of the storefront's literal tables over given ones: items and vendors as products and suppliers, conversations as steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import numbers, text
from brindle.operators import browse, cart, filters, review
from brindle.operators.filters import FacetSpec

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


@query("SELECT item_id, name, brand FROM items WHERE item_id = (SELECT max(item_id) FROM items) ORDER BY item_id LIMIT 1")
def item_must_exist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item that has to be there; a missing one raises."""
    items = _read(spark, sf_dir, "items")
    last = str(items.agg(F.max("item_id")).first()[0])
    found = filters.by_either(items.withColumn("id", F.col("item_id").cast("string")), last, ["id", "name"], "item_id")
    filters.must_exist(found, last)
    return found.select("item_id", "name", "brand")


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 404 ELSE 500 END WHEN event_type = 'signup' THEN 201 ELSE 200 END AS status FROM events""")
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """errors with and without a status, requests with and without one."""
    code = F.when(F.col("event_id") % 3 == 0, 404)
    raised = F.when(F.col("event_type") == "error", F.struct(code.alias("status")))
    return _read(spark, sf_dir, "events").select("event_id", filters.response(F.when(F.col("event_type") == "signup", 201), raised).alias("status"))


@query("SELECT sale_id, line_no, item_id, flag FROM sale_lines WHERE flag IN ('returned', 'swapped')")
def lines_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of any of several tags."""
    return filters.facets(_read(spark, sf_dir, "sale_lines"), FacetSpec({"flag": ["returned", "swapped"]})).select("sale_id", "line_no", "item_id", "flag")


@query("SELECT sale_id, line_no, item_id, amount FROM sale_lines WHERE vendor_id = 7")
def lines_of_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G09."""
    return browse.of_supplier(_read(spark, sf_dir, "sale_lines").withColumn("supplier", F.col("vendor_id").cast("string")), "7", "supplier").select("sale_id", "line_no", "item_id", "amount")


@query("""
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step, role AS title FROM conversations WHERE conv_id % 3 = 1""")
def numbered_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of chosen owners, kept in order and numbered from 1."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    owners = _read(spark, sf_dir, "conversations").where("conv_id % 3 = 1").groupBy("conv_id").agg(steps.alias("steps"))
    return owners.select("conv_id", F.posexplode("steps").alias("at", "title")).select("conv_id", (F.col("at") + 1).cast("long").alias("step"), "title")


@query("""
SELECT vendor_id, u.key, u.value FROM vendors, (SELECT unnest(['name', 'nation', 'balance']) AS key, unnest([name, CAST(nation_id AS VARCHAR), CASE WHEN balance < 0 THEN 'owes' ELSE 'paid' END]) AS value) u""")
def vendor_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of each row's dictionary."""
    owes = F.when(F.col("balance") < 0, "owes").otherwise("paid")
    d = F.create_map(F.lit("name"), F.col("name"), F.lit("nation"), F.col("nation_id").cast("string"), F.lit("balance"), owes)
    return _read(spark, sf_dir, "vendors").select("vendor_id", F.explode(filters.entries(d)).alias("e")).select("vendor_id", "e.key", "e.value")


@query("""
WITH d AS (SELECT sale_id, line_no, item_id, vendor_id, flag, count(*) AS n FROM sale_lines WHERE sale_id % 2 = 0 GROUP BY ALL)
SELECT sale_id, line_no, item_id, vendor_id, n, CASE WHEN flag = 'kept' THEN 'yes' END AS kept, CASE WHEN flag IS DISTINCT FROM 'kept' THEN coalesce(flag, 'none') END AS other FROM d""")
def quote_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a quote as columns; a pair that a quote lacks is null."""
    flag = F.coalesce(F.col("flag"), F.lit("none"))
    pair = F.when(flag == "kept", F.struct(F.lit("Kept").alias("k"), F.lit("yes").alias("v"))).otherwise(F.struct(F.lit("Other").alias("k"), flag.alias("v")))
    rows = _read(spark, sf_dir, "sale_lines").where("sale_id % 2 = 0").groupBy("sale_id", "line_no", "item_id", "vendor_id", "flag").agg(F.count("*").alias("n"))
    rows = rows.withColumn("m", F.map_from_entries(F.array(pair)))
    return rows.select("sale_id", "line_no", "item_id", "vendor_id", "n", *[F.try_element_at("m", F.lit(k)).alias(k.lower()) for k in ("Kept", "Other")])


@query("""
SELECT CAST(item_id AS VARCHAR) AS id, name, size || 'mm · ' || kind AS spec, brand AS origin, 'https://picsum.photos/seed/' || item_id || '/600/450' AS image FROM items""")
def featured_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D02."""
    items = _read(spark, sf_dir, "items").select(
        F.col("item_id").cast("string").alias("id"), "name", F.concat(F.col("size").cast("string"), F.lit("mm · "), "kind").alias("spec"), F.col("brand").alias("origin"),
        F.concat(F.lit("https://picsum.photos/seed/"), F.col("item_id").cast("string"), F.lit("/600/450")).alias("img"),
    )
    return cart.featured_line(items)


@query("SELECT item_id, CAST(i AS INTEGER) AS position FROM items, (SELECT unnest([0, 1, 2, 3, 4]) AS i) WHERE price IS NULL OR i < size % 3")
def item_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered rows in place of what an item has not: five without a price, else some."""
    items = _read(spark, sf_dir, "items")
    wanted = F.when(F.col("price").isNull(), 5).otherwise(F.col("size") % 3)
    rows = items.crossJoin(F.broadcast(cart.placeholders(items, 5)))  # five rows
    return rows.where(F.col("position") < wanted).select("item_id", "position")


@query("SELECT count(*) AS n, true AS whole, true AS within FROM items")
def random_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of rows that are not there yet, from 50 to 89, and not all the same."""
    w = _read(spark, sf_dir, "items").select(numbers.random_width(7).alias("w"))
    return w.agg(F.count("w").alias("n"), (F.count_distinct("w") > 1).alias("whole"), (F.min("w").between(50, 89) & F.max("w").between(50, 89)).alias("within"))


@query("""
WITH c AS (SELECT DISTINCT client_id, city FROM client_changes WHERE op = 'I' AND client_id IS NOT NULL),
p AS (SELECT DISTINCT client_id FROM c)
SELECT k.client_id, k.updated_at, CASE WHEN p.client_id IS NOT NULL THEN 'Published' WHEN k.email IS NOT NULL THEN 'Ready to Publish' ELSE 'Needs Review' END AS status
FROM clients k LEFT JOIN p USING (client_id)""")
def published_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows selected before are published, ready or not; repeated selections count once."""
    chosen = _read(spark, sf_dir, "client_changes").where("op = 'I'").select("client_id", "city")
    out = review.published(_read(spark, sf_dir, "clients").withColumn("published", F.lit(None).cast("boolean")), chosen, "client_id")
    return out.select("client_id", "updated_at", review.publication(F.col("published"), F.col("email").isNotNull()).alias("status"))


@query("""
SELECT stamp_id, coalesce(TRY_CAST(CASE WHEN regexp_matches(raw, '^[0-9]+$') THEN raw END AS DOUBLE), CASE WHEN trim(coalesce(raw, '')) = '' THEN 0 END) AS number FROM stamps
WHERE raw IS NULL OR regexp_matches(raw, '^[0-9]+$') OR trim(raw) = ''""")
def typed_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was typed as digits only, or not at all."""
    rows = _read(spark, sf_dir, "stamps").where("raw IS NULL OR raw RLIKE '^[0-9]+$' OR trim(raw) = ''")
    return rows.select("stamp_id", numbers.coerced(F.col("raw")).alias("number"))


@query("SELECT item_id, name || ' from ' || brand || '. ' || size || 'mm ' || kind || ' x. Request a quote via shop.' AS description FROM items WHERE name IS NOT NULL AND brand IS NOT NULL AND size IS NOT NULL AND kind IS NOT NULL")
def item_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D05."""
    items = _read(spark, sf_dir, "items").where("name IS NOT NULL AND brand IS NOT NULL AND size IS NOT NULL AND kind IS NOT NULL")
    return items.select("item_id", text.product_description(F.col("name"), F.col("brand"), F.col("size").cast("string"), F.col("kind"), F.lit("x"), "shop").alias("description"))
