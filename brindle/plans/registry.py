"""Queries over the star schema, and the SQL that tells the same rows.

The storefront's tables are stood in for: ``part`` for products (p_type as
category, p_brand as a facet, p_size as minimum order, p_retailprice as both
ends of the price band), ``orders`` for tickets, ``events`` for logs,
``conversations`` for ordered lines, ``labels`` for review rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import numbers, text
from brindle.operators import browse, cart, filters, pricing, review
from brindle.operators.filters import FacetSpec
from brindle.plans import browsing, catalogue, history, storefront, streams
from brindle.sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


SPEC = FacetSpec({"p_type": ["ECONOMY", "PROMO"], "p_brand": [], "p_name": []}, bounds={"p_size": 25})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that pass the facets, with the landed cost of 500 units, by key."""
    rows = filters.facets(_read(spark, sf_dir, "part"), SPEC, nullable=False)
    rows = pricing.landed_cost(rows, "p_retailprice", "p_retailprice")
    return rows.select("p_partkey", *pricing.LINES).orderBy("p_partkey")


_COST = """p_partkey,
  {q} * ((p_retailprice + p_retailprice) / 2) AS fob, {q} * 6 AS freight, {q} * ((p_retailprice + p_retailprice) / 2) * 0.2::DOUBLE AS duty,
  {q} * 2.5::DOUBLE AS cfs, {q} * 3 + {remote} AS inland,
  {q} * ((p_retailprice + p_retailprice) / 2) + {q} * 6 + {q} * ((p_retailprice + p_retailprice) / 2) * 0.2::DOUBLE + {q} * 2.5::DOUBLE + ({q} * 3 + {remote}) AS total"""


def _cost(q: str = "500.0::DOUBLE", remote: str = "0.0::DOUBLE") -> str:
    return _COST.format(q=q, remote=remote)


# --- lookups and filters ---------------------------------------------------


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 42 OR p_name = '42' ORDER BY p_partkey LIMIT 1")
def lookup_key_or_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B01."""
    part = _read(spark, sf_dir, "part").withColumn("id", F.col("p_partkey").cast("string"))
    return filters.by_either(part, "42", ["id", "p_name"], "p_partkey").select("p_partkey", "p_name", "p_brand")


@query("SELECT r_regionkey, r_name FROM region WHERE r_name = 'ASIA'")
def lookup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B02."""
    return _read(spark, sf_dir, "region").where(F.col("r_name") == "ASIA").limit(1)


@query("SELECT r_regionkey, r_name FROM region ORDER BY (r_name = 'ATLANTIS') DESC, r_regionkey LIMIT 1")
def lookup_default_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B03."""
    return filters.or_default(_read(spark, sf_dir, "region"), "r_name", "ATLANTIS", "r_regionkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO'")
def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B05."""
    return filters.facets(_read(spark, sf_dir, "part"), FacetSpec({"p_type": ["PROMO"]})).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_type, p_size FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_size <= 25")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B06, B08, B09."""
    return filters.facets(_read(spark, sf_dir, "part"), SPEC, nullable=False).select("p_partkey", "p_type", "p_size")


@query("SELECT p_partkey, p_type FROM part")
def facet_filter_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B06."""
    return filters.facets(_read(spark, sf_dir, "part"), FacetSpec({"p_type": [], "p_brand": []})).select("p_partkey", "p_type")


@query("SELECT doc_id, quality FROM labels WHERE quality = 1 AND NOT coalesce(toxic > 0, false)")
def required_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B07, B08."""
    rows = _read(spark, sf_dir, "labels").withColumn("good", F.col("quality") == 1)
    return filters.facets(rows, FacetSpec(required=["good"], bounds={"toxic": 0})).select("doc_id", "quality")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey <> 3 ORDER BY p_partkey LIMIT 4")
def exclude_self_first4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B11, E07."""
    return filters.others(_read(spark, sf_dir, "part"), "p_partkey", 3, 4, "p_partkey").select("p_partkey", "p_name")


@query("""
WITH f AS (SELECT p_partkey AS related FROM part ORDER BY p_partkey LIMIT 5),
x AS (SELECT p.p_partkey, f.related, row_number() OVER (PARTITION BY p.p_partkey ORDER BY f.related) AS position FROM part p, f WHERE p.p_partkey <> f.related)
SELECT p_partkey, related, CAST(position AS INTEGER) AS position FROM x WHERE position <= 4""")
def related_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E07."""
    return filters.others_of_each(_read(spark, sf_dir, "part"), "p_partkey", 4, "p_partkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE starts_with(o_orderpriority, '1') AND o_totalprice < 100000")
def prefix_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B13, B14."""
    return _read(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1") & (F.col("o_totalprice") < 100000)).select("o_orderkey", "o_orderpriority")


@query("""
SELECT event_id, (event_id % 2 = 1 AND contains(props || event_type, 'k') AND contains(event_type, 'e')) AS is_error FROM events""")
def guarded_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B15."""
    e = _read(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 2 == 1, 500).otherwise(499)
    kind = F.concat(F.lit("application/json;"), F.col("event_type"))
    return e.select("event_id", (filters.server_error(status, kind, F.concat("props", "event_type"), ["k"]) & F.contains(F.col("event_type"), F.lit("e"))).alias("is_error"))


@query("SELECT event_id, props FROM events WHERE NOT coalesce(event_type = 'view', false) AND (event_type IS NOT NULL OR coalesce(props, '') <> '')")
def shown_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B16."""
    e = _read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "none").otherwise(F.col("event_type"))
    return e.where(filters.shown_series(kind) & filters.coloured(F.col("event_type"), F.col("props"))).select("event_id", "props")


@query("""
SELECT p_partkey, coalesce(CASE p_type WHEN 'PROMO' THEN 'Promotion' END, CASE p_type WHEN 'LARGE' THEN 'Big' END, p_type) AS label,
       CASE p_size % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS picture FROM part""")
def dictionary_and_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B17, B18."""
    one, two = F.create_map(F.lit("PROMO"), F.lit("Promotion")), F.create_map(F.lit("LARGE"), F.lit("Big"))
    pictures = F.array(*map(F.lit, "abc"))
    return _read(spark, sf_dir, "part").select("p_partkey", filters.from_dictionary(one, two, F.col("p_type")).alias("label"), F.get(pictures, F.col("p_size") % 5).alias("picture"))


@query("""
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN trim(coalesce(role, '')) = '' THEN 'role' END, CASE WHEN trim(coalesce(text, '')) = '' THEN 'text' END,
  CASE WHEN NOT regexp_matches(role, '^[^\\s@]+@[^\\s@]+$') THEN 'email format' END], lambda x: x IS NOT NULL), ',') AS problems FROM conversations""")
def form_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B22."""
    return filters.form_problems(_read(spark, sf_dir, "conversations"), ["role", "text"], "role").select("conv_id", "turn", F.array_join("problems", ",").alias("problems"))


# --- marks and lists -------------------------------------------------------


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS added FROM customer")
def mark_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C01."""
    listed = _read(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return cart.marked(_read(spark, sf_dir, "customer"), listed, "c_custkey", "o_custkey").select("c_custkey", "added")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B12."""
    keys = _read(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return cart.removed(_read(spark, sf_dir, "customer"), keys, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("""
SELECT user_id, event_type, event_id FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""")
def cart_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E09."""
    return cart.kept_first(_read(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""
WITH l AS (SELECT user_id, event_type, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY ALL)
SELECT user_id, event_type, n, last_event FROM l WHERE n % 2 = 1""")
def toggle_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E10, E11."""
    out = cart.toggled(_read(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])
    return out.select("user_id", "event_type", "n", F.col("last.event_id").alias("last_event"))


@query("""
WITH e AS (
  SELECT user_id, ts, event_id, CAST(floor(value) % 7 AS BIGINT) AS item,
         CASE event_type WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'clear' ELSE 'add' END AS act FROM events
), c AS (
  SELECT *, max(CASE WHEN act = 'clear' THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS cleared FROM e
), a AS (SELECT * FROM c WHERE cleared IS NULL OR (ts, event_id) > cleared),
g AS (SELECT *, max(CASE WHEN act = 'remove' THEN (ts, event_id) END) OVER (PARTITION BY user_id, item) AS gone FROM a),
f AS (SELECT user_id, item, min((ts, event_id)) AS first FROM g WHERE act = 'add' AND (gone IS NULL OR (ts, event_id) > gone) GROUP BY user_id, item)
SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY first) AS position FROM f""")
def cart_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F05, E13."""
    e = _read(spark, sf_dir, "events").withColumn("item", (F.floor("value") % 7).cast("bigint"))
    act = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "clear").otherwise("add")
    return cart.replayed(e, "user_id", "item", act, ["ts", "event_id"])


@query("SELECT conv_id, string_agg('- ' || role || ' (' || coalesce(text, '') || ') · ' || '', chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def enquiry_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E03."""
    line = text.enquiry_line(F.col("role"), F.col("text"), F.lit(None).cast("string"))
    return cart.lines(_read(spark, sf_dir, "conversations"), "conv_id", "turn", line)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, A11."""
    parsed = F.from_json("props", "struct<k:bigint>")
    return _read(spark, sf_dir, "events").select("event_id", F.from_json(F.to_json(parsed), "struct<k:bigint>")["k"].alias("k"))


@query("SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def json_stored_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, A11."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").cast("string").alias("id"), F.col("role").alias("name"), F.lit(None).cast("string").alias("spec"), F.lit(None).cast("string").alias("origin"), F.lit(None).cast("string").alias("image"))
    back = cart.stored(rows, "conv_id", "turn").select("conv_id", cart.restored(F.col("stored")).alias("items"))
    return back.select("conv_id", F.size("items").cast("bigint").alias("n"), F.array_join(F.transform("items", lambda x: x["name"]), ",").alias("roles"))


# --- costs and numbers -----------------------------------------------------


@query(f"SELECT {_cost()} FROM part")
def landed_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D17."""
    return pricing.landed_cost(_read(spark, sf_dir, "part"), "p_retailprice", "p_retailprice").select("p_partkey", *pricing.LINES)


@query(f"""
SELECT city, {_cost("p_size::DOUBLE", "CASE WHEN city = 'Other' THEN 2000.0::DOUBLE ELSE 0.0::DOUBLE END")}
FROM part, (SELECT unnest([{", ".join(repr(c) for c in fixtures.CITIES)}]) AS city)""")
def landed_cost_by_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D17."""
    rows = _read(spark, sf_dir, "part").withColumn("city", F.explode(F.array(*[F.lit(c) for c in fixtures.CITIES])))
    rows = pricing.landed_cost(rows, "p_retailprice", "p_retailprice", F.col("p_size").cast("double"), F.col("city"))
    return rows.select("city", "p_partkey", *pricing.LINES)


_GROUPED = """CASE WHEN {x} < 0 THEN '-' ELSE '' END ||
  CASE WHEN abs({x}) < 1000 THEN CAST(abs({x}) AS VARCHAR) ELSE
    ltrim(reverse(regexp_replace(reverse(CAST(abs({x}) // 1000 AS VARCHAR)), '([0-9]{{2}})', '\\1,', 'g')), ',') || ',' || lpad(CAST(abs({x}) % 1000 AS VARCHAR), 3, '0') END"""


@query(f"""
WITH c AS (SELECT {_cost()} FROM part),
l AS ({" UNION ALL ".join(f"SELECT p_partkey, {i} AS line_no, '{x}' AS line, {x} AS amount FROM c" for i, x in enumerate(pricing.LINES))}),
r AS (SELECT *, CAST(floor(amount + 0.5::DOUBLE) AS BIGINT) AS rounded FROM l)
SELECT *, '₹' || {_GROUPED.format(x="rounded")} AS shown FROM r""")
def landed_cost_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D09, D19, D22."""
    return pricing.cost_lines(pricing.landed_cost(_read(spark, sf_dir, "part"), "p_retailprice", "p_retailprice"), "p_partkey")


@query(f"""
WITH r AS (SELECT o_orderkey, CAST(floor(o_totalprice * 37 - 400000) AS BIGINT) AS x FROM orders)
SELECT o_orderkey, x, {_GROUPED.format(x="x")} AS shown FROM r""")
def inr_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D22."""
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 37 - 400000).alias("x"))
    return rows.withColumn("shown", numbers.indian_grouping(F.col("x")))


@query("SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS shown FROM orders")
def default_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D23."""
    return _read(spark, sf_dir, "orders").select("o_orderkey", numbers.grouping(F.floor("o_totalprice")).alias("shown"))


@query("SELECT c_custkey, CAST(floor(c_acctbal + 0.5::DOUBLE) AS BIGINT) AS rounded FROM customer")
def js_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D19."""
    return _read(spark, sf_dir, "customer").select("c_custkey", numbers.round_half_up(F.col("c_acctbal")).alias("rounded"))


@query("SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN '' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE), 0) AS number FROM events")
def coerce_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D18."""
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, "").otherwise(F.col("event_id").cast("string"))
    return _read(spark, sf_dir, "events").select("event_id", numbers.coerced(raw).alias("number"))


@query("""
SELECT event_id, least(100.0::DOUBLE, event_id::DOUBLE / 3000.0::DOUBLE * 100.0::DOUBLE) AS percent,
       CAST(least(5, floor(event_id::DOUBLE / 3000.0::DOUBLE * 6.0::DOUBLE)) AS BIGINT) AS step,
       CASE WHEN event_id < 0 THEN 'idle' WHEN event_id < 3400 THEN 'processing' ELSE 'review' END AS stage FROM events""")
def progress_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D20, F02."""
    percent, step = numbers.progress(F.col("event_id").cast("double"))
    return _read(spark, sf_dir, "events").select("event_id", percent.alias("percent"), step.alias("step"), numbers.stage(F.col("event_id")).alias("stage"))


# --- text ------------------------------------------------------------------


@query("SELECT o_orderkey, array_to_string(list_transform(string_split(o_orderpriority, '-'), lambda w: upper(w[1:1]) || w[2:]), ' ') AS title FROM orders")
def slug_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D24."""
    return _read(spark, sf_dir, "orders").select("o_orderkey", text.slug_title(F.col("o_orderpriority")).alias("title"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) || 'mm · ' || p_brand || ' · ' || p_type AS spec, CAST(p_size AS VARCHAR) || ' · ' || p_brand AS cart_spec FROM part")
def spec_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D01, D03."""
    size = F.col("p_size").cast("string")
    return _read(spark, sf_dir, "part").select("p_partkey", text.spec_line(size, F.col("p_brand"), F.col("p_type")).alias("spec"), text.cart_spec(size, F.col("p_brand")).alias("cart_spec"))


@query("SELECT p_partkey, '₹' || CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) || '–' || CAST(CAST(floor(p_retailprice) + 10 AS BIGINT) AS VARCHAR) || ' / sqm' AS band FROM part")
def price_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D04."""
    low = F.floor("p_retailprice").cast("double")
    return _read(spark, sf_dir, "part").select("p_partkey", text.price_band(low, low + 10, F.lit("sqm")).alias("band"))


@query("""
SELECT p_partkey, CAST(u.i - 1 AS INTEGER) AS position, [CAST(p_size AS VARCHAR) || 'mm', p_brand, p_type, 'Grade A'][u.i] AS chip, (u.i - 1) % 2 = 0 AS even
FROM part, (SELECT unnest([1, 2, 3, 4]) AS i) u""")
def spec_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D06, D07."""
    chips = text.spec_chips(F.col("p_size").cast("string"), F.col("p_brand"), F.col("p_type"))
    return _read(spark, sf_dir, "part").select("p_partkey", F.posexplode(chips).alias("position", "chip")).withColumn("even", F.col("position") % 2 == 0)


_CONSTANTS = ", ".join(f"('{k}', '{v}')" for k, v in fixtures.SPEC_CONSTANTS)


@query(f"""
SELECT p_partkey, 'Material' AS k, p_type AS v FROM part UNION ALL SELECT p_partkey, 'Surface Finish', p_brand FROM part
UNION ALL SELECT p_partkey, c.k, c.v FROM part, (VALUES {_CONSTANTS}) AS c(k, v)""")
def spec_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D08."""
    pairs = [(F.lit("Material"), F.col("p_type")), (F.lit("Surface Finish"), F.col("p_brand")), *[(F.lit(k), F.lit(v)) for k, v in fixtures.SPEC_CONSTANTS]]
    rows = F.array(*[F.struct(k.alias("k"), v.alias("v")) for k, v in pairs])
    return _read(spark, sf_dir, "part").select("p_partkey", F.explode(rows).alias("x")).select("p_partkey", "x.*")


@query("""
SELECT doc_id, 'https://picsum.photos/seed/' || source || '/900/600' AS image, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, ''), nullif(source, ''), 'value') AS label,
  replace(source, ':', '') AS safe_id, CAST(doc_id AS VARCHAR) || ' product' || CASE WHEN doc_id = 1 THEN '' ELSE 's' END AS badge,
  coalesce(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END, 'products') || ' — shop' AS title FROM documents""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A09, D05, D14, D16, D25, D32."""
    lang = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang"))
    return _read(spark, sf_dir, "documents").select(
        "doc_id", text.image_url(F.col("source"), fixtures.IMAGE_PREFIX, fixtures.IMAGE_SUFFIX).alias("image"), text.first_filled(lang, F.col("source"), last="value").alias("label"),
        text.id_safe(F.col("source")).alias("safe_id"), text.plural(F.col("doc_id"), "product").alias("badge"),
        text.titled(F.when(F.col("doc_id") % 5 != 0, F.col("lang")), "products", "shop").alias("title"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%b') AS month FROM orders")
def short_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D26."""
    return _read(spark, sf_dir, "orders").select("o_orderkey", text.short_month(F.col("o_orderdate")).alias("month"))


# --- review ----------------------------------------------------------------


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Published' WHEN 'O' THEN 'Draft' ELSE 'Needs Review' END AS catalogue,
  CASE o_orderstatus WHEN 'O' THEN 'New' WHEN 'P' THEN 'In Progress' ELSE 'Closed' END AS ticket FROM orders""")
def status_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12, D13."""
    s = F.col("o_orderstatus")
    return _read(spark, sf_dir, "orders").select(
        "o_orderkey", review.by_case(s, {"F": "Published", "O": "Draft"}, "Needs Review").alias("catalogue"), review.by_case(s, {"O": "New", "P": "In Progress"}, "Closed").alias("ticket")
    )


@query("""
SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en') THEN true END AS published,
  CASE WHEN EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en') THEN 'Published' WHEN quality = 1 THEN 'Ready to Publish' ELSE 'Needs Review' END AS status
FROM labels l""")
def publish_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C02, D10, D11."""
    rows = _read(spark, sf_dir, "labels").withColumn("published", F.lit(None).cast("boolean"))
    out = review.published(rows, _read(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id")
    return out.select("doc_id", "published", review.publication(F.col("published"), F.col("quality") == 1).alias("status"))


@query("SELECT count(*) FILTER (p_type IN ('ECONOMY', 'PROMO') AND p_size <= 25) AS showing, count(*) AS total FROM part")
def showing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E01."""
    return filters.showing(_read(spark, sf_dir, "part"), SPEC)


@query("""
WITH l AS (SELECT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id) AS s FROM labels l)
SELECT count(*) FILTER (s) AS selected, count(*) AS total, count(*) FILTER (s) = count(*) AS all_selected FROM l""")
def all_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E02, E04."""
    return review.all_selected(_read(spark, sf_dir, "labels"), _read(spark, sf_dir, "documents"), "doc_id")


@query("""
SELECT o_orderkey, CAST(u.i - 1 AS INTEGER) AS position, ['Loaded', 'Sailed', 'Customs', 'On Site'][u.i] AS milestone, u.i - 1 <= o_orderkey % 5 AS reached,
  CASE WHEN u.i - 1 < 3 THEN u.i - 1 < o_orderkey % 5 END AS connected FROM orders, (SELECT unnest([1, 2, 3, 4]) AS i) u""")
def tracker_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D15."""
    names = F.array(*[F.lit(x) for x in fixtures.TRACKERS[0][2]])
    return review.milestones(_read(spark, sf_dir, "orders"), names, F.col("o_orderkey") % 5, ["o_orderkey"])


@query("""
WITH e AS (SELECT user_id, event_id, event_type, epoch_ms(ts) AS ms,
  lag(event_type) OVER w AS was, lag(epoch_ms(ts)) OVER w AS before, lag(value) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CASE WHEN was = 'error' AND ms - before <= 50000000 THEN v END AS got FROM e WHERE event_type <> 'error'""")
def ttl_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F01."""
    e = _read(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    out = review.register_reads(e, "user_id", F.col("ms"), ["ts", "event_id"], F.col("event_type") == "error", "value", ttl=50_000_000)
    return out.select("user_id", "event_id", "got")


@query("SELECT event_id, 'client' AS source, CASE WHEN event_id % 2 = 0 THEN 'override' ELSE event_type END AS route FROM events")
def report_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    context = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("route"), F.lit("override")))
    payload = review.report(context, "client", F.col("event_type"))
    return _read(spark, sf_dir, "events").select("event_id", payload["source"].alias("source"), payload["route"].alias("route"))


# --- shown but not wired up ------------------------------------------------


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 're') OR contains(lower(p_type), 're')")
def search_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G02."""
    return filters.matches_all(_read(spark, sf_dir, "part"), "RE", ["p_name", "p_type"]).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_type = 'SMALL'")
def admin_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G03."""
    return filters.equal_unless_all(_read(spark, sf_dir, "part"), {"p_type": "SMALL", "p_brand": "All"}).select("p_partkey", "p_name")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10."""
    return browse.counted(_read(spark, sf_dir, "part"), "p_type")


@query("SELECT 'p_type' AS facet, p_type AS option, count(*) AS n FROM part GROUP BY p_type UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY p_brand")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G11."""
    return browse.option_counts(_read(spark, sf_dir, "part"), ["p_type", "p_brand"])


@query("""
SELECT p_partkey, CAST(p_size AS DOUBLE) * 1000 AS low, CAST(p_size AS DOUBLE) * 100000 AS high, p_size AS least_weeks, p_size + 2 AS most_weeks FROM part""")
def parsed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12."""
    size = F.col("p_size").cast("string")
    price = text.amounts(F.concat(F.lit("₹"), size, F.lit("K–"), size, F.lit("L")))
    lead = text.lead_weeks(F.concat(size, F.lit("–"), (F.col("p_size") + 2).cast("string"), F.lit(" weeks")))
    return _read(spark, sf_dir, "part").select("p_partkey", price["low"].alias("low"), price["high"].alias("high"), lead["least"].alias("least_weeks"), lead["most"].alias("most_weeks"))


def queries() -> dict[str, Query]:
    return {**_QUERIES, **storefront.QUERIES, **history.QUERIES, **streams.QUERIES, **browsing.QUERIES, **catalogue.QUERIES}


def oracles() -> dict[str, str]:
    return {**_ORACLES, **storefront.ORACLES, **history.ORACLES, **streams.ORACLES, **browsing.ORACLES, **catalogue.ORACLES}
