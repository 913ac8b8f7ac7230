"""What the storefront's own literal tables show, for tests, and queries of its rules over given tables.

The SQL of the former states expected rows as values, so it does not depend on the tables or
functions it is compared with. The letter and number are those of the inventory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import numbers, text
from brindle.operators import browse, cart, filters, review
from brindle.operators.filters import FacetSpec
from brindle.sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SITE = "shop"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


#: What reads no table but the storefront's own literal ones: tests compare it with the rows its pages show.
SHOWN: dict[str, tuple[Query, str]] = {}


def shown(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        SHOWN[f.__name__] = f, sql
        return f

    return add


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


# --- sources ---------------------------------------------------------------


@shown("""
SELECT * FROM (VALUES
  (0, 'p1', 'Porcelain', 'China', '🇨🇳', '600×1200', 'Matt', 58.0::DOUBLE, 72.0::DOUBLE, '6–8 weeks', 200, true, 'guangdong-elite-ceramics', 4),
  (1, 'p2', 'Marble', 'Italy', '🇮🇹', '800×800', 'Glossy', 180.0, 240.0, '8–12 weeks', 100, true, 'verona-stone-works', 4),
  (2, 'p3', 'Ceramic', 'Turkey', '🇹🇷', '600×600', 'Textured', 42.0, 55.0, '4–8 weeks', 300, false, 'izmir-tile-co', 4),
  (3, 'p4', 'Ceramic', 'Spain', '🇪🇸', '600×1200', 'Glossy', 38.0, 52.0, '6–8 weeks', 250, true, 'castellon-ceramica', 4),
  (4, 'p5', 'Porcelain', 'India', '🇮🇳', '800×800', 'Satin', 28.0, 38.0, 'Under 4 weeks', 500, false, 'morbi-tile-exporters', 4),
  (5, 'p6', 'Mosaic', 'Italy', '🇮🇹', 'Custom', 'Matt', 120.0, 165.0, '8–12 weeks', 50, true, 'verona-stone-works', 4)
) t(ord, id, type, origin, origin_flag, size, finish, price_min, price_max, lead_time, moq, inspection, supplier_slug, pictures)""")
def scan_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A01, E08."""
    kept = ["ord", "id", "type", "origin", "origin_flag", "size", "finish", "price_min", "price_max", "lead_time", "moq", "inspection", "supplier_slug"]
    return fixtures.products(spark).select(*kept, F.size("gallery").alias("pictures")).orderBy("ord")


@shown("""
SELECT * FROM (VALUES (0, 'tiles-flooring', 'Tiles & Flooring', 432), (1, 'sanitaryware', 'Sanitaryware & Fittings', 180), (2, 'surface-finishes', 'Surface Finishes', 95),
  (3, 'machinery', 'Industrial Machinery', 310), (4, 'structural', 'Structural Materials', 140), (5, 'lighting', 'Lighting & Fixtures', 88)) t(ord, slug, name, count)""")
def scan_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A02."""
    return fixtures.categories(spark)


@shown("""
SELECT * FROM (VALUES ('f1', 'Guangdong', '6–8 weeks'), ('f2', 'Wenzhou', '5–7 weeks'), ('f3', 'Jinan', '10–12 weeks')) t(id, origin, lead)""")
def scan_featured_trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A03, B10."""
    return filters.facets(fixtures.featured(spark), FacetSpec({"tag": ["trending"]})).select("id", "origin", "lead")


@shown("""
SELECT * FROM (VALUES (1, '₹48–68', true), (2, '₹52–72', true), (3, '₹62–84', true), (4, '₹55–75', true), (5, '₹45–62', true), (6, '₹120–165', false),
  (7, '₹28–38', true), (8, '₹58–78', true), (9, '₹32–44', true), (10, '₹220–310', false), (11, '₹95–130', true), (12, '₹85–112', true)) t(id, price, ready)""")
def scan_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A04."""
    return fixtures.extracted(spark).select("id", "price", "ready")


@shown("""
SELECT * FROM (VALUES (1, 'Tiles & Flooring', 'Guangdong Elite', 'Published'), (2, 'Sanitaryware', 'Wenzhou Brass Works', 'Published'), (3, 'Machinery', 'Jinan Precision', 'Published'),
  (4, 'Tiles & Flooring', 'Foshan Tile Co.', 'Draft'), (5, 'Lighting', 'Shenzhen Lumens', 'Published'), (6, 'Structural', 'Tianjin Steel', 'Needs Review')) t(id, cat, sup, status)""")
def scan_admin_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A05."""
    return fixtures.admin_catalogue(spark).select("id", "cat", "sup", "status")


@shown("""
SELECT * FROM (VALUES ('CRF-2026-04821', 'Rohan Patel', 'Architect', 'New'), ('CRF-2026-04820', 'Ananya Rao', 'Interior Designer', 'In Progress'), ('CRF-2026-04819', 'Vikram Shah', 'Developer', 'Quoted'),
  ('CRF-2026-04818', 'Karthik N.', 'Machinery Buyer', 'Quoted'), ('CRF-2026-04817', 'Priya M.', 'Architect', 'Closed')) t(ref, name, role, status)""")
def scan_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A06."""
    return fixtures.tickets(spark).select("ref", "name", "role", "status")


@shown("""
SELECT * FROM (VALUES ('machinery', 1, 'Upload Machine Spec or RFQ', 'Engineer review within 4 hours'), ('machinery', 2, 'Factory Matches Across 12 Markets', 'Factory shortlist within 48 hours'),
  ('machinery', 3, 'Compare Suppliers & Capacity', 'Comparison sheet in 24 hours'), ('machinery', 4, 'Pre-Shipment Inspection & Test Run', 'Inspection report before balance payment'),
  ('machinery', 5, 'Track Shipment + Installation Handover', 'Commissioning within 14 days of arrival')) t(persona, step, title, sla)""")
def persona_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of one persona, numbered from 1."""
    chosen = fixtures.persona_steps(spark, SITE).where("persona = 'machinery'").select("persona", F.posexplode("steps").alias("at", "s"))
    return chosen.select("persona", (F.col("at") + 1).alias("step"), "s.title", "s.sla")


@shown("""
SELECT * FROM (VALUES ('architects', 'For Architects', 5), ('machinery', 'For Machinery Buyers', 5), ('businesses', 'For Businesses', 4)) t(persona, label, features)""")
def persona_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the dictionary of personas."""
    pairs = F.collect_list(F.struct("persona", F.struct("label", F.size("features").alias("n"))))
    dictionary = fixtures.persona_features(spark).agg(F.map_from_entries(pairs).alias("d"))
    return dictionary.select(F.explode(filters.entries(F.col("d"))).alias("e")).select(F.col("e.key").alias("persona"), "e.value.label", F.col("e.value.n").alias("features"))


@shown("""
SELECT * FROM (VALUES ('certificate', 'ISO 9001:2015', 'Mar 2027'), ('certificate', 'CE Marking', 'Ongoing'), ('certificate', 'Bureau Veritas QC', 'Aug 2026'),
  ('inspection', 'INS-2026-118', 'Pass'), ('inspection', 'INS-2025-091', 'Pass'), ('inspection', 'INS-2025-052', 'Pass'), ('qc', 'Raw Material', NULL), ('qc', 'Production QC', NULL),
  ('qc', 'Pre-shipment Inspection', NULL), ('qc', 'Packaging Audit', NULL), ('gallery', 'https://picsum.photos/seed/fac1/600/400', NULL), ('gallery', 'https://picsum.photos/seed/fac2/600/400', NULL),
  ('gallery', 'https://picsum.photos/seed/fac3/600/400', NULL), ('gallery', 'https://picsum.photos/seed/fac4/600/400', NULL), ('gallery', 'https://picsum.photos/seed/fac5/600/400', NULL),
  ('gallery', 'https://picsum.photos/seed/fac6/600/400', NULL)) t(kind, name, state)""")
def scan_supplier_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A08."""
    none = F.lit(None).cast("string")
    out = fixtures.certificates(spark).select(F.lit("certificate").alias("kind"), F.col("certificate").alias("name"), F.col("valid_until").alias("state"))
    out = out.unionAll(fixtures.inspections(spark).select(F.lit("inspection"), "ref", "res")).unionAll(fixtures.qc_steps(spark).select(F.lit("qc"), "step", none))
    return out.unionAll(fixtures.factory_images(spark).select(F.lit("gallery"), "image", none))


@shown("""
SELECT * FROM (VALUES ('architects', 'Verona', '₹180', '10w', '100', NULL, NULL), ('architects', 'Guangdong', '₹58', '7w', '200', NULL, NULL), ('architects', 'Castellón', '₹38', '6w', '250', NULL, NULL),
  ('machinery', 'Jiangsu', '$48k', NULL, NULL, '120 u/hr', '24 mo'), ('machinery', 'Taiwan SS', '$62k', NULL, NULL, '110 u/hr', '36 mo'), ('machinery', 'Bremen', '$89k', NULL, NULL, '140 u/hr', '24 mo')
) t(persona, supplier, fob, lead, moq, output, warranty)""")
def quote_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G08."""
    q = fixtures.quotes(spark).withColumn("m", F.map_from_entries("quote"))
    of = lambda k: F.try_element_at("m", F.lit(k)).alias(k.lower())
    return q.select("persona", "supplier", *map(of, ("FOB", "Lead", "MOQ", "Output", "Warranty")))


# --- lookups and rules -----------------------------------------------------


@shown("SELECT 'p3' AS id, 'Anatolian Travertine Floor Tile' AS name")
def product_must_exist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product that has to be there; a missing one raises."""
    found = filters.by_either(fixtures.products(spark), "anatolian-travertine", ["id", "slug"])
    filters.must_exist(found, "anatolian-travertine")
    return found.select("id", "name")


@shown("SELECT * FROM (VALUES ('p2', 'Carrara Statuario Marble Slab'), ('p6', 'Nero Mosaic Feature Wall Tile')) t(id, name)")
def products_of_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G09."""
    return browse.of_supplier(fixtures.products(spark), "verona-stone-works").select("id", "name")


@shown("""
SELECT * FROM (VALUES ('p1', 'Italian Marble Look Porcelain Tile', '600×1200 · Matt', 'China', 'https://picsum.photos/seed/tile1/900/600'),
  ('p2', 'Carrara Statuario Marble Slab', '800×800 · Glossy', 'Italy', 'https://picsum.photos/seed/tile2/900/600'),
  ('p3', 'Anatolian Travertine Floor Tile', '600×600 · Textured', 'Turkey', 'https://picsum.photos/seed/tile3/900/600'),
  ('p4', 'Valencia Glossy Ceramic Wall Tile', '600×1200 · Glossy', 'Spain', 'https://picsum.photos/seed/tile4/900/600'),
  ('p5', 'Morbi Premium Vitrified Tile', '800×800 · Satin', 'India', 'https://picsum.photos/seed/tile5/900/600'),
  ('p6', 'Nero Mosaic Feature Wall Tile', 'Custom · Matt', 'Italy', 'https://picsum.photos/seed/tile6/900/600')) t(id, name, spec, origin, image)""")
def cart_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D01."""
    return cart.product_line(fixtures.products(spark))


@shown("""
SELECT * FROM (VALUES ('f1', 'Italian Marble Look Porcelain Tile', '600×1200mm · Matt · Porcelain', 'Guangdong', 'https://picsum.photos/seed/featuretile/600/450'),
  ('f2', 'Matte Black Basin Mixer Tap', 'Brass · Single Lever · Matt Black', 'Wenzhou', 'https://picsum.photos/seed/mixer/600/450'),
  ('f3', 'CNC Laser Cutting Machine 1325', '1500W Fiber · 1300×2500mm bed', 'Jinan', 'https://picsum.photos/seed/cnc/600/450'),
  ('f4', 'Terrazzo Cement Floor Tile', '300×300mm · Honed · Cement', 'Foshan', 'https://picsum.photos/seed/terrazzo/600/450'),
  ('f5', 'LED Recessed Panel Light 60×60', '36W · 3000K/4000K · 100lm/W', 'Shenzhen', 'https://picsum.photos/seed/panel/600/450'),
  ('f6', 'Galvanised Steel C-Purlin', '200×75mm · 2.5mm · Hot-Dip Galv.', 'Tianjin', 'https://picsum.photos/seed/purlin/600/450')) t(id, name, spec, origin, image)""")
def cart_line_featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D02."""
    return cart.featured_line(fixtures.featured(spark))


@query("""
SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'Promotion' WHEN p_size % 2 = 0 AND p_type = 'LARGE' THEN 'Big' ELSE 'Any' END AS label FROM part""")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name that the config does not have falls back to the key's own entry."""
    config = F.create_map(*map(F.lit, ("PROMO", "Promotion", "LARGE", "Big", "kind", "Any")))
    payload = F.when(F.col("p_type") == "PROMO", F.create_map(F.lit("kind"), F.col("p_type"))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    nested = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("kind"), F.col("p_type")))
    return _part(spark, sf_dir).select("p_partkey", filters.configured(config, payload, nested, F.lit("kind")).alias("label"))


_EMPTY = "SELECT 'above {b}' AS bound, 'No products match these filters.' AS message WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size > {b})"


@query(" UNION ALL ".join(_EMPTY.format(b=b) for b in (10, 49, 1000)))
def empty_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three bounds, those that nothing passes."""
    found = [filters.nothing_found(_part(spark, sf_dir).where(F.col("p_size") > b), "No products match these filters.").select(F.lit(f"above {b}").alias("bound"), "message") for b in (10, 49, 1000)]
    return found[0].unionAll(found[1]).unionAll(found[2])


_BADGE = "SELECT count(*) AS n, count(*) || ' product' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END AS label FROM part WHERE {c} HAVING count(*) > 0"
_BADGES = ("p_size = 7", "p_partkey = 3", "p_size > 1000")


@query(" UNION ALL ".join(_BADGE.format(c=c) for c in _BADGES))
def sticky_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of several, of one and of none."""
    some, one, none = (cart.badge(_part(spark, sf_dir).where(c)) for c in _BADGES)
    return some.unionAll(one).unionAll(none)


@query("SELECT DISTINCT p_type FROM part WHERE p_type = 'NONE'")
def select_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E12, E13."""
    return cart.all_or_none(_part(spark, sf_dir), "p_type", every=False)


@query("SELECT p_partkey FROM part")
def select_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E12."""
    return cart.all_or_none(_part(spark, sf_dir), "p_partkey", every=True)


@shown("SELECT * FROM (VALUES (0), (1), (2), (3), (4)) t(position)")
def placeholder_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D30."""
    return cart.placeholders(fixtures.products(spark), 5)


@query("""
SELECT p_partkey, ['a', 'b', 'c'][p_size % 3 + 1] AS picture, coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END + 20, 320) * -1 AS shift,
  p_size % 2 = 1 AND NOT (p_size % 3 = 0) AND NOT (p_size % 5 = 0) AS alone FROM part""")
def small_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B21, D21, D31."""
    n = F.col("p_size")
    return _part(spark, sf_dir).select(
        "p_partkey", numbers.wrapped(n, F.array(*map(F.lit, "abc"))).alias("picture"), numbers.scroll_by(F.when(n % 2 == 0, n), F.lit(-1)).alias("shift"),
        filters.single_day(n % 2 == 1, n % 3 == 0, n % 5 == 0).alias("alone"),
    )


@shown("""
SELECT * FROM (VALUES ('p1', 'Italian Marble Look Porcelain Tile from Guangdong Elite Ceramics. 600×1200mm Matt Porcelain. Request a quote via shop.'),
  ('p6', 'Nero Mosaic Feature Wall Tile from Verona Stone Works. Custommm Matt Mosaic. Request a quote via shop.')) t(id, description)""")
def product_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D05."""
    c = {k: F.col(k) for k in ("name", "supplier", "size", "finish", "material")}
    return fixtures.products(spark).where("id IN ('p1', 'p6')").select("id", text.product_description(**c, site=SITE).alias("description"))


@query("""
SELECT p_partkey, 'Browse ' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'products' END || ' from vetted international suppliers via shop.' AS category,
  CASE WHEN p_size % 2 = 0 THEN p_type || ' from ' || p_brand || '. ' || p_size || 'mm x y. Request a quote via shop.' ELSE 'Product detail.' END AS product, 'Supplier · ' || p_brand || ' — shop' AS title FROM part""")
def page_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With and without a row."""
    name = F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
    product = text.product_description(name, F.col("p_brand"), F.col("p_size").cast("string"), F.lit("x"), F.lit("y"), SITE)
    return _part(spark, sf_dir).select("p_partkey", text.category_description(name, SITE).alias("category"), product.alias("product"), text.supplier_title(F.col("p_brand"), SITE).alias("title"))


@shown("""
SELECT * FROM (VALUES ('', 0.0::DOUBLE), (' 12 ', 12.0), ('1d', 0.0), ('2f', 0.0), ('0x10', 16.0), ('-0x10', 0.0), ('0b101', 5.0), ('0o17', 15.0), ('1e3', 1000.0), ('.5', 0.5), ('5.', 5.0), ('.', 0.0),
  ('1,000', 0.0), ('NaN', 0.0), ('Infinity', 'Infinity'::DOUBLE), ('+Infinity', 'Infinity'::DOUBLE), ('-Infinity', '-Infinity'::DOUBLE), ('inf', 0.0), ('-7', -7.0), ('1e', 0.0), ('abc', 0.0)) t(typed, number)""")
def typed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D18."""
    typed = ["", " 12 ", "1d", "2f", "0x10", "-0x10", "0b101", "0o17", "1e3", ".5", "5.", ".", "1,000", "NaN", "Infinity", "+Infinity", "-Infinity", "inf", "-7", "1e", "abc"]
    return spark.createDataFrame([(x,) for x in typed], "typed string").select("typed", numbers.coerced(F.col("typed")).alias("number"))


@shown("""
SELECT * FROM (VALUES (58.0::DOUBLE, '58'), (12345678.5, '12345678.5'), (0.0005, '0.0005'), (0.000001, '0.000001'), (0.0000001, '1e-7'), (1e20, '100000000000000000000'), (1e21, '1e+21'),
  (1.5e300, '1.5e+300'), (-2.5, '-2.5'), (0.1, '0.1'), (9223372036854775808.0, '9223372036854776000'), (0.0, '0')) t(x, shown)""")
def plain_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D04."""
    xs = [58.0, 12345678.5, 0.0005, 0.000001, 0.0000001, 1e20, 1e21, 1.5e300, -2.5, 0.1, 9223372036854775808.0, 0.0]
    return spark.createDataFrame([(x,) for x in xs], "x double").select("x", numbers.plain(F.col("x")).alias("shown"))


@shown("SELECT * FROM (VALUES (1, 'Published'), (6, 'Published'), (10, 'Needs Review')) t(id, status)")
def publish_kept_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another upload resets the rows but not the selection, so rows selected before are published, ready or not."""
    selection = spark.createDataFrame([(1,), (6,)], "id int")
    first = review.published(fixtures.extracted(spark), selection, "id")
    again = fixtures.extracted(spark).join(first.select("id"), "id", "left_semi")
    out = review.published(again, selection, "id").where("id IN (1, 6, 10)")
    return out.select("id", review.publication(F.col("published"), F.col("ready")).alias("status"))
