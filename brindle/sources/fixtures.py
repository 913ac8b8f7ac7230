"""Literal tables of the storefront as DataFrames.

The rows are fixed values: results depend on their exact text. ``ord`` is the
position of a row in its list, which serves as the tie-break wherever the first
match or the first few rows are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values
CATEGORIES = [
    ("tiles-flooring", "Tiles & Flooring", 432),
    ("sanitaryware", "Sanitaryware & Fittings", 180),
    ("surface-finishes", "Surface Finishes", 95),
    ("machinery", "Industrial Machinery", 310),
    ("structural", "Structural Materials", 140),
    ("lighting", "Lighting & Fixtures", 88),
]
#: id, slug, name, type, origin, size, finish, material, price_min, price_max, lead_time, moq, sample, inspection, supplier, supplier_slug, seed
PRODUCTS = [
    ("p1", "italian-marble-look-porcelain", "Italian Marble Look Porcelain Tile", "Porcelain", "China", "600×1200", "Matt", "Porcelain", 58.0, 72.0, "6–8 weeks", 200, True, True, "Guangdong Elite Ceramics", "guangdong-elite-ceramics", "tile1"),
    ("p2", "carrara-statuario-marble", "Carrara Statuario Marble Slab", "Marble", "Italy", "800×800", "Glossy", "Marble", 180.0, 240.0, "8–12 weeks", 100, True, True, "Verona Stone Works", "verona-stone-works", "tile2"),
    ("p3", "anatolian-travertine", "Anatolian Travertine Floor Tile", "Ceramic", "Turkey", "600×600", "Textured", "Travertine", 42.0, 55.0, "4–8 weeks", 300, True, False, "Izmir Tile Co.", "izmir-tile-co", "tile3"),
    ("p4", "valencia-glossy-ceramic", "Valencia Glossy Ceramic Wall Tile", "Ceramic", "Spain", "600×1200", "Glossy", "Ceramic", 38.0, 52.0, "6–8 weeks", 250, True, True, "Castellón Ceramica", "castellon-ceramica", "tile4"),
    ("p5", "morbi-vitrified-tile", "Morbi Premium Vitrified Tile", "Porcelain", "India", "800×800", "Satin", "Vitrified", 28.0, 38.0, "Under 4 weeks", 500, True, False, "Morbi Tile Exporters", "morbi-tile-exporters", "tile5"),
    ("p6", "nero-mosaic-feature", "Nero Mosaic Feature Wall Tile", "Mosaic", "Italy", "Custom", "Matt", "Mosaic", 120.0, 165.0, "8–12 weeks", 50, True, True, "Verona Stone Works", "verona-stone-works", "tile6"),
]
FLAGS = {"China": "🇨🇳", "Italy": "🇮🇹", "Turkey": "🇹🇷", "Spain": "🇪🇸", "India": "🇮🇳"}
FACETS = {
    "type": ["Porcelain", "Ceramic", "Marble", "Mosaic", "Travertine", "Vitrified"],
    "origin": ["China", "Italy", "Turkey", "Spain", "India"],
    "size": ["600×600", "600×1200", "800×800", "Custom"],
    "finish": ["Matt", "Glossy", "Satin", "Textured"],
    "lead_time": ["Under 4 weeks", "4–8 weeks", "8–12 weeks"],
}
CITIES = ["Mumbai", "Delhi", "Chennai", "Bangalore", "Hyderabad", "Pune", "Other"]
FEATURED = [
    ("f1", "Italian Marble Look Porcelain Tile", "600×1200mm · Matt · Porcelain", "₹58–72 / sqm (FOB)", "Guangdong", "6–8 weeks", "featuretile", "trending"),
    ("f2", "Matte Black Basin Mixer Tap", "Brass · Single Lever · Matt Black", "₹3,200–4,800 / unit (FOB)", "Wenzhou", "5–7 weeks", "mixer", "trending"),
    ("f3", "CNC Laser Cutting Machine 1325", "1500W Fiber · 1300×2500mm bed", "₹4.2L–5.8L / unit (FOB)", "Jinan", "10–12 weeks", "cnc", "trending"),
    ("f4", "Terrazzo Cement Floor Tile", "300×300mm · Honed · Cement", "₹85–110 / sqm (FOB)", "Foshan", "6–8 weeks", "terrazzo", "new"),
    ("f5", "LED Recessed Panel Light 60×60", "36W · 3000K/4000K · 100lm/W", "₹680–920 / unit (FOB)", "Shenzhen", "4–6 weeks", "panel", "new"),
    ("f6", "Galvanised Steel C-Purlin", "200×75mm · 2.5mm · Hot-Dip Galv.", "₹62–78 / kg (FOB)", "Tianjin", "6–8 weeks", "purlin", "new"),
]
EXTRACTED = [
    (1, "Marble Look Porcelain — Calacatta", "600×1200mm · Matt · Porcelain", "₹48–68", "6–8 weeks", True),
    (2, "Marble Look Porcelain — Statuario", "600×1200mm · Glossy · Porcelain", "₹52–72", "6–8 weeks", True),
    (3, "Wood Look Plank Tile — Oak", "200×1200mm · Matt · Porcelain", "₹62–84", "8–10 weeks", True),
    (4, "Terrazzo Look Tile — Grey", "600×600mm · Honed · Porcelain", "₹55–75", "6–8 weeks", True),
    (5, "Concrete Look Tile — Industrial", "600×600mm · Matt · Porcelain", "₹45–62", "6–8 weeks", True),
    (6, "Mosaic Hexagon — Carrara", "Hexagonal · 100mm · Marble", "₹120–165", "8–12 weeks", False),
    (7, "Subway Tile — Gloss White", "75×150mm · Glossy · Ceramic", "₹28–38", "4–6 weeks", True),
    (8, "Outdoor Anti-Skid — Slate Grey", "300×600mm · R11 · Porcelain", "₹58–78", "6–8 weeks", True),
    (9, "Bathroom Wall Tile — Beige", "300×600mm · Glossy · Ceramic", "₹32–44", "4–6 weeks", True),
    (10, "Large Format Slab — Onyx", "1200×2400mm · Polished · Porcelain", "₹220–310", "10–12 weeks", False),
    (11, "Mosaic Penny Round — Black", "20mm round · Matt · Porcelain", "₹95–130", "6–8 weeks", True),
    (12, "Pool Tile — Aqua Blue", "240×115mm · Glossy · Porcelain", "₹85–112", "8–10 weeks", True),
]
ADMIN_CATALOGUE = [
    (1, "Italian Marble Look Porcelain", "Tiles & Flooring", "Guangdong Elite", "₹58–72", "Published"),
    (2, "Matte Black Basin Mixer Tap", "Sanitaryware", "Wenzhou Brass Works", "₹3.2K–4.8K", "Published"),
    (3, "CNC Laser Cutting Machine 1325", "Machinery", "Jinan Precision", "₹4.2L–5.8L", "Published"),
    (4, "Terrazzo Cement Floor Tile", "Tiles & Flooring", "Foshan Tile Co.", "₹85–110", "Draft"),
    (5, "LED Recessed Panel 60×60", "Lighting", "Shenzhen Lumens", "₹680–920", "Published"),
    (6, "Galvanised Steel C-Purlin", "Structural", "Tianjin Steel", "₹62–78", "Needs Review"),
]
TICKETS = [
    ("CRF-2026-04821", "Rohan Patel", "Studio Linework", "Architect", "Porcelain tile (500sqm), Basin mixer (24)", "29 Jun 2026", "New"),
    ("CRF-2026-04820", "Ananya Rao", "Built Forms", "Interior Designer", "Marble slab (180sqm)", "29 Jun 2026", "In Progress"),
    ("CRF-2026-04819", "Vikram Shah", "ShahCon Pvt", "Developer", "Vitrified tile (12000sqm)", "28 Jun 2026", "Quoted"),
    ("CRF-2026-04818", "Karthik N.", "Madras Mech", "Machinery Buyer", "CNC laser cutter (2 units)", "28 Jun 2026", "Quoted"),
    ("CRF-2026-04817", "Priya M.", "M&M Interiors", "Architect", "Recessed LED panels (140)", "27 Jun 2026", "Closed"),
]
TRACKERS = [
    ("CRF-2026-04821", "1×40HC · Tiles", ["Loaded", "Sailed", "Customs", "On Site"], 2),
    ("CRF-2026-04822", "1×40OT · Machinery", ["FAT", "Loaded", "Sailed", "Commissioned"], 2),
    ("CRF-2026-04823", "2×40HC · Packaging", ["Loaded", "Sailed", "Port", "Warehouse"], 3),
]
MATCH_SCORES = [
    ("architects", "Verona Stone Works", 94), ("architects", "Guangdong Elite Ceramics", 88), ("architects", "Castellón Ceramica", 81),
    ("machinery", "Jiangsu Precision Tools", 92), ("machinery", "Taiwan Servo Systems", 86), ("machinery", "Bremen MachineWorks", 79),
]
#: persona, label, features as (title, description)
PERSONA_FEATURES = [
    ("architects", "For Architects", [
        ("Upload BOQ", "Bill of quantities reviewed within 2 hours"), ("Upload Drawings", "Share DWG, PDF, or spec sheets"), ("Sourcing Options", "2–4 pre-vetted Chinese suppliers per line item"),
        ("Request Samples", "Physical samples delivered to your office"), ("Track Procurement", "Live status from PO to site delivery"),
    ]),
    ("machinery", "For Machinery Buyers", [
        ("Upload Machine Spec", "Share machine specifications or RFQ"), ("Factory Matches", "Vetted Chinese manufacturers"), ("Compare Suppliers", "Side-by-side capacity and pricing"),
        ("Inspection Reports", "Third-party QC before payment"), ("Track Shipment", "Container-level visibility to port"),
    ]),
    ("businesses", "For Businesses", [
        ("Landed Cost Estimates", "Indicative total before you commit"), ("Container Status", "Real-time tracking across ocean & inland"),
        ("Download Documents", "Invoices, BL, COO, fumigation in one place"), ("Multiple Projects", "Manage parallel orders from one dashboard"),
    ]),
]
#: persona, label, tagline, steps as (title, text, promise); {site} stands for the site's name
PERSONA_STEPS = [
    ("architects", "Architects", "From BOQ to finished interior. {site} sources every line item and gets samples to your studio.", [
        ("Upload Your BOQ or Drawings", "Share your Bill of Quantities, finish schedule, or architectural drawings. {site} reviews within 2 hours.", "Reviewed within 2 hours"),
        ("{site} Matches Suppliers", "We identify 2–4 pre-vetted manufacturers per line item — matched on spec, aesthetic, lead time, and budget.", "Shortlist within 24 hours"),
        ("Compare Quotes + Request Samples", "Receive itemised quotes with FOB and landed cost. Order physical samples shipped to your office.", "Samples dispatched within 7 days"),
        ("Place Order, {site} Handles Export", "We raise POs, run pre-shipment inspection, and prepare every export document. You sign one PO with {site}.", "Single point of contact"),
        ("Track Your Procurement to Site", "Real-time container tracking with milestone notifications by WhatsApp and email — straight to your project manager.", "Live status, all containers"),
    ]),
    ("machinery", "Machinery Buyers", "Source production-grade machinery from vetted factories. Inspection reports before you pay.", [
        ("Upload Machine Spec or RFQ", "Share your machine requirement, capacity needs, and tolerances. Our procurement engineer reviews within 4 hours.", "Engineer review within 4 hours"),
        ("Factory Matches Across 12 Markets", "We shortlist OEM factories with proven capability, after-sales presence in India, and the right export experience.", "Factory shortlist within 48 hours"),
        ("Compare Suppliers & Capacity", "Side-by-side comparison on output, power draw, warranty terms, spares lead time, and total landed cost.", "Comparison sheet in 24 hours"),
        ("Pre-Shipment Inspection & Test Run", "Third-party inspector or our engineer attends factory acceptance test (FAT). You receive a signed report and video.", "Inspection report before balance payment"),
        ("Track Shipment + Installation Handover", "Container tracking through customs, plus coordination with the OEM's engineer for on-site commissioning.", "Commissioning within 14 days of arrival"),
    ]),
    ("businesses", "Businesses", "Import goods at landed-cost clarity. Manage every project from one dashboard.", [
        ("Share Your Import Requirement", "Tell us what you import — packaging, components, finished goods. Volume, frequency, destination ports.", "Account manager assigned within 1 day"),
        ("Landed Cost Modelling", "Get a full landed cost model — FOB, freight, duties, port handling, inland — before you commit to a supplier.", "Cost model within 24 hours"),
        ("{site} Manages PO + Compliance", "We raise the PO, manage payment terms with the supplier, and own the export and customs paperwork.", "Single invoice from {site}"),
        ("Live Container Status", "Container tracking with milestone push-notifications. Vessel ETAs auto-updated against the original plan.", "Updates pushed within 1 hour of milestone"),
        ("Manage Multiple Projects", "Switch between active orders, download documents, and review supplier performance — all in one dashboard.", "All documents in one place"),
    ]),
]
#: persona, supplier, and what each column of the comparison says of it
QUOTES = [
    ("architects", "Verona", [("FOB", "₹180"), ("Lead", "10w"), ("MOQ", "100")]),
    ("architects", "Guangdong", [("FOB", "₹58"), ("Lead", "7w"), ("MOQ", "200")]),
    ("architects", "Castellón", [("FOB", "₹38"), ("Lead", "6w"), ("MOQ", "250")]),
    ("machinery", "Jiangsu", [("Output", "120 u/hr"), ("Warranty", "24 mo"), ("FOB", "$48k")]),
    ("machinery", "Taiwan SS", [("Output", "110 u/hr"), ("Warranty", "36 mo"), ("FOB", "$62k")]),
    ("machinery", "Bremen", [("Output", "140 u/hr"), ("Warranty", "24 mo"), ("FOB", "$89k")]),
]
FACTORY_IMAGES = [f"https://picsum.photos/seed/fac{i}/600/400" for i in range(1, 7)]
CERTIFICATES = [("ISO 9001:2015", "TÜV Rheinland", "Mar 2027"), ("CE Marking", "Notified Body 1922", "Ongoing"), ("Bureau Veritas QC", "Bureau Veritas", "Aug 2026")]
INSPECTIONS = [("Mar 2026", "INS-2026-118", "Pass"), ("Nov 2025", "INS-2025-091", "Pass"), ("Jul 2025", "INS-2025-052", "Pass")]
QC_STEPS = ["Raw Material", "Production QC", "Pre-shipment Inspection", "Packaging Audit"]
#: Lines of a product's specification that are the same for every product.
SPEC_CONSTANTS = [
    ("Edge Type", "Rectified"), ("Water Absorption", "< 0.5%"), ("Slip Resistance", "R10"), ("Breaking Strength", "≥ 1300 N"),
    ("Frost Resistance", "Yes"), ("Packaging", "2 pcs / box · 1.44 sqm / box"), ("Container Fill", "560 sqm (20ft) · 1,120 sqm (40ft)"),
]
IMAGE_PREFIX, IMAGE_SUFFIX = "https://picsum.photos/seed/", "/900/600"


def image_url(seed: str) -> str:
    return f"{IMAGE_PREFIX}{seed}{IMAGE_SUFFIX}"


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, " + schema)


def products(spark: SparkSession) -> DataFrame:
    category, slug = CATEGORIES[0][1], CATEGORIES[0][0]
    rows = []
    for pid, pslug, name, kind, origin, size, finish, material, low, high, lead, moq, sample, inspection, supplier, sslug, seed in PRODUCTS:
        gallery = [image_url(seed + x) for x in ("", "b", "c", "d")]
        rows.append((pid, pslug, name, category, slug, kind, origin, FLAGS[origin], size, finish, material, low, high, "sqm", lead, moq, sample, inspection, supplier, sslug, gallery[0], gallery))
    return _table(
        spark, rows,
        "id string, slug string, name string, category string, category_slug string, type string, origin string, origin_flag string, size string, finish string, "
        "material string, price_min double, price_max double, unit string, lead_time string, moq int, sample boolean, inspection boolean, supplier string, "
        "supplier_slug string, image string, gallery array<string>",
    )


def categories(spark: SparkSession) -> DataFrame:
    return _table(spark, CATEGORIES, "slug string, name string, count int")


def featured(spark: SparkSession) -> DataFrame:
    rows = [(*r[:6], f"https://picsum.photos/seed/{r[6]}/600/450", r[7]) for r in FEATURED]
    return _table(spark, rows, "id string, name string, spec string, price string, origin string, lead string, img string, tag string")


def extracted(spark: SparkSession) -> DataFrame:
    rows = [(i, name, CATEGORIES[0][1], spec, price, lead, ready, None) for i, name, spec, price, lead, ready in EXTRACTED]
    return _table(spark, rows, "id int, name string, category string, spec string, price string, lead string, ready boolean, published boolean")


def admin_catalogue(spark: SparkSession) -> DataFrame:
    return _table(spark, ADMIN_CATALOGUE, "id int, name string, cat string, sup string, price string, status string")


def tickets(spark: SparkSession) -> DataFrame:
    return _table(spark, TICKETS, "ref string, name string, co string, role string, items string, date string, status string")


def trackers(spark: SparkSession) -> DataFrame:
    return _table(spark, TRACKERS, "ref string, kind string, milestones array<string>, completed int")


def match_scores(spark: SparkSession) -> DataFrame:
    return _table(spark, MATCH_SCORES, "persona string, n string, m int")


def persona_features(spark: SparkSession) -> DataFrame:
    return _table(spark, PERSONA_FEATURES, "persona string, label string, features array<struct<title:string,desc:string>>")


def persona_steps(spark: SparkSession, site: str = "us") -> DataFrame:
    filled = lambda x: x.replace("{site}", site)
    rows = [(persona, label, filled(tagline), [tuple(map(filled, step)) for step in steps]) for persona, label, tagline, steps in PERSONA_STEPS]
    return _table(spark, rows, "persona string, label string, tagline string, steps array<struct<title:string,copy:string,sla:string>>")


def persona_slas(spark: SparkSession, site: str = "us") -> DataFrame:
    """What each step of a persona promises."""
    return persona_steps(spark, site).select("ord", "persona", F.transform("steps", lambda x: x["sla"]).alias("slas"))


def quotes(spark: SparkSession) -> DataFrame:
    return _table(spark, QUOTES, "persona string, supplier string, quote array<struct<k:string,v:string>>")


def factory_images(spark: SparkSession) -> DataFrame:
    return _table(spark, [(x,) for x in FACTORY_IMAGES], "image string")


def qc_steps(spark: SparkSession) -> DataFrame:
    return _table(spark, [(x,) for x in QC_STEPS], "step string")


def certificates(spark: SparkSession) -> DataFrame:
    return _table(spark, CERTIFICATES, "certificate string, body string, valid_until string")


def inspections(spark: SparkSession) -> DataFrame:
    return _table(spark, INSPECTIONS, "d string, ref string, res string")


def facet_options(spark: SparkSession) -> DataFrame:
    return _table(spark, [(facet, option) for facet, options in FACETS.items() for option in options], "facet string, option string")
