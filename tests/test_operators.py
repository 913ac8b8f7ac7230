"""Golden values of the literal tables, edge cases, and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import numbers, text
from brindle.operators import browse, cart, filters, pricing, review
from brindle.operators.filters import FacetSpec
from brindle.sources import fixtures


@pytest.fixture(scope="module")
def products(spark):
    return fixtures.products(spark).cache()


def ids(df):
    return [r.id for r in df.orderBy("ord").collect()]


@pytest.mark.parametrize(
    "facet, option, wanted",
    [
        ("type", "Porcelain", ["p1", "p5"]), ("type", "Ceramic", ["p3", "p4"]), ("type", "Marble", ["p2"]), ("type", "Mosaic", ["p6"]),
        ("type", "Travertine", []), ("type", "Vitrified", []), ("origin", "Italy", ["p2", "p6"]), ("origin", "India", ["p5"]),
        ("size", "600×1200", ["p1", "p4"]), ("size", "Custom", ["p6"]), ("finish", "Glossy", ["p2", "p4"]),
        ("lead_time", "Under 4 weeks", ["p5"]), ("lead_time", "4–8 weeks", ["p3"]), ("lead_time", "8–12 weeks", ["p2", "p6"]),
    ],
)
def test_facet_membership(products, facet, option, wanted):
    assert ids(filters.facets(products, FacetSpec({facet: [option]}))) == wanted


@pytest.mark.parametrize("bound, n", [(50, 1), (100, 2), (250, 4), (300, 5), (500, 6), (5000, 6)])
def test_bound(products, bound, n):
    assert filters.facets(products, FacetSpec(bounds={"moq": bound})).count() == n


def test_facets_combine(products):
    assert ids(filters.facets(products, FacetSpec({"origin": ["Italy", "Spain"], "finish": ["Glossy"]}))) == ["p2", "p4"]
    assert ids(filters.facets(products, FacetSpec({c: [] for c in fixtures.FACETS}))) == ["p1", "p2", "p3", "p4", "p5", "p6"]
    assert filters.facets(products, FacetSpec(required=["inspection"])).count() == 4
    assert filters.showing(products, FacetSpec(required=["inspection"])).first() == (4, 6)


def test_null_passes_the_bound(spark):
    df = spark.createDataFrame([(1, None), (2, 10), (3, 20)], "id int, moq int")
    assert [r.id for r in filters.facets(df, FacetSpec(bounds={"moq": 10})).orderBy("id").collect()] == [1, 2]


def test_adding_a_facet_never_adds_rows(products):
    every = products.count()
    for facet, options in fixtures.FACETS.items():
        one = filters.facets(products, FacetSpec({facet: options[:1]})).count()
        two = filters.facets(products, FacetSpec({facet: options[:1], "supplier": ["Verona Stone Works"]})).count()
        assert two <= one <= every


def test_lookups(spark, products):
    assert filters.by_either(products, "carrara-statuario-marble", ["id", "slug"]).first().id == "p2"
    assert filters.by_either(products, "p3", ["id", "slug"]).first().id == "p3"
    assert filters.or_default(fixtures.categories(spark), "slug", "nothing").first().slug == "tiles-flooring"
    with pytest.raises(filters.NotFoundError):
        filters.must_exist(filters.by_either(products, "p9", ["id", "slug"]), "p9")
    assert [r.id for r in filters.others(products, "id", "p1").collect()] == ["p2", "p3", "p4", "p5"]
    assert [r.id for r in filters.others(products, "id", "p6").collect()] == ["p1", "p2", "p3", "p4"]


COSTS = {
    "p1": (32500, 3000, 6500, 1250, 1500, 44750), "p2": (105000, 3000, 21000, 1250, 1500, 131750), "p3": (24250, 3000, 4850, 1250, 1500, 34850),
    "p4": (22500, 3000, 4500, 1250, 1500, 32750), "p5": (16500, 3000, 3300, 1250, 1500, 25550), "p6": (71250, 3000, 14250, 1250, 1500, 91250),
}


def test_landed_cost(products):
    rows = pricing.landed_cost(products, "price_min", "price_max").collect()
    assert {r.id: tuple(r[x] for x in pricing.LINES) for r in rows} == COSTS
    far = pricing.landed_cost(products, "price_min", "price_max", 1, "Other").collect()
    assert {r.id: round(r.total, 6) for r in far} == {"p1": 2089.5, "p2": 2263.5, "p3": 2069.7, "p4": 2065.5, "p5": 2051.1, "p6": 2182.5}
    assert {r.total for r in pricing.landed_cost(products, "price_min", "price_max", 0).collect()} == {0.0}


def test_numbers(spark):
    cases = {0: "0", 999: "999", 1000: "1,000", 44750: "44,750", 668000: "6,68,000", 12345678: "1,23,45,678", -44750: "-44,750", 100000: "1,00,000"}
    df = spark.createDataFrame([(k,) for k in cases], "x long")
    assert {r.x: r.s for r in df.select("x", numbers.indian_grouping(F.col("x")).alias("s")).collect()} == cases
    df = spark.createDataFrame([(-2.5,), (2.5,), (-0.5,), (1.49,)], "x double")
    assert [r[0] for r in df.select(numbers.round_half_up(F.col("x"))).collect()] == [-2, 3, 0, 1]
    df = spark.createDataFrame([("12",), ("",), ("x",), (None,), ("1e3",)], "x string")
    assert [r[0] for r in df.select(numbers.coerced(F.col("x"))).collect()] == [12.0, 0.0, 0.0, 0.0, 1000.0]


def test_text(spark, products):
    df = spark.createDataFrame([("castellon-ceramica",), ("a--b",), ("",)], "s string")
    assert [r[0] for r in df.select(text.slug_title(F.col("s"))).collect()] == ["Castellon Ceramica", "A  B", ""]
    row = products.where("id = 'p6'").select(text.spec_line(F.col("size"), F.col("finish"), F.col("material")), text.price_band(F.col("price_min"), F.col("price_max"), F.col("unit"))).first()
    assert tuple(row) == ("Custommm · Matt · Mosaic", "₹120–165 / sqm")
    prices = fixtures.admin_catalogue(spark).orderBy("ord").select(text.amounts(F.col("price")).alias("a")).select("a.*").collect()
    assert [tuple(r) for r in prices][1:3] == [(3200.0, 4800.0), (420000.0, 580000.0)]
    assert [r.id for r in browse.ordered(products, "lead time").collect()] == ["p5", "p3", "p1", "p4", "p2", "p6"]
    assert [r.id for r in browse.ordered(products, "price").collect()] == ["p5", "p4", "p3", "p1", "p6", "p2"]


def test_review(spark):
    rows = fixtures.extracted(spark)
    chosen = rows.select("id")
    status = lambda df: {r.id: r.s for r in df.select("id", review.publication(F.col("published"), F.col("ready")).alias("s")).collect()}
    assert {k for k, v in status(rows).items() if v == "Needs Review"} == {6, 10}
    assert set(status(review.published(rows, chosen, "id")).values()) == {"Published"}
    assert review.all_selected(rows, chosen, "id").first().all_selected
    t = review.milestones(fixtures.trackers(spark), F.col("milestones"), F.col("completed"), ["ref"]).where("ref = 'CRF-2026-04821'").orderBy("position").collect()
    assert [(r.reached, r.connected) for r in t] == [(True, True), (True, True), (True, False), (False, None)]


def test_every_literal_table(spark):
    sizes = {
        fixtures.products: 6, fixtures.categories: 6, fixtures.featured: 6, fixtures.extracted: 12, fixtures.admin_catalogue: 6, fixtures.tickets: 5, fixtures.trackers: 3,
        fixtures.match_scores: 6, fixtures.persona_features: 3, fixtures.persona_slas: 3, fixtures.certificates: 3, fixtures.inspections: 3, fixtures.facet_options: 22,
    }
    for table, n in sizes.items():
        assert table(spark).count() == n


def test_stored_lists(spark):
    df = spark.createDataFrame([(1, None), (2, "nonsense"), (3, '[{"id":"p1","name":"n"}]'), (4, "[]")], "k int, s string")
    assert [r[0] for r in df.orderBy("k").select(F.size(cart.restored(F.col("s")))).collect()] == [0, 0, 1, 0]


def replay(log):
    state: dict[int, list[int]] = {}
    for user, item, act in log:
        items = state.setdefault(user, [])
        if act == "clear":
            items.clear()
        elif act == "remove" and item in items:
            items.remove(item)
        elif act == "add" and item not in items:
            items.append(item)
    return {(u, i): p + 1 for u, items in state.items() for p, i in enumerate(items)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(1, 3), st.sampled_from(["add", "add", "remove", "clear"])), max_size=14))
def test_replay(spark, log):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(log)], "seq int, user int, item int, act string")
    got = cart.replayed(df, "user", "item", F.col("act"), ["seq"]).collect()
    assert {(r.user, r.item): r.position for r in got} == replay(log)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6000), st.booleans()), max_size=10))
def test_register(spark, events):
    at, log, held, wanted = 0, [], None, {}
    for i, (gap, write) in enumerate(events):
        at += gap
        log.append((0, i, at, write, i))
        if write:
            held = (i, at)
        else:
            wanted[i] = held[0] if held and at - held[1] <= review.TTL_MS else None
            held = None
    df = spark.createDataFrame(log, "owner int, seq int, ms long, write boolean, value int")
    got = review.register_reads(df, "owner", F.col("ms"), ["seq"], F.col("write"), "value").collect()
    assert {r.seq: r.got for r in got} == wanted


def test_marks_do_not_multiply(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    listed = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    got = cart.marked(df, listed, "id").collect()
    assert sorted((r.id or 0, r.added) for r in got) == [(0, False), (1, True), (2, False)]
    assert cart.removed(df.where("id is not null"), listed, "id").count() == 1


def test_toggles(spark):
    log = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "a")], "seq int, k string")
    got = cart.toggled(log, ["k"], [F.col("seq")]).orderBy("last").collect()
    assert [r.k for r in got] == ["b", "c", "a"]


def test_sinks(spark, tmp_path):
    from brindle.sources import sinks

    items = spark.createDataFrame([(1, 1, "p2", "b", None, None, None), (1, 0, "p1", "a", "s", "o", "i"), (2, 0, "p3", "c", None, None, None)], "owner int, seq int, id string, name string, spec string, origin string, image string")
    sinks.save_lists(items, "owner", "seq", str(tmp_path / "lists"))
    back = sinks.load_lists(spark.read.parquet(str(tmp_path / "lists")), "owner").orderBy("owner", "position").collect()
    assert [(r.owner, r.position, r.id, r.spec) for r in back] == [(1, 0, "p1", "s"), (1, 1, "p2", None), (2, 0, "p3", None)]
    form = {f: "x" for f in sinks.FORM}
    forms = spark.createDataFrame([{**form, "email": "a@b.example"}, {**form, "email": "none"}, {**form, "email": "a@b.example", "name": " "}])
    sinks.append_forms(forms, str(tmp_path / "forms"))
    sinks.append_forms(forms, str(tmp_path / "forms"))
    assert spark.read.parquet(str(tmp_path / "forms")).count() == 2
    sinks.append_reports(spark.createDataFrame([("boundary", {"route": "/"})], "source string, context map<string,string>"), str(tmp_path / "reports"))
    assert spark.read.json(str(tmp_path / "reports")).count() == 1


def test_small_rules(spark, products):
    assert cart.all_or_none(products, "id", True).count() == 6 and cart.all_or_none(products, "id", False).count() == 0
    assert [r.position for r in cart.placeholders(products, 5).collect()] == [0, 1, 2, 3, 4]
    widths = [r[0] for r in spark.range(200).select(numbers.random_width(3)).collect()]
    assert min(widths) >= 50 and max(widths) <= 89
    got = products.select("ord", numbers.wrapped(F.col("ord"), F.col("gallery")).alias("x"), F.col("gallery")).collect()
    assert all(r.x == r.gallery[r.ord % 4] for r in got)
    df = spark.createDataFrame([(None, 1), (300, -1)], "w int, d int")
    assert [r[0] for r in df.select(numbers.scroll_by(F.col("w"), F.col("d"))).collect()] == [320, -320]


def test_related_rows_need_no_shuffle(spark):
    df = spark.range(100).withColumn("ord", F.col("id"))
    plan = filters.others_of_each(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert filters.others_of_each(df.limit(0), "id").count() == 0
    assert [tuple(r) for r in filters.others_of_each(df.limit(2), "id").orderBy("id").collect()] == [(0, 1, 1), (1, 0, 1)]


def test_missing_rows(spark):
    import pytest

    df = spark.range(3)
    with pytest.raises(filters.NotFoundError):
        filters.must_exist(df.where("id > 5"), "no such row")
    assert filters.nothing_found(df, "none").count() == 0
    assert [r.message for r in filters.nothing_found(df.where("id > 5"), "none").collect()] == ["none"]
    assert cart.badge(df.where("id > 5")).count() == 0


def test_price_order(spark):
    from brindle.operators import browse

    df = spark.createDataFrame([(2, 5.0), (1, 5.0), (0, 9.0), (3, 1.0)], "ord int, price_min double")
    assert [r.ord for r in browse.ordered(df, "price").collect()] == [3, 1, 2, 0]
