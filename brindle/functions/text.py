"""Text rules of the storefront as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.numbers import plain


def slug_title(slug: Column) -> Column:
    """First letter of each hyphenated part in upper case, the rest as it is. An empty part stays empty."""
    return F.array_join(F.transform(F.split(slug, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def spec_line(size: Column, finish: Column, material: Column) -> Column:
    return F.concat(size, F.lit("mm · "), finish, F.lit(" · "), material)


def cart_spec(size: Column, finish: Column) -> Column:
    """D01. Unlike the spec line, without the unit."""
    return F.concat(size, F.lit(" · "), finish)


def price_band(low: Column, high: Column, unit: Column) -> Column:
    return F.concat(F.lit("₹"), plain(low), F.lit("–"), plain(high), F.lit(" / "), unit)


def enquiry_line(name: Column, spec: Column, origin: Column) -> Column:
    """One item of an enquiry; a missing spec or origin leaves its place empty."""
    return F.concat(F.lit("- "), name, F.lit(" ("), F.coalesce(spec, F.lit("")), F.lit(") · "), F.coalesce(origin, F.lit("")))


def spec_chips(size: Column, finish: Column, material: Column, grade: str = "Grade A") -> Column:
    return F.array(F.concat(size, F.lit("mm")), finish, material, F.lit(grade))


def image_url(seed: Column, prefix: str, suffix: str) -> Column:
    return F.concat(F.lit(prefix), seed, F.lit(suffix))


def first_filled(*columns: Column, last: str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(last))


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def titled(name: Column, fallback: str, site: str) -> Column:
    """A page title: the row's name, or a fallback where there is no row."""
    return F.concat(F.coalesce(name, F.lit(fallback)), F.lit(f" — {site}"))


def category_description(name: Column, site: str) -> Column:
    """D05."""
    return F.concat(F.lit("Browse "), F.coalesce(name, F.lit("products")), F.lit(f" from vetted international suppliers via {site}."))


def product_description(name: Column, supplier: Column, size: Column, finish: Column, material: Column, site: str) -> Column:
    """D05. Without a product there is a fixed text."""
    found = F.concat(name, F.lit(" from "), supplier, F.lit(". "), size, F.lit("mm "), finish, F.lit(" "), material, F.lit(f". Request a quote via {site}."))
    return F.when(name.isNull(), F.lit("Product detail.")).otherwise(found)


def supplier_title(supplier: Column, site: str) -> Column:
    """D05."""
    return F.concat(F.lit("Supplier · "), supplier, F.lit(f" — {site}"))


def id_safe(value: Column) -> Column:
    return F.regexp_replace(value, ":", "")


def short_month(day: Column) -> Column:
    return F.date_format(day, "MMM")


def amounts(price: Column) -> Column:
    """Low and high of a displayed price band: thousands (K) and lakhs (L) expanded, separators dropped."""
    number = F.regexp_replace(price, ",", "")

    def part(i: int) -> Column:
        digits = F.get(F.regexp_extract_all(number, F.lit(r"([0-9]+(?:\.[0-9]+)?)([KL]?)"), F.lit(1)), F.lit(i))
        unit = F.get(F.regexp_extract_all(number, F.lit(r"([0-9]+(?:\.[0-9]+)?)([KL]?)"), F.lit(2)), F.lit(i))
        factor = F.when(unit == "K", 1e3).when(unit == "L", 1e5).otherwise(1.0)
        return digits.try_cast("double") * factor

    return F.struct(part(0).alias("low"), part(1).alias("high"))


def lead_weeks(lead: Column) -> Column:
    """(least, most) weeks: "6–8 weeks" as 6 and 8, "Under 4 weeks" as 0 and 4."""
    numbers = F.regexp_extract_all(lead, F.lit(r"([0-9]+)"), F.lit(1))
    under = lead.startswith("Under")
    low = F.when(under, F.lit(0)).otherwise(F.get(numbers, F.lit(0)).cast("int"))
    high = F.when(under, F.get(numbers, F.lit(0)).cast("int")).otherwise(F.get(numbers, F.lit(1)).cast("int"))
    return F.struct(low.alias("least"), high.alias("most"))
