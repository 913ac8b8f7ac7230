"""What the storefront stores: shopping lists, enquiry forms, error reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.cart import restored, stored
from brindle.operators.filters import form_problems

#: Fields of an enquiry, and those that must be filled in.
FORM = ("name", "company", "role", "email", "whatsapp", "destination", "sourcing", "qty", "timeline", "source")
REQUIRED = ("name", "company", "email")


def save_lists(items: DataFrame, owner: str, order: str, path: str) -> None:
    """Overwrites the stored lists, one JSON text for each owner."""
    stored(items, owner, order).write.mode("overwrite").parquet(path)


def load_lists(saved: DataFrame, owner: str) -> DataFrame:
    """Items of stored lists with their position; malformed lists are empty."""
    rows = saved.select(owner, F.posexplode(restored(F.col("stored"))).alias("position", "item"))
    return rows.select(owner, "position", "item.*")


def complete(forms: DataFrame) -> DataFrame:
    """Forms without problems, of a table or a stream; ``ledger.write_stream`` stores those of a stream once."""
    return form_problems(forms, REQUIRED, "email").where(F.size("problems") == 0).drop("problems")


def append_forms(forms: DataFrame, path: str) -> None:
    """Appends complete forms; the storefront itself collects them and lets them go."""
    complete(forms).select(*FORM).write.mode("append").parquet(path)


def append_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("append").json(path)
