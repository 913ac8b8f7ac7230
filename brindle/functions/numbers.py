"""Number rules of the storefront as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """Halves go towards positive infinity, so -2.5 gives -2."""
    return F.floor(x + F.lit(0.5))


def plain(x: Column) -> Column:
    """D04. A number as text: its shortest digits, without a fraction if whole, and with an exponent only from 1e21 on or below 1e-6."""
    s, size = x.cast("double").cast("string"), F.abs(x.cast("double"))
    trimmed = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    spelled = F.when(size >= 1, s.try_cast("decimal(38,17)").cast("string")).otherwise(F.format_number(s.try_cast("decimal(38,24)"), 24))
    powers = F.regexp_replace(F.regexp_replace(s, r"\.0E", "E"), r"E(?=[0-9])", "e+")
    out = F.when(size == 0, F.lit("0")).when((size >= 1e21) | (size < 1e-6), F.replace(powers, F.lit("E"), F.lit("e")))
    return F.when(F.isnan(size) | (size == float("inf")), s).otherwise(out.otherwise(trimmed(spelled)))


def indian_grouping(x: Column) -> Column:
    """Whole number with the last three digits together and pairs before them: 6,68,000."""
    digits = F.abs(x.cast("bigint")).cast("string")
    tail, head = F.right(digits, F.lit(3)), F.expr("''")
    head = F.when(F.length(digits) > 3, F.substr(digits, F.lit(1), F.length(digits) - 3)).otherwise(F.lit(""))
    grouped = F.regexp_replace(head, r"(?<=\d)(?=(?:\d\d)+$)", ",")
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, grouped, F.when(head == "", F.lit("")).otherwise(F.lit(",")), tail)


def grouping(x: Column) -> Column:
    """Groups of three."""
    return F.format_number(x, 0)


#: White space that may stand round a number.
_BLANKS = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def coerced(text: Column) -> Column:
    """D18. Text as a number: decimal, or whole with 0x, 0o or 0b before it; what is none, or empty, is 0."""
    s = F.regexp_replace(F.regexp_replace(text, f"^{_BLANKS}+", ""), f"{_BLANKS}+$", "")
    digit = lambda d: F.conv(d, 16, 10).cast("double")
    based = lambda base: F.aggregate(F.split(F.substr(s, F.lit(3)), ""), F.lit(0.0), lambda acc, d: acc * float(base) + digit(d))
    out = F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), s.try_cast("double"))
    out = out.when(s.rlike("^0[xX][0-9a-fA-F]+$"), based(16)).when(s.rlike("^0[oO][0-7]+$"), based(8)).when(s.rlike("^0[bB][01]+$"), based(2))
    out = out.when(s.rlike(r"^\+?Infinity$"), F.lit(float("inf"))).when(s == "-Infinity", F.lit(float("-inf")))
    return F.coalesce(out, F.lit(0.0))


def progress(elapsed: Column, whole: int = 3000, steps: int = 5) -> tuple[Column, Column]:
    """Per cent done, at most 100, and the step reached."""
    percent = F.least(F.lit(100.0), elapsed / F.lit(float(whole)) * F.lit(100.0))
    step = F.least(F.lit(steps).cast("bigint"), F.floor(elapsed / F.lit(float(whole)) * F.lit(float(steps + 1))))
    return percent, step


def stage(elapsed: Column, whole: int = 3000, pause: int = 400) -> Column:
    """idle before the start, processing until the pause after the whole time is over, then review."""
    return F.when(elapsed < 0, "idle").when(elapsed < whole + pause, "processing").otherwise("review")


def scroll_by(width: Column, direction: Column) -> Column:
    return F.coalesce(width + 20, F.lit(320)) * direction


def random_width(seed: int) -> Column:
    """A whole number from 50 to 89."""
    return (F.floor(F.rand(seed) * 40) + 50).cast("int")


def wrapped(index: Column, items: Column) -> Column:
    """The item at an index that starts over at the end."""
    return F.get(items, F.pmod(index, F.size(items)))
