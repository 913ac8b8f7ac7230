"""Landed cost of a quantity shipped to a city."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.numbers import indian_grouping, round_half_up

#: Fixed values of the estimate, per unit or as a share of the goods' price.
FREIGHT, DUTY, HANDLING, INLAND, REMOTE, REMOTE_CITY = 6, 0.2, 2.5, 3, 2000, "Other"
QUANTITY, CITY = 500, "Mumbai"
LINES = ("fob", "freight", "duty", "cfs", "inland", "total")


def landed_cost(df: DataFrame, low: str, high: str, quantity: Column | float = QUANTITY, city: Column | str = CITY) -> DataFrame:
    """Adds the five lines and their total; the duty is on the goods alone."""
    q = quantity if isinstance(quantity, Column) else F.lit(float(quantity))
    where = city if isinstance(city, Column) else F.lit(city)
    fob = q * ((F.col(low) + F.col(high)) / 2)
    df = df.withColumns({
        "fob": fob, "freight": q * FREIGHT, "duty": fob * DUTY, "cfs": q * HANDLING,
        "inland": q * INLAND + F.when(where == REMOTE_CITY, F.lit(float(REMOTE))).otherwise(F.lit(0.0)),
    })
    return df.withColumn("total", F.col("fob") + F.col("freight") + F.col("duty") + F.col("cfs") + F.col("inland"))


def cost_lines(df: DataFrame, key: str) -> DataFrame:
    """One row for each line, rounded and written as it is shown."""
    rows = F.array(*[F.struct(F.lit(i).alias("line_no"), F.lit(x).alias("line"), F.col(x).alias("amount")) for i, x in enumerate(LINES)])
    out = df.select(key, F.explode(rows).alias("x")).select(key, "x.*")
    return out.withColumn("rounded", round_half_up(F.col("amount"))).withColumn("shown", F.concat(F.lit("₹"), indian_grouping(F.col("rounded"))))
