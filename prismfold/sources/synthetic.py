"""Deterministic holdings for tests and demos: every value is a hash of its key, so any partitioning gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(*keys) -> Column:
    """A number in [0, 1) from a hash of the keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) / float(1 << 40)


def synthetic_holdings(spark: SparkSession, *, funds: int = 8, quarters: int = 8, companies: int = 500, per_report: int = 40, last: str = "2024-12-31", seed: int = 668) -> DataFrame:
    """Holdings of funds over quarter ends: Pareto weights, values missing in a tenth, company ids in a twentieth."""
    n = funds * quarters * per_report
    rows = spark.range(n).select((F.col("id") % per_report).alias("row"), (F.floor(F.col("id") / per_report) % quarters).cast("int").alias("q"), F.floor(F.col("id") / (per_report * quarters)).alias("fund_id"))
    u = lambda name: _uniform(F.lit(f"{seed}-{name}"), "fund_id", "q", "row")
    weight = F.pow(1 - u("weight"), F.lit(-1 / 1.5))
    company = F.floor(u("company") * companies)
    return rows.select(
        "fund_id",
        F.last_day(F.add_months(F.lit(last).cast("date"), -3 * F.col("q"))).alias("as_of_date"),
        F.concat_ws("-", "fund_id", "q", "row").alias("holding_id"),
        F.when(u("known") >= 0.05, company).alias("company_id"),
        F.concat(F.lit("Company "), company).alias("raw_company_name"),
        F.when(u("valued") >= 0.10, F.round(weight * 1e6, 2)).alias("value"),
    )
