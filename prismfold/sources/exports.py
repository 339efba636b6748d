"""Exports: holdings as CSV and the frames of a workbook."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of an export, in order, and what each is made from.
EXPORT_COLUMNS = {
    "Company Name": "company_name",
    "Fund": "fund_name",
    "Sector": "sector",
    "Industry": "industry",
    "Country": "country",
    "Reported Value (USD)": "value",
    "% of Fund": "pct",
    "As of Date": "as_of_date",
    "Source": "source",
    "Extraction Confidence": "extraction_confidence",
    "Match Method": "match_method",
    "Match Confidence": "match_confidence",
}
# Fixed value: what stands for a sum without any value.
NO_VALUE = "N/A - value data not available for all holdings"


def with_resolution(holdings: DataFrame, log: DataFrame) -> DataFrame:
    """Holdings, and match_method and match_confidence of their rows in the resolution log (holding_id); those without one keep
    nulls, those with several are repeated."""
    return holdings.join(log.select("holding_id", "match_method", "match_confidence"), "holding_id", "left")


def export_rows(rows: DataFrame, summed: DataFrame | None = None) -> DataFrame:
    """The columns of an export. Missing texts are empty, missing numbers null; the share is that of the value in the sum of its
    fund and day among these rows, null without a value or a sum above 0. `summed` may give the same rows with fewer columns
    (fund_id, as_of_date, value), from before a join that neither adds nor drops any."""
    sums = (rows if summed is None else summed).groupBy(F.col("fund_id").alias("f_"), F.col("as_of_date").alias("d_")).agg(F.sum("value").alias("sum_"))
    joined = rows.join(sums, F.col("fund_id").eqNullSafe(F.col("f_")) & F.col("as_of_date").eqNullSafe(F.col("d_")), "left")
    share = F.when(F.col("sum_") > 0, F.round(F.col("value").cast("double") / F.col("sum_").cast("double") * 100, 4))
    numbers = {"value": F.col("value").cast("double"), "pct": share, "extraction_confidence": F.col("extraction_confidence").cast("double"), "match_confidence": F.col("match_confidence").cast("double")}
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return joined.select(*[(numbers[c] if c in numbers else text(c)).alias(name) for name, c in EXPORT_COLUMNS.items()])


def summary_metrics(rows: DataFrame, day: dt.date) -> DataFrame:
    """metric and value, as text, of the first block of a summary sheet."""
    total = F.sum("value").cast("double")
    told = rows.agg(F.count("*").cast("string").alias("n"), F.when(total > 0, F.round(total, 2).cast("decimal(38,2)").cast("string")).otherwise(NO_VALUE).alias("aum"))
    pairs = {"Total Holdings": F.col("n"), "Total AUM (USD)": F.col("aum"), "Export Date": F.lit(day.isoformat())}
    return told.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in pairs.items()])))


def holdings_csv(df: DataFrame, path: str) -> None:
    """One header a file; nulls as empty text."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def summary_frames(holdings: DataFrame) -> dict[str, DataFrame]:
    """The sheets of a workbook: holdings, totals by fund and by sector; "N/A" where nothing has a value."""
    total = F.when(F.count("value") == 0, F.lit("N/A")).otherwise(F.format_number(F.sum("value"), 2)).alias("total")
    by = lambda column: holdings.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("Unclassified")).alias(column)).agg(F.count("*").alias("holdings"), total)
    return {"Holdings": holdings, "By fund": by("fund_id"), "By sector": by("sector")}
