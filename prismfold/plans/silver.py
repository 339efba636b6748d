"""The silver tables (funds, companies, reports, holdings, taxonomy, classifications) from an order database.

A deterministic view: suppliers are funds, parts companies, line items holdings, and a supplier's quarter a report.
Nulls that real reports have are put in by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismfold.functions.values import money, quarter_end

FUND_TYPES = ["Buyout", "Growth Equity", "Private Credit", "Venture"]
SOURCES = ["bdc_filing", "13f_filing", "pdf_document"]
UNKNOWN_NODE = "00000000-0000-0000-0000-000000000000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index):
    """The value at an index; null past the end."""
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation")


def dim_fund(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    funds = table(spark, sf_dir, "supplier").join(F.broadcast(nations(spark, sf_dir)), F.col("s_nationkey") == F.col("n_nationkey"))
    return funds.select(
        key.alias("fund_id"),
        F.col("s_name").alias("fund_name"),
        _pick(FUND_TYPES, (key % 5).cast("int")).alias("fund_type"),
        _pick(SOURCES, (key % 3).cast("int")).alias("source"),
        F.col("n_name").alias("fund_country"),
    )


def dim_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").join(F.broadcast(nations(spark, sf_dir)), (key % 25).cast("int") == F.col("n_nationkey"), "left")
    known = key % 5 != 0
    return parts.select(
        key.alias("company_id"),
        F.col("p_name").alias("company_name"),
        F.when(known, F.col("p_type")).alias("primary_sector"),
        F.when(known, F.col("p_brand")).alias("primary_industry"),
        F.when(key % 10 != 0, F.col("n_name")).alias("primary_country"),
        F.col("p_type").alias("reported_sector"),
        F.col("p_size").alias("size"),
    )


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fund_id, as_of_date, company_id, value, pct, holding_id; one row a line item."""
    item = table(spark, sf_dir, "lineitem")
    return item.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("holding_id"),
        F.col("l_suppkey").alias("fund_id"),
        quarter_end(F.col("l_shipdate")).alias("as_of_date"),
        F.when(F.col("l_orderkey") % 20 != 0, F.col("l_partkey")).alias("company_id"),
        F.col("l_partkey").alias("raw_id"),
        F.when(F.col("l_orderkey") % 11 != 0, money(F.col("l_extendedprice"))).alias("value"),
        F.col("l_discount").alias("pct"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fund_id, as_of_date and coverage of each fund's quarter."""
    distinct = holdings(spark, sf_dir).select("fund_id", "as_of_date").distinct()
    return distinct.withColumn("coverage", (F.lit(5) + F.col("fund_id") % 6).cast("double") / 10)


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings with a positive value, scaled to the investor's share: five hundredths."""
    return holdings(spark, sf_dir).filter("value > 0").withColumn("scaled", (F.col("value") * F.lit("0.05").cast("decimal(4,2)")).cast("decimal(20,4)"))


def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company_id, node_id and confidence of classified companies; some are of the unknown node."""
    company = dim_company(spark, sf_dir).filter("company_id % 3 = 0")
    node = F.when(F.col("company_id") % 7 == 0, F.lit(UNKNOWN_NODE)).otherwise(F.col("reported_sector"))
    return company.select("company_id", "company_name", "primary_sector", node.alias("node_id"), (F.col("size") * 2).cast("double").alias("percent"))


#: The same tables for DuckDB.
SQL = f"""
WITH dim_fund AS (
  SELECT s_suppkey AS fund_id, s_name AS fund_name,
         ['Buyout','Growth Equity','Private Credit','Venture'][s_suppkey % 5 + 1] AS fund_type,
         ['bdc_filing','13f_filing','pdf_document'][s_suppkey % 3 + 1] AS source, n_name AS fund_country
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
dim_company AS (
  SELECT p_partkey AS company_id, p_name AS company_name,
         CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS primary_sector,
         CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS primary_industry,
         CASE WHEN p_partkey % 10 <> 0 THEN n_name END AS primary_country,
         p_type AS reported_sector, p_size AS size
  FROM part LEFT JOIN nation ON p_partkey % 25 = n_nationkey),
holdings AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS holding_id, l_suppkey AS fund_id,
         last_day(date_trunc('quarter', l_shipdate)::date + INTERVAL 2 MONTH) AS as_of_date,
         CASE WHEN l_orderkey % 20 <> 0 THEN l_partkey END AS company_id, l_partkey AS raw_id,
         CASE WHEN l_orderkey % 11 <> 0 THEN l_extendedprice::DECIMAL(18,2) END AS value, l_discount AS pct
  FROM lineitem),
reports AS (
  SELECT DISTINCT fund_id, as_of_date, (5 + fund_id % 6)::DOUBLE / 10 AS coverage FROM holdings),
scaled AS (
  SELECT *, (value * 0.05)::DECIMAL(20,4) AS scaled FROM holdings WHERE value > 0),
latest AS (
  SELECT * FROM (SELECT *, max(as_of_date) OVER (PARTITION BY fund_id) AS m FROM scaled) WHERE as_of_date = m),
classifications AS (
  SELECT company_id, company_name, primary_sector,
         CASE WHEN company_id % 7 = 0 THEN '{UNKNOWN_NODE}' ELSE reported_sector END AS node_id,
         (size * 2)::DOUBLE AS percent
  FROM dim_company WHERE company_id % 3 = 0)
"""
