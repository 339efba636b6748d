"""The registered queries of the engine and their DuckDB SQL, over the silver view of the order tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismfold.functions import names as N
from prismfold.functions import values as V
from prismfold.operators import frames as O
from prismfold.operators import tables as T
from prismfold.operators.quantiles import exact_quantiles
from prismfold.plans import exposure as E
from prismfold.plans import governance as G
from prismfold.plans import silver as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None, silver: bool = True):
    """Register a query under its name with its SQL; `silver` puts the silver tables before it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (S.SQL + "\n" + sql) if silver else sql
        return f

    return add


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.with_latest(S.scaled(spark, sf_dir), "fund_id", "as_of_date")


def _day(column: str):
    return F.date_format(column, "yyyy-MM-dd")


# Scaled holdings at each fund's own latest quarter, by a name column: count, value, share of the total.
_BREAKDOWN = """
SELECT {name} AS name, count(*) AS n_holdings, count(DISTINCT raw_id) AS n_companies, sum(scaled)::DOUBLE AS value,
       round(sum(scaled)::DOUBLE * 100 / (SELECT sum(scaled)::DOUBLE FROM latest), 4) AS pct
FROM latest LEFT JOIN dim_company ON raw_id = dim_company.company_id GROUP BY 1 {tail}"""


def _breakdown(spark: SparkSession, sf_dir: str, name) -> DataFrame:
    joined = _latest(spark, sf_dir).join(S.dim_company(spark, sf_dir).withColumnRenamed("company_id", "raw_id"), "raw_id", "left")
    sums = joined.groupBy(name.alias("name")).agg(F.count("*").alias("n_holdings"), F.countDistinct("raw_id").alias("n_companies"), F.sum("scaled").alias("v"))
    shared = O.with_share(sums, "v")
    return shared.select("name", "n_holdings", "n_companies", F.col("v").cast("double").alias("value"), "pct")


@_query(_BREAKDOWN.format(name="coalesce(primary_sector, 'Unclassified')", tail="ORDER BY value DESC, name LIMIT 10"))
def sector_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.top_n(_breakdown(spark, sf_dir, F.coalesce("primary_sector", F.lit("Unclassified"))), 10, "value", "name")


@_query(_BREAKDOWN.format(name="coalesce(primary_industry, 'Unclassified')", tail="ORDER BY value DESC, name LIMIT 20"))
def industry_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.top_n(_breakdown(spark, sf_dir, F.coalesce("primary_industry", F.lit("Unclassified"))), 20, "value", "name")


@_query(_BREAKDOWN.format(name="coalesce(primary_country, 'Unknown')", tail=""))
def country_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _breakdown(spark, sf_dir, F.coalesce("primary_country", F.lit("Unknown")))


@_query("SELECT fund_id, strftime(max(as_of_date), '%Y-%m-%d') AS latest, count(*) AS n, sum(scaled)::DOUBLE AS value FROM latest GROUP BY 1")
def latest_per_fund(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _latest(spark, sf_dir).groupBy("fund_id").agg(F.max("as_of_date").alias("d"), F.count("*").alias("n"), F.sum("scaled").cast("double").alias("value"))
    return out.select("fund_id", _day("d").alias("latest"), "n", "value")


@_query("""SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem
WHERE l_shipdate >= DATE '1998-01-01' AND l_quantity > 45 AND l_returnflag = 'R'""", silver=False)
def scan_project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R")
    return S.table(spark, sf_dir, "lineitem").filter(wanted).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")


@_query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS brand FROM part", silver=False)
def null_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 7 == 0, "NaN").when(F.col("p_partkey") % 4 == 0, " none ").otherwise(F.col("p_brand"))
    return S.table(spark, sf_dir, "part").select("p_partkey", V.clean_text(raw).alias("brand"))


@_query("""SELECT s_suppkey, (CASE s_suppkey % 6 WHEN 0 THEN 'United States' WHEN 1 THEN 'United Kingdom' WHEN 2 THEN 'Germany'
WHEN 3 THEN 'ZZ' WHEN 4 THEN 'Japan' ELSE 'Mexico' END) AS country FROM supplier""", silver=False)
def country_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.get(F.array(*[F.lit(c) for c in ("US", "UK", "DE", "ZZ", "JP", "MX")]), (F.col("s_suppkey") % 6).cast("int"))
    return S.table(spark, sf_dir, "supplier").select("s_suppkey", V.country_name(raw).alias("country"))


@_query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%00000001%'", silver=False)
def ilike_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "customer").filter(F.col("c_name").ilike("%00000001%")).select("c_custkey", "c_name")


@_query("SELECT holding_id, coalesce((CASE WHEN fund_id % 4 <> 0 THEN value * 0.05 END)::DOUBLE, value::DOUBLE, 0) AS effective FROM holdings GROUP BY ALL")
def effective_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.holdings(spark, sf_dir)
    scaled = F.when(F.col("fund_id") % 4 != 0, (F.col("value") * F.lit("0.05").cast("decimal(3,2)")).cast("double"))
    return rows.select("holding_id", F.coalesce(scaled, F.col("value").cast("double"), F.lit(0.0)).alias("effective")).distinct()


@_query("""SELECT country, n, round(n * 100.0 / sum(n) OVER (), 4)::DOUBLE AS pct_of_count FROM (
SELECT coalesce(primary_country, 'Unknown') AS country, count(*) AS n FROM latest LEFT JOIN dim_company ON raw_id = dim_company.company_id GROUP BY 1)""")
def geography_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _breakdown(spark, sf_dir, F.coalesce("primary_country", F.lit("Unknown"))).select(F.col("name").alias("country"), F.col("n_holdings").alias("n"))
    return O.with_share(out, "n", name="pct_of_count")


@_query("""SELECT count(*) AS n_holdings, count(DISTINCT fund_id) AS n_funds, count(DISTINCT company_id) AS n_companies, sum(value)::DOUBLE AS total,
(SELECT sum(scaled)::DOUBLE FROM latest) AS latest_total FROM holdings""")
def portfolio_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = S.holdings(spark, sf_dir).agg(F.count("*").alias("n_holdings"), F.countDistinct("fund_id").alias("n_funds"), F.countDistinct("company_id").alias("n_companies"), F.sum("value").cast("double").alias("total"))
    return stats.join(F.broadcast(_latest(spark, sf_dir).agg(F.sum("scaled").cast("double").alias("latest_total"))))


@_query("SELECT source, count(*) AS n, count(DISTINCT h.fund_id) AS n_funds, strftime(max(as_of_date), '%Y-%m-%d') AS latest FROM holdings h JOIN dim_fund USING (fund_id) WHERE source IS NOT NULL GROUP BY 1")
def source_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.holdings(spark, sf_dir).join(S.dim_fund(spark, sf_dir), "fund_id").filter("source is not null")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("fund_id").alias("n_funds"), F.date_format(F.max("as_of_date"), "yyyy-MM-dd").alias("latest"))


@_query("""SELECT coalesce(fund_type, 'Other') AS fund_type, count(DISTINCT fund_id) AS n_funds, sum(scaled)::DOUBLE AS value,
round(sum(scaled)::DOUBLE * 100 / (SELECT sum(scaled)::DOUBLE FROM latest), 4) AS pct FROM latest JOIN dim_fund USING (fund_id) GROUP BY 1""")
def allocation_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _latest(spark, sf_dir).join(S.dim_fund(spark, sf_dir), "fund_id")
    sums = rows.groupBy(F.coalesce("fund_type", F.lit("Other")).alias("fund_type")).agg(F.countDistinct("fund_id").alias("n_funds"), F.sum("scaled").alias("v"))
    return O.with_share(sums, "v").select("fund_type", "n_funds", F.col("v").cast("double").alias("value"), "pct")


_FUND_SECTORS = "SELECT fund_id, primary_sector AS sector, sum(scaled) AS v FROM latest JOIN dim_company ON raw_id = dim_company.company_id WHERE primary_sector IS NOT NULL GROUP BY 1, 2"


@_query(f"""SELECT fund_id, string_agg(sector, '|' ORDER BY rank) AS top_sectors FROM (
SELECT *, row_number() OVER (PARTITION BY fund_id ORDER BY v DESC, sector) AS rank FROM ({_FUND_SECTORS})) WHERE rank <= 3 GROUP BY 1""")
def top3_sectors_per_fund(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _latest(spark, sf_dir).join(S.dim_company(spark, sf_dir).withColumnRenamed("company_id", "raw_id"), "raw_id").filter("primary_sector is not null")
    sums = rows.groupBy("fund_id", F.col("primary_sector").alias("sector")).agg(F.sum("scaled").alias("v"))
    top = O.top_per_group(sums, "fund_id", 3, "v", "sector")
    return top.groupBy("fund_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sector"))), lambda s: s["sector"]), "|").alias("top_sectors"))


@_query("""SELECT fund_id, fund_name, n_reports, strftime(last, '%Y-%m-%d') AS last_report, (SELECT sum(scaled)::DOUBLE FROM latest l WHERE l.fund_id = f.fund_id) AS value
FROM (SELECT fund_id, count(*) AS n_reports, max(as_of_date) AS last FROM reports GROUP BY 1) JOIN dim_fund f USING (fund_id)""")
def funds_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = S.reports(spark, sf_dir).groupBy("fund_id").agg(F.count("*").alias("n_reports"), F.max("as_of_date").alias("last"))
    value = _latest(spark, sf_dir).groupBy("fund_id").agg(F.sum("scaled").cast("double").alias("value"))
    return told.join(S.dim_fund(spark, sf_dir), "fund_id").join(value, "fund_id", "left").select("fund_id", "fund_name", "n_reports", _day("last").alias("last_report"), "value")


@_query("""SELECT raw_id AS company_id, sum(scaled)::DOUBLE AS value, count(*) AS n FROM latest WHERE fund_id = 7 GROUP BY 1 ORDER BY sum(scaled) DESC, 1 LIMIT 15""")
def fund_detail_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.with_latest(S.scaled(spark, sf_dir).filter("fund_id = 7"), "fund_id", "as_of_date")
    sums = rows.groupBy(F.col("raw_id").alias("company_id")).agg(F.sum("scaled").alias("v"), F.count("*").alias("n"))
    return O.top_n(sums, 15, "v", "company_id").select("company_id", F.col("v").cast("double").alias("value"), "n")


@_query("""SELECT holding_id, fund_name, value::DOUBLE AS value FROM holdings JOIN dim_fund USING (fund_id) WHERE source = 'bdc_filing' AND value IS NOT NULL
GROUP BY ALL ORDER BY value DESC NULLS LAST, holding_id LIMIT 50 OFFSET 100""")
def holdings_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.holdings(spark, sf_dir).join(S.dim_fund(spark, sf_dir), "fund_id").filter("source = 'bdc_filing' and value is not null")
    rows = rows.select("holding_id", "fund_name", F.col("value").cast("double").alias("value")).distinct()
    return O.page(rows, [F.col("value").desc_nulls_last(), F.col("holding_id")], 3, 50)


@_query("""SELECT fund_id, strftime(as_of_date, '%Y-%m-%d') AS as_of_date, max(part) AS largest_pct, count(*) AS n FROM (
SELECT *, round(value::DOUBLE * 100 / sum(value) OVER (PARTITION BY fund_id, as_of_date)::DOUBLE, 4) AS part FROM holdings WHERE value > 0) GROUP BY 1, 2""")
def holdings_pct_of_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.with_share(S.holdings(spark, sf_dir).filter("value > 0"), "value", ["fund_id", "as_of_date"])
    return rows.groupBy("fund_id", "as_of_date").agg(F.max("pct").alias("largest_pct"), F.count("*").alias("n")).withColumn("as_of_date", _day("as_of_date"))


@_query("""SELECT option, kind FROM (SELECT DISTINCT coalesce(primary_sector, 'Unknown') AS option, 'sector' AS kind FROM dim_company
UNION ALL SELECT DISTINCT coalesce(primary_country, 'Unknown'), 'country' FROM dim_company UNION ALL SELECT DISTINCT source, 'source' FROM dim_fund)""")
def filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    company, fund = S.dim_company(spark, sf_dir), S.dim_fund(spark, sf_dir)
    pick = lambda df, c, kind: df.select(F.coalesce(c, F.lit("Unknown")).alias("option"), F.lit(kind).alias("kind")).distinct()
    out = pick(company, "primary_sector", "sector").unionByName(pick(company, "primary_country", "country")).unionByName(pick(fund, "source", "source"))
    return out.orderBy("kind", F.col("option") == "Unknown", "option")


@_query("""SELECT industry, sum(n) AS n, round(sum(n) * 100.0 / sum(sum(n)) OVER (), 4)::DOUBLE AS pct FROM (
SELECT coalesce(primary_industry, 'Unknown') AS industry, count(*) AS n FROM latest JOIN dim_company ON raw_id = dim_company.company_id WHERE reported_sector = (SELECT min(p_type) FROM part) GROUP BY 1) GROUP BY 1""")
def sector_detail_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    company = S.dim_company(spark, sf_dir).withColumnRenamed("company_id", "raw_id")
    first = company.agg(F.min("reported_sector").alias("reported_sector"))
    rows = _latest(spark, sf_dir).join(company.join(F.broadcast(first), "reported_sector", "left_semi"), "raw_id")
    return O.with_share(rows.groupBy(F.coalesce("primary_industry", F.lit("Unknown")).alias("industry")).agg(F.count("*").alias("n")), "n")


@_query("""SELECT name, sum(v)::DOUBLE AS value, round(sum(v)::DOUBLE * 100 / (SELECT sum(scaled)::DOUBLE FROM latest), 4) AS pct FROM (
SELECT CASE WHEN row_number() OVER (ORDER BY v DESC, name) <= 10 THEN name ELSE 'Other' END AS name, v FROM (
SELECT primary_industry AS name, sum(scaled) AS v FROM latest JOIN dim_company ON raw_id = dim_company.company_id WHERE primary_industry IS NOT NULL GROUP BY 1)) GROUP BY 1""")
def top10_and_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _latest(spark, sf_dir).join(S.dim_company(spark, sf_dir).withColumnRenamed("company_id", "raw_id"), "raw_id", "left")
    sums = rows.groupBy(F.coalesce("primary_industry", F.lit("Unclassified")).alias("name")).agg(F.sum("scaled").alias("v"))
    return O.top_n_other(sums, "name", "v", 10, "Unclassified").select("name", F.col("v").cast("double").alias("value"), "pct")


@_query("""SELECT company_id, sum(scaled)::DOUBLE AS value, count(DISTINCT fund_id) AS n_funds FROM latest WHERE company_id IS NOT NULL GROUP BY 1 ORDER BY sum(scaled) DESC, 1 LIMIT 20""")
def company_exposure_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _latest(spark, sf_dir).filter("company_id is not null").groupBy("company_id").agg(F.sum("scaled").alias("v"), F.countDistinct("fund_id").alias("n_funds"))
    return O.top_n(sums, 20, "v", "company_id").select("company_id", F.col("v").cast("double").alias("value"), "n_funds")


@_query("""SELECT fund_id, sum(value)::DOUBLE AS total, count(company_id) AS n_known, round(coalesce(sum(CASE WHEN company_id IS NULL THEN value END), 0)::DOUBLE * 100 / coalesce(nullif(sum(value)::DOUBLE, 0), 1), 4) AS unknown_pct FROM holdings GROUP BY 1""")
def fund_exposure_unknown_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    unknown = F.coalesce(F.sum(F.when(F.col("company_id").isNull(), F.col("value"))), F.lit(0))
    sums = S.holdings(spark, sf_dir).groupBy("fund_id").agg(F.sum("value").alias("v"), F.count("company_id").alias("n_known"), unknown.alias("u"))
    return sums.select("fund_id", F.col("v").cast("double").alias("total"), "n_known", V.share(F.col("u"), F.col("v")).alias("unknown_pct"))


@_query("""SELECT node_id, count(percent) AS n, round(avg(percent), 6) AS mean, min(percent) AS least, max(percent) AS most, round(avg(CASE WHEN percent < 70 THEN 100.0 ELSE 0 END), 4)::DOUBLE AS below_pct FROM classifications GROUP BY 1""")
def confidence_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("percent")
    return S.classifications(spark, sf_dir).groupBy("node_id").agg(
        F.count(p).alias("n"), F.round(F.avg(p), 6).alias("mean"), F.min(p).alias("least"), F.max(p).alias("most"), F.round(F.avg(F.when(p < 70, 100.0).otherwise(0.0)), 4).alias("below_pct")
    )


@_query("""SELECT count(*) AS n, count(company_id) AS classified, count(value) AS with_value, round(count(company_id) * 100.0 / count(*), 4)::DOUBLE AS classified_pct, round(count(value) * 100.0 / count(*), 4)::DOUBLE AS value_pct FROM holdings""")
def portfolio_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = S.holdings(spark, sf_dir).agg(F.count("*").alias("n"), F.count("company_id").alias("classified"), F.count("value").alias("with_value"))
    return sums.select("*", V.share(F.col("classified"), F.col("n")).alias("classified_pct"), V.share(F.col("with_value"), F.col("n")).alias("value_pct"))


_EXPOSURES = """,
base AS (
  SELECT r.*, 100000000.0 / count(*) OVER (PARTITION BY as_of_date) AS alloc, coalesce(c.covered, 0) AS covered,
         CASE WHEN coalesce(c.covered, 0) > 0 AND coverage > 0 THEN c.covered / coverage WHEN coalesce(c.covered, 0) > 0 THEN c.covered ELSE 1 END AS nav
  FROM reports r LEFT JOIN (SELECT fund_id, as_of_date, sum(value)::DOUBLE AS covered FROM holdings GROUP BY 1, 2) c USING (fund_id, as_of_date)),
worths AS (
  SELECT h.*, alloc, round(CASE WHEN value > 0 THEN value::DOUBLE WHEN pct > 0 THEN pct * nav ELSE 0 END, 6)::DECIMAL(28,6) AS worth
  FROM holdings h JOIN base USING (fund_id, as_of_date)),
exposures AS (
  SELECT fund_id, as_of_date, holding_id, company_id, 'reported' AS exposure_type,
         alloc * worth::DOUBLE / coalesce(nullif(sum(worth) OVER (PARTITION BY fund_id, as_of_date)::DOUBLE, 0), 1) AS exposure FROM worths
  UNION ALL SELECT fund_id, as_of_date, NULL, NULL, 'unknown', alloc * (1 - coverage) FROM base WHERE coverage < 1)
"""


def _exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.infer_exposures(S.reports(spark, sf_dir), S.holdings(spark, sf_dir))


@_query(_EXPOSURES + "SELECT fund_id, strftime(as_of_date, '%Y-%m-%d') AS as_of_date, exposure_type, count(*) AS n, round(sum(exposure::DECIMAL(28,8)), 2)::DOUBLE AS exposure, round(max(exposure), 2) AS largest FROM exposures GROUP BY 1, 2, 3")
def exposure_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _exposures(spark, sf_dir).groupBy("fund_id", "as_of_date", "exposure_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("exposure").cast("decimal(28,8)")), 2).cast("double").alias("exposure"), F.round(F.max("exposure"), 2).alias("largest"))
    return sums.withColumn("as_of_date", _day("as_of_date"))


@_query(_EXPOSURES + "SELECT fund_id, strftime(as_of_date, '%Y-%m-%d') AS as_of_date, round(exposure, 4) AS exposure FROM exposures WHERE exposure_type = 'unknown'")
def unknown_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exposures(spark, sf_dir).filter("exposure_type = 'unknown'").select("fund_id", _day("as_of_date").alias("as_of_date"), F.round("exposure", 4).alias("exposure"))


@_query("""SELECT fund_id, strftime(as_of_date, '%Y-%m-%d') AS as_of_date, round(CASE WHEN least(n, 8) - 1 <= 0 THEN 62.0 ELSE 62.0 + least(i, least(n, 8) - 1) / (least(n, 8) - 1) * 7.0 END, 6)::DOUBLE AS nav FROM (
SELECT fund_id, as_of_date, (row_number() OVER (PARTITION BY fund_id ORDER BY as_of_date) - 1)::DOUBLE AS i, count(*) OVER (PARTITION BY fund_id)::DOUBLE AS n FROM reports)""")
def lp_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_fund = Window.partitionBy("fund_id")
    rows = S.reports(spark, sf_dir).withColumns({"i": F.row_number().over(by_fund.orderBy("as_of_date")) - 1, "n": F.count("*").over(by_fund)})
    return rows.select("fund_id", _day("as_of_date").alias("as_of_date"), F.round(E.interpolate(F.col("i"), F.col("n"), 62.0, 69.0), 6).alias("nav"))


@_query(""", q AS (SELECT h.*, source, sum(value) OVER (PARTITION BY fund_id, as_of_date)::DOUBLE AS total FROM holdings h JOIN dim_fund USING (fund_id) WHERE value > 0),
n AS (SELECT fund_id, as_of_date, CASE WHEN fund_id % 2 = 0 THEN 1000000.0 END AS nav, CASE WHEN fund_id % 4 = 0 THEN 0.0 ELSE 25000000.0 END AS net FROM reports),
s AS (SELECT q.*, CASE WHEN source = 'pdf_document' THEN nullif(nav, 0) ELSE total * 0.05 END AS lp_nav, CASE WHEN source = 'pdf_document' THEN coalesce(nullif(net, 0), total) ELSE total END AS base FROM q JOIN n USING (fund_id, as_of_date))
SELECT fund_id, strftime(as_of_date, '%Y-%m-%d') AS as_of_date, count(*) AS n, round(max(lp_nav), 4) AS lp_nav, round(sum((lp_nav * (value::DOUBLE / base))::DECIMAL(28,8)), 2)::DOUBLE AS scaled FROM s WHERE lp_nav IS NOT NULL GROUP BY 1, 2""")
def lp_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    fund = S.dim_fund(spark, sf_dir).select("fund_id", "fund_name", "source")
    told = S.reports(spark, sf_dir).select("fund_id", "as_of_date", F.when(F.col("fund_id") % 2 == 0, 1_000_000.0).alias("nav"), F.when(F.col("fund_id") % 4 == 0, 0.0).otherwise(25_000_000.0).alias("net_assets"))
    rows = E.scale_to_investor(S.holdings(spark, sf_dir).join(F.broadcast(fund), "fund_id"), told, {})
    return rows.groupBy("fund_id", "as_of_date").agg(F.count("*").alias("n"), F.round(F.max("lp_nav"), 4).alias("lp_nav"), F.round(F.sum(F.col("scaled").cast("decimal(28,8)")), 2).cast("double").alias("scaled")).withColumn("as_of_date", _day("as_of_date"))


_RESOLVED = """, resolved AS (
SELECT s.*, coalesce(c.node_id, CASE WHEN d.company_id % 4 = 0 THEN d.reported_sector END, d.primary_sector, '%s') AS node,
       (CASE WHEN c.node_id IS NOT NULL THEN c.percent::DECIMAL(5,0) / 100 WHEN d.company_id %% 4 = 0 THEN 0.75 WHEN d.primary_sector IS NOT NULL THEN 1 ELSE 0 END)::DECIMAL(4,2) AS confidence
FROM scaled s LEFT JOIN dim_company d USING (company_id) LEFT JOIN classifications c USING (company_id))
""".replace("company_id % 4", "company_id %% 4") % S.UNKNOWN_NODE


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    company = S.dim_company(spark, sf_dir)
    classified = S.classifications(spark, sf_dir).select("company_id", "node_id", (F.col("percent") / 100).alias("confidence"))
    by_text = company.filter("company_id % 4 = 0").select("company_id", F.col("reported_sector").alias("text_node"))
    own = company.select("company_id", F.col("primary_sector").alias("own_node"))
    out = E.resolve_taxonomy(S.scaled(spark, sf_dir), classified, by_text, own, S.UNKNOWN_NODE)
    return out.withColumn("confidence", F.col("confidence").cast("decimal(4,2)"))


@_query(_RESOLVED + "SELECT node, confidence::DOUBLE AS confidence, count(*) AS n FROM resolved GROUP BY 1, 2")
def taxonomy_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).groupBy(F.col("node_id").alias("node"), F.col("confidence").cast("double").alias("confidence")).agg(F.count("*").alias("n"))


_ROLLUP = _RESOLVED + """, long AS (
SELECT fund_id, as_of_date, 'sector' AS taxonomy_type, node AS node_id, scaled, confidence FROM resolved
UNION ALL SELECT fund_id, as_of_date, 'fund_parity', CASE WHEN fund_id % 2 = 0 THEN 'even' ELSE 'odd' END, scaled, confidence FROM resolved),
rolled AS (SELECT CASE WHEN grouping(fund_id) = 1 THEN '' ELSE fund_id::VARCHAR END AS fund, as_of_date, taxonomy_type, node_id, sum(scaled) AS total, sum(scaled * confidence) AS weighted
FROM long GROUP BY GROUPING SETS ((as_of_date, taxonomy_type, node_id), (fund_id, as_of_date, taxonomy_type, node_id)))
"""


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _resolved(spark, sf_dir).withColumn("parity", F.when(F.col("fund_id") % 2 == 0, "even").otherwise("odd"))
    return E.rollup(rows, "scaled", {"sector": "node_id", "fund_parity": "parity"}, "confidence")


@_query(_ROLLUP + "SELECT fund, strftime(as_of_date, '%Y-%m-%d') AS as_of_date, taxonomy_type, node_id, total::DOUBLE AS total, weighted::DOUBLE AS weighted FROM rolled")
def taxonomy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir).select("fund", _day("as_of_date").alias("as_of_date"), "taxonomy_type", "node_id", F.col("total").cast("double").alias("total"), F.col("weighted").cast("double").alias("weighted"))


_COVERED = _ROLLUP + f""", covered AS (SELECT *, coalesce(round(sum(CASE WHEN node_id <> '{S.UNKNOWN_NODE}' THEN total ELSE 0 END) OVER w::DOUBLE / nullif(sum(total) OVER w::DOUBLE, 0), 6), 0) AS coverage_pct
FROM rolled WINDOW w AS (PARTITION BY fund, as_of_date, taxonomy_type))
"""


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.coverage(_rolled(spark, sf_dir), "total", F.col("node_id") != S.UNKNOWN_NODE, ["fund", "as_of_date", "taxonomy_type"])


@_query(_COVERED + "SELECT fund, strftime(as_of_date, '%Y-%m-%d') AS as_of_date, taxonomy_type, node_id, coverage_pct FROM covered")
def coverage_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir).select("fund", _day("as_of_date").alias("as_of_date"), "taxonomy_type", "node_id", "coverage_pct")


@_query(_COVERED + "SELECT fund, taxonomy_type, node_id, strftime(max(as_of_date), '%Y-%m-%d') AS as_of_date, max_by(total, as_of_date)::DOUBLE AS total, max_by(coverage_pct, as_of_date) AS coverage_pct FROM covered GROUP BY 1, 2, 3")
def snapshot_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = E.keep_last(_covered(spark, sf_dir), ["fund", "taxonomy_type", "node_id"], "as_of_date")
    return kept.select("fund", "taxonomy_type", "node_id", _day("as_of_date").alias("as_of_date"), F.col("total").cast("double").alias("total"), "coverage_pct")


@_query(""", v AS (SELECT strftime(as_of_date, '%Y-%m-%d') AS d, coalesce(primary_industry, 'Unclassified') AS name, sum(scaled) AS v FROM scaled LEFT JOIN dim_company ON raw_id = dim_company.company_id GROUP BY 1, 2),
dense AS (SELECT d, name, coalesce(v.v, 0)::DECIMAL(38,4) AS v FROM (SELECT DISTINCT d FROM v) CROSS JOIN (SELECT DISTINCT name FROM v) LEFT JOIN v USING (d, name)),
s AS (SELECT d, name, round(v::DOUBLE * 100 / sum(v) OVER (PARTITION BY d)::DOUBLE, 10) AS s FROM dense),
r AS (SELECT name, row_number() OVER (ORDER BY round(avg(s), 8) DESC, name) AS r FROM s GROUP BY 1)
SELECT d, CASE WHEN r <= 6 THEN name ELSE 'Other' END AS name, round(sum(s), 4) AS pct FROM s JOIN r USING (name) GROUP BY 1, 2""")
def trend_top6_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    company = S.dim_company(spark, sf_dir).select(F.col("company_id").alias("raw_id"), F.coalesce("primary_industry", F.lit("Unclassified")).alias("name"))
    rows = S.scaled(spark, sf_dir).join(company, "raw_id", "left").select(_day("as_of_date").alias("d"), F.coalesce("name", F.lit("Unclassified")).alias("name"), "scaled")
    return O.share_trend(rows, "d", "name", "scaled")


@_query("""SELECT c_custkey, md5_uuid AS uuid FROM (SELECT c_custkey, regexp_replace(md5('lp_pos_' || c_custkey), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS md5_uuid FROM customer)""", silver=False)
def md5_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "customer").select("c_custkey", N.md5_uuid(F.concat(F.lit("lp_pos_"), F.col("c_custkey"))).alias("uuid"))


_NORM = r"""array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(trim({0})), '\([^)]*\)', '', 'g'), '[,.()]', ' ', 'g'), '\s+'),
lambda w: w <> '' AND NOT list_contains(['inc','llc','lp','l.p.','corp','corporation','ltd','limited','co','holdings','group','holdco','parent','topco','bidco','buyer','acquiror','investor','acquisition','purchaser','and','the','of','dba','fka','aka'], w)), ' ')"""
_RAW = "upper(p_name) || CASE p_partkey % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Holdings LLC (fka Old)' WHEN 2 THEN ' and the Co.' ELSE ' L.P.' END"


def _raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.get(F.array(*[F.lit(t) for t in (", Inc.", " Holdings LLC (fka Old)", " and the Co.", " L.P.")]), (F.col("p_partkey") % 4).cast("int"))
    return S.table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat(F.upper("p_name"), tail).alias("raw"))


@_query(f"SELECT p_partkey, {_NORM.format(_RAW)} AS norm FROM part", silver=False)
def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_names(spark, sf_dir).select("p_partkey", N.normalize_name(F.col("raw")).alias("norm"))


@_query(f"""WITH n AS (SELECT DISTINCT {_NORM.format('p_name')} AS norm FROM part), t AS (SELECT norm, list_distinct(list_filter(string_split(norm, ' '), lambda w: w <> '')) AS w FROM n)
SELECT a.norm AS left_name, b.norm AS right_name, round(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), 6) AS score FROM t a JOIN t b ON a.norm <> b.norm
WHERE len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) >= 0.3""", silver=False)
def jaccard_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismfold.operators.similarity import token_join

    names = S.table(spark, sf_dir, "part").select(N.normalize_name(F.col("p_name")).alias("id")).distinct().withColumn("tokens", N.tokens(F.col("id")))
    pairs = token_join(names, names, 0.3).filter("left_id <> right_id")
    return pairs.select(F.col("left_id").alias("left_name"), F.col("right_id").alias("right_name"), F.round("score", 6).alias("score"))


@_query(f"""WITH c AS (SELECT p_partkey AS id, p_name AS name, {_NORM.format('p_name')} AS norm FROM part WHERE p_partkey % 3 = 0),
d AS (SELECT lower(trim(name)) AS k, max(id) AS id FROM c GROUP BY 1), n AS (SELECT norm, min(id) AS id FROM c GROUP BY 1),
r AS (SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN ' ' || upper(p_name) ELSE upper(p_name) || ', Inc.' END AS raw FROM part)
SELECT p_partkey, coalesce(d.id, n.id) AS company_id, CASE WHEN d.id IS NOT NULL THEN 'direct' WHEN n.id IS NOT NULL THEN 'normalized' ELSE 'unresolved' END AS method,
(CASE WHEN d.id IS NOT NULL THEN 1.0 WHEN n.id IS NOT NULL THEN 0.9 ELSE 0 END)::DOUBLE AS confidence
FROM r LEFT JOIN d ON lower(trim(raw)) = d.k LEFT JOIN n ON {_NORM.format('raw')} = n.norm""", silver=False)
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismfold.plans.resolution import resolve_names

    part = S.table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    raw = F.when(key % 8 == 0, None).when(key % 2 == 0, F.concat(F.lit(" "), F.upper("p_name"))).otherwise(F.concat(F.upper("p_name"), F.lit(", Inc.")))
    companies = part.filter(key % 3 == 0).select(key.alias("company_id"), F.col("p_name").alias("company_name"))
    aliases = spark.createDataFrame([], "company_id long, alias string")
    # names here share single words only, so 1.0 keeps the overlap stage to equal word sets, which the normal form has
    out = resolve_names(part.select(key.alias("id"), raw.alias("name")), companies, aliases, 1.0)
    return out.select(F.col("id").alias("p_partkey"), "company_id", "method", "confidence")


@_query(f"""SELECT norm, count(*) AS n, min(p_partkey) AS first_id FROM (SELECT p_partkey, {_NORM.format('p_name')} AS norm FROM part) GROUP BY 1 HAVING count(*) > 1""", silver=False)
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "part").select("p_partkey", N.normalize_name(F.col("p_name")).alias("norm"))
    return T.duplicated(rows, ["norm"]).groupBy("norm").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id"))


@_query(_EXPOSURES + f""", t AS (SELECT company_id, sum(exposure) AS total FROM exposures WHERE company_id IS NOT NULL GROUP BY 1)
SELECT reason, priority, count(*) AS n FROM (
SELECT 'low_confidence' AS reason, CASE WHEN percent < 30 THEN 'high' WHEN percent < 70 THEN 'medium' ELSE 'low' END AS priority FROM classifications WHERE node_id <> '{S.UNKNOWN_NODE}' AND percent < 70
UNION ALL SELECT 'unclassifiable_company', CASE WHEN percent < 30 THEN 'high' WHEN percent < 70 THEN 'medium' ELSE 'low' END FROM classifications WHERE node_id = '{S.UNKNOWN_NODE}' AND primary_sector IS NULL
UNION ALL SELECT 'unresolved_entity', 'high' FROM dim_company WHERE company_id % 50 = 0
UNION ALL SELECT 'large_unknown_exposure', 'medium' FROM exposures WHERE exposure_type = 'unknown' AND exposure > 300000.5
UNION ALL SELECT 'large_unclassified_company', 'medium' FROM t JOIN dim_company USING (company_id) WHERE primary_sector IS NULL AND total > 900000.5 AND company_id % 3 <> 0) GROUP BY 1, 2""")
def review_queue_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = S.classifications(spark, sf_dir).select("company_id", "node_id", (F.col("percent") / 100).alias("confidence"))
    company = S.dim_company(spark, sf_dir)
    log = company.filter("company_id % 50 = 0").select(F.col("company_id").alias("id"), F.lit("unresolved").alias("method"))
    exposures = _exposures(spark, sf_dir).withColumn("exposure_id", F.concat_ws("-", "fund_id", "as_of_date", "holding_id"))
    queue = G.review_queue(classified, log, exposures, company, S.UNKNOWN_NODE, unknown_limit=300_000.5, company_limit=900_000.5)
    return queue.groupBy("reason", "priority").agg(F.count("*").alias("n"))


@_query("""SELECT k AS priority, coalesce(n, 0) AS n FROM (VALUES ('high'), ('medium'), ('low'), ('none')) v(k)
LEFT JOIN (SELECT CASE WHEN percent < 30 THEN 'high' WHEN percent < 70 THEN 'medium' ELSE 'low' END AS p, count(*) AS n FROM classifications GROUP BY 1) ON k = p""")
def priority_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = S.classifications(spark, sf_dir).groupBy(G.priority(F.col("percent") / 100).alias("priority")).agg(F.count("*").alias("n"))
    keys = spark.createDataFrame([(k,) for k in ("high", "medium", "low", "none")], "priority string")
    return keys.join(F.broadcast(counts), "priority", "left").select("priority", F.coalesce("n", F.lit(0)).alias("n"))


@_query("""SELECT regexp_replace(md5(event_type || '|user|' || event_id), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS audit_event_id, event_type AS action, user_id::VARCHAR AS actor,
(json_extract_string(props, '$.k'))::BIGINT AS k FROM events WHERE ts >= TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 100""", silver=False)
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "events").filter(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"))
    page = O.page(rows, [F.col("ts").desc(), F.col("event_id")], 1, 100, most=500)
    key = F.concat_ws("|", "event_type", F.lit("user"), F.col("event_id").cast("string"))
    return page.select(N.md5_uuid(key).alias("audit_event_id"), F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("actor"), F.get_json_object("props", "$.k").cast("long").alias("k"))


_OLD = "SELECT c_custkey, c_name, c_acctbal FROM customer"
# every customer in debt, and a fresh key for each
_NEW = "FROM (SELECT unnest([c_custkey, -c_custkey]) AS c_custkey FROM customer WHERE c_acctbal < 0)"


def _changed(customer: DataFrame) -> DataFrame:
    return customer.filter("c_acctbal < 0").select(F.explode(F.array(F.col("c_custkey"), -F.col("c_custkey"))).alias("c_custkey"))


@_query(f"""WITH old AS ({_OLD}), new AS (SELECT c_custkey, 'new' AS c_name {_NEW})
SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new) UNION ALL SELECT c_custkey, c_name, NULL FROM new""", silver=False)
def upsert_full_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = S.table(spark, sf_dir, "customer")
    return T.upsert(customer.select("c_custkey", "c_name", "c_acctbal"), _changed(customer).withColumn("c_name", F.lit("new")), ["c_custkey"])


@_query(f"""WITH old AS ({_OLD}), new AS (SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN 'new' END AS c_name, 0.0::DOUBLE AS c_acctbal {_NEW})
SELECT coalesce(new.c_custkey, old.c_custkey) AS c_custkey, coalesce(new.c_name, old.c_name) AS c_name, coalesce(new.c_acctbal, old.c_acctbal) AS c_acctbal FROM old FULL JOIN new ON old.c_custkey = new.c_custkey""", silver=False)
def merge_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = S.table(spark, sf_dir, "customer")
    old = customer.select("c_custkey", "c_name", "c_acctbal")
    new = _changed(customer).select("c_custkey", F.when(F.col("c_custkey") % 20 == 0, "new").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return T.merge_nonnull(old, new, ["c_custkey"])


@_query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE >= DATE '2000-02-29' - INTERVAL 24 MONTH", silver=False)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return T.retain(rows, "day", F.lit("2000-02-29").cast("date")).select("o_orderkey")


@_query(""", s AS (SELECT coalesce(reported_sector, '') AS name, sum(scaled)::DOUBLE AS value FROM latest JOIN dim_company ON raw_id = dim_company.company_id GROUP BY 1),
r AS (SELECT name, value, sum(value) OVER () AS total, ('0x' || substr(md5(name), 1, 6))::BIGINT AS h FROM s),
m AS (SELECT name, k AS steps, total, greatest(value / total + (CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END) * (0.008::DOUBLE + (h % 1000)::DOUBLE / 50000) * k, 0.001) AS moved FROM r, range(8) t(k))
SELECT name, steps::INTEGER AS steps, round(moved / sum(moved) OVER (PARTITION BY steps) * total, 2) AS value FROM m""")
def history_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    company = S.dim_company(spark, sf_dir).select(F.col("company_id").alias("raw_id"), F.col("reported_sector").alias("name"))
    shares = _latest(spark, sf_dir).join(company, "raw_id").groupBy("name").agg(F.sum("scaled").alias("value")).withColumn("node", F.col("name"))
    return E.drift_history(shares).select("name", "steps", F.round("value", 2).alias("value"))


@_query("""SELECT p_partkey, regexp_matches(lower(p_name || CASE p_partkey % 3 WHEN 0 THEN ' Warrant' WHEN 1 THEN ' T-Bill 2030' ELSE ' Ltd' END), 'warrant|t-bill|rights|ether|eth|etf|crypto|spac|btc|defi|treasury|bitcoin') AS is_instrument FROM part""", silver=False)
def instrument_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.get(F.array(F.lit(" Warrant"), F.lit(" T-Bill 2030"), F.lit(" Ltd")), (F.col("p_partkey") % 3).cast("int"))
    return S.table(spark, sf_dir, "part").select("p_partkey", V.is_instrument(F.concat("p_name", tail)).alias("is_instrument"))


@_query("SELECT 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS label, count(*) AS n FROM orders GROUP BY 1", silver=False)
def quarter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "orders").groupBy(V.quarter_label(F.to_date("o_orderdate")).alias("label")).agg(F.count("*").alias("n"))


@_query("SELECT n_name AS node, 2 AS level, '/' || r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 1, '/' || r_name FROM region", silver=False)
def taxonomy_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = S.table(spark, sf_dir, "region"), S.table(spark, sf_dir, "nation")
    nodes = region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name")).unionByName(
        nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    )
    sql = """WITH RECURSIVE t AS (
        SELECT id, name AS node, 1 AS level, concat('/', name) AS path FROM {nodes} WHERE parent IS NULL
        UNION ALL SELECT n.id, n.name, t.level + 1, concat(t.path, '/', n.name) FROM {nodes} n JOIN t ON n.parent = t.id)
        SELECT node, level, path FROM t"""
    return spark.sql(sql, nodes=nodes)


@_query("""SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_quantity, 0.9), 6) AS p90, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY 1""", silver=False)
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_quantiles(S.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", {"median": 0.5, "p90": 0.9, "least": 0.0, "most": 1.0})
    return found.select("l_returnflag", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"), "least", "most")


@_query("""SELECT l_linenumber, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.01), 6) AS p1, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1""", silver=False)
def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearly as many distinct values as rows: bands of sketches go down to a thousand rows before any are sorted."""
    asked = {"p1": 0.01, "median": 0.5, "p99": 0.99}
    found = exact_quantiles(S.table(spark, sf_dir, "lineitem"), ["l_linenumber"], "l_extendedprice", asked, settle=1000)
    return found.select("l_linenumber", "n", *[F.round(c, 6).alias(c) for c in asked])


@_query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1""", silver=False)
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.dedupe(S.table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@_query("""SELECT c_custkey % 100 AS k, mode FROM (SELECT c_custkey % 100 AS k, c_mktsegment AS mode, row_number() OVER (PARTITION BY c_custkey % 100 ORDER BY count(*) DESC, c_mktsegment) AS r, c_custkey % 100 AS c_custkey FROM customer GROUP BY 1, 2) WHERE r = 1""", silver=False)
def mode_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = S.table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 100).alias("k"), F.col("c_mktsegment").alias("mode")).agg(F.count("*").alias("n"))
    return O.top_per_group(counts, "k", 1, "n", "mode").select("k", "mode")


@_query("SELECT (json_extract_string(props, '$.k'))::BIGINT % 10 AS k, count(*) AS n, round(sum(value::DECIMAL(18,6))::DOUBLE, 4) AS total FROM events GROUP BY 1", silver=False)
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "events").select((F.get_json_object("props", "$.k").cast("long") % 10).alias("k"), F.col("value").cast("decimal(18,6)").alias("v"))
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("v").cast("double"), 4).alias("total"))


@_query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2", silver=False)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismfold.streaming.feeds import windowed_counts

    return windowed_counts(S.table(spark, sf_dir, "events"), "ts", "event_type", "value").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@_query("""SELECT p_partkey, rule FROM (SELECT p_partkey, CASE WHEN p_size < 45 THEN NULL ELSE 'size' END AS rule FROM part UNION ALL SELECT p_partkey, CASE WHEN p_retailprice < 1900 THEN NULL ELSE 'price' END FROM part) WHERE rule IS NOT NULL""", silver=False)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.violations(S.table(spark, sf_dir, "part"), "p_partkey", {"size": F.col("p_size") < 45, "price": F.col("p_retailprice") < 1900})


@_query("""SELECT o_custkey, o_orderkey, last_value(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM orders""", silver=False)
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("filled"))
    return O.forward_fill(rows, "filled", ["o_custkey"], "o_orderkey")
