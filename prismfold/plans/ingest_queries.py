"""The registered queries of ingest by content, over listings that are made from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismfold.plans import silver as S
from prismfold.plans.queries import _query
from prismfold.sources.catalog import Catalog, shared_folder
from prismfold.sources.filings import info_table_holdings
from prismfold.sources.manifest import ingest, summary


def _listing(docs: DataFrame, text: Column) -> DataFrame:
    path = F.concat_ws("/", F.lit("in"), F.coalesce("lang", F.lit("und")), F.col("doc_id").cast("string"))
    return docs.select(path.alias("path"), F.lit(None).cast("timestamp").alias("modificationTime"), F.octet_length(text).cast("long").alias("length"), F.encode(text, "UTF-8").alias("content"))


# two thirds of the documents first; then all of them, of which a fifth has other texts
_RUNS = """WITH d AS (SELECT doc_id, 'in/' || coalesce(lang, 'und') || '/' || doc_id AS path, coalesce(lang, 'und') AS folder, coalesce(text, '') AS text FROM documents),
one AS (SELECT path, folder, md5(text) AS hash FROM d WHERE doc_id % 3 <> 0),
two AS (SELECT path, folder, md5(text || CASE WHEN doc_id % 5 = 0 THEN ' second' ELSE '' END) AS hash FROM d),
found AS (SELECT path, folder, hash, CASE WHEN hash IN (SELECT hash FROM one) THEN 'ingested' WHEN path IN (SELECT path FROM one) THEN 'changed' ELSE 'new' END AS status,
  hash NOT IN (SELECT hash FROM one) AND path = min(path) OVER (PARTITION BY hash) AS fresh FROM two)
"""


def _second_run(spark: SparkSession, sf_dir: str) -> tuple[Catalog, DataFrame]:
    catalog, docs = Catalog(spark, shared_folder(spark, "catalog")), S.table(spark, sf_dir, "documents")
    text, key = F.coalesce("text", F.lit("")), F.col("doc_id")
    words = lambda files: files.select("hash", F.length(F.decode("content", "UTF-8")).alias("n_chars"))
    ingest(catalog, "manifest", _listing(docs.filter(key % 3 != 0), text), "run-1", words, "sizes")
    second = _listing(docs, F.concat(text, F.when(key % 5 == 0, " second").otherwise("")))
    return catalog, ingest(catalog, "manifest", second, "run-2", words, "sizes")


@_query(_RUNS + "SELECT path, hash, status, fresh FROM found", silver=False)
def manifest_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _second_run(spark, sf_dir)[1].select("path", "hash", "status", "fresh")


@_query(_RUNS + """, t AS (SELECT folder, count(DISTINCT hash) AS tracked FROM (SELECT folder, hash FROM one UNION ALL SELECT folder, hash FROM two) GROUP BY 1)
SELECT folder, tracked, count(*) FILTER (status = 'ingested') AS ingested, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'new') AS new FROM found JOIN t USING (folder) GROUP BY 1, 2""", silver=False)
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, found = _second_run(spark, sf_dir)
    return summary(found, catalog.table("manifest"))


@_query(_RUNS + """SELECT hash, length(text)::INT AS n_chars FROM (SELECT md5(text) AS hash, text FROM d WHERE doc_id % 3 <> 0
UNION SELECT md5(t), t FROM (SELECT text || CASE WHEN doc_id % 5 = 0 THEN ' second' ELSE '' END AS t FROM d))""", silver=False)
def ingested_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each content, however many files hold it and however often they were listed."""
    return _second_run(spark, sf_dir)[0].table("sizes").select("hash", "n_chars")


# an information table for each order: a third with prefixed names, values with commas, or none that is a number
@_query("""WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, l_partkey, l_quantity::BIGINT * 1000 + l_linenumber AS v, l_linenumber FROM lineitem)
SELECT md5('13f_' || l_orderkey || '_' || CASE WHEN l_partkey % 5 = 0 THEN '' ELSE lpad(l_partkey::VARCHAR, 9, '0') END || '_' || i) AS digest, l_orderkey::VARCHAR AS fund_report_id, i::INT AS row_number, 'Issuer ' || l_partkey AS raw_company_name,
CASE WHEN l_partkey % 5 <> 0 THEN lpad(l_partkey::VARCHAR, 9, '0') END AS cusip, (CASE WHEN l_linenumber = 7 THEN 0 ELSE v * 1000 END)::DOUBLE AS reported_value_usd, strftime(o_orderdate, '%Y-%m-%d') AS as_of_date
FROM r JOIN orders ON l_orderkey = o_orderkey""", silver=False)
def information_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables in XML, made from the lines of an order, and read again with the fields of their filing."""
    key, n, prefix = F.col("l_partkey"), F.col("l_linenumber"), F.when(F.col("l_orderkey") % 3 == 0, "ns1:").otherwise("")
    tag = lambda name, value: F.concat(F.lit("<"), prefix, F.lit(name + ">"), value, F.lit("</"), prefix, F.lit(name + ">"))
    value = F.when(n == 7, "n/a").otherwise(F.format_number(F.col("l_quantity").cast("long") * 1000 + n, 0))
    row = tag("infoTable", F.concat(tag("nameOfIssuer", F.concat(F.lit("Issuer "), key)), tag("cusip", F.when(key % 5 == 0, "").otherwise(F.lpad(key.cast("string"), 9, "0"))), tag("value", value)))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", row.alias("row")))), lambda r: r["row"]), "")
    bodies = S.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rows.alias("rows"))
    body = F.concat(F.lit("<"), prefix, F.lit('informationTable xmlns:ns1="http://x">'), "rows", F.lit("</"), prefix, F.lit("informationTable>"))
    orders = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("period"))
    filings = bodies.join(orders, "l_orderkey").select(F.col("l_orderkey").cast("string").alias("fund_report_id"), "period", body.alias("body"))
    found = info_table_holdings(filings, 1000)
    return found.select(F.replace("reported_holding_id", F.lit("-"), F.lit("")).alias("digest"), "fund_report_id", "row_number", "raw_company_name", "cusip", "reported_value_usd", "as_of_date")
