"""The registered queries of stored tables: concurrent writers, snapshots, changes and their audit events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismfold.plans import exposure as E
from prismfold.plans import governance as G
from prismfold.plans import silver as S
from prismfold.plans.queries import _query
from prismfold.sources.catalog import Catalog, Conflict, shared_folder


def _catalog(spark: SparkSession) -> Catalog:
    return Catalog(spark, shared_folder(spark, "catalog"))


def _stored_orders(spark: SparkSession, sf_dir: str) -> Catalog:
    """Orders in a table after an append, an upsert, a merge, a delete, and a writer that came too late."""
    orders = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(15,2)").alias("o_totalprice"))
    key, catalog, late = F.col("o_orderkey"), _catalog(spark), None
    catalog.replace("orders", orders.filter(key % 4 != 0))
    late = Catalog(spark, catalog.path)
    stale = late.table("orders").filter("o_orderstatus <> 'O'")
    catalog.append("orders", orders.filter(key % 8 == 0))
    try:
        late.replace("orders", stale)
        raise AssertionError("a writer from an older version was let through")
    except Conflict:
        pass
    catalog.upsert("orders", orders.filter(key % 12 == 0).withColumn("o_orderstatus", F.lit("U")), ["o_orderkey"])
    # a late writer's merge is replayed on the newest version
    late.merge("orders", orders.filter(key % 10 == 0).select("o_orderkey", F.when(key % 20 == 0, F.lit("M")).alias("o_orderstatus")), ["o_orderkey"], {"o_orderstatus": ["U"]})
    catalog.delete("orders", key % 9 == 0)
    return catalog


_ORDERS = """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice::DECIMAL(15,2) AS o_totalprice FROM orders),
v2 AS (SELECT * FROM o WHERE o_orderkey % 4 <> 0 OR o_orderkey % 8 = 0),
v3 AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 12 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM o WHERE o_orderkey % 4 <> 0 OR o_orderkey % 8 = 0 OR o_orderkey % 12 = 0),
v4 AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 20 = 0 AND o_orderstatus <> 'U' THEN 'M' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM v3
  UNION ALL SELECT o_orderkey, NULL, CASE WHEN o_orderkey % 20 = 0 THEN 'M' END, NULL FROM o WHERE o_orderkey % 10 = 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM v3)),
v5 AS (SELECT * FROM v4 WHERE o_orderkey % 9 <> 0)
"""


@_query(_ORDERS + "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice::DOUBLE AS o_totalprice FROM v5", silver=False)
def transactional_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_orders(spark, sf_dir).table("orders").withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@_query(_ORDERS + """SELECT CASE WHEN a.o_orderkey IS NULL THEN 'insert' WHEN b.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS change, coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
a.o_orderstatus AS status_before, b.o_orderstatus AS status_after FROM v2 a FULL JOIN v5 b ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""", silver=False)
def table_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that differ between the table after its append and its newest version."""
    changes = _stored_orders(spark, sf_dir).changes("orders", 2, keys=["o_orderkey"])
    return changes.select("change", "o_orderkey", F.col("before.o_orderstatus").alias("status_before"), F.col("after.o_orderstatus").alias("status_after"))


#: Days of the runs whose snapshots are stored; the first is more than 24 months before the last.
_RUNS = [dt.date(1997, 3, 31), dt.date(1998, 6, 30), dt.date(1999, 3, 31), dt.date(1999, 9, 30)]


def _stored_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot for each run: each node's newest quarter up to then, of each fund and of the portfolio."""
    catalog = _catalog(spark)
    nodes = S.classifications(spark, sf_dir).select(F.col("company_id").alias("raw_id"), "node_id", (F.col("percent") / 100).alias("confidence"))
    rows = S.scaled(spark, sf_dir).drop("company_id").join(nodes, "raw_id")
    for day in _RUNS:
        rolled = E.rollup(rows.filter(F.col("as_of_date") <= F.lit(day)), "scaled", {"sector": "node_id"}, "confidence")
        E.store_snapshot(catalog, "snapshots", E.keep_last(rolled, ["fund", "taxonomy_type", "node_id"], "as_of_date"), f"run-{day}", day)
    return catalog.table("snapshots")


_SNAPSHOTS = """, days AS (SELECT unnest([""" + ", ".join(f"DATE '{d}'" for d in _RUNS) + """]) AS snapshot_date),
x AS (SELECT fund_id::VARCHAR AS fund, as_of_date, node_id, scaled FROM scaled JOIN classifications c ON raw_id = c.company_id),
y AS (SELECT fund, as_of_date, node_id, scaled FROM x UNION ALL SELECT '', as_of_date, node_id, scaled FROM x),
z AS (SELECT snapshot_date, fund, as_of_date, node_id, sum(scaled) AS total FROM y JOIN days ON as_of_date <= snapshot_date GROUP BY ALL),
snapshots AS (SELECT snapshot_date, fund, node_id, total, snapshot_date = (SELECT max(snapshot_date) FROM days) AS is_latest FROM (
  SELECT *, row_number() OVER (PARTITION BY snapshot_date, fund, node_id ORDER BY as_of_date DESC) AS i FROM z)
  WHERE i = 1 AND snapshot_date >= (SELECT max(snapshot_date) FROM days) - INTERVAL 24 MONTH)
"""


@_query(_SNAPSHOTS + """SELECT strftime(snapshot_date, '%Y-%m-%d') AS day, is_latest, fund = '' AS portfolio, count(*) AS n, count(DISTINCT node_id) AS nodes, sum(total)::DOUBLE AS total FROM snapshots GROUP BY ALL""")
def stored_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stored_snapshots(spark, sf_dir).groupBy(F.date_format("snapshot_date", "yyyy-MM-dd").alias("day"), "is_latest", (F.col("fund") == "").alias("portfolio"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("nodes"), F.sum("total").cast("double").alias("total"))


@_query(_SNAPSHOTS + """, v AS (SELECT snapshot_date AS d, node_id AS name, sum(total) AS v FROM snapshots WHERE fund = '7' AND node_id <> '""" + S.UNKNOWN_NODE + """' GROUP BY 1, 2),
t AS (SELECT d, sum(v)::DOUBLE AS t FROM v GROUP BY 1), s AS (SELECT d, name, round(v::DOUBLE * 100 / t, 10) AS s FROM v JOIN t USING (d)),
r AS (SELECT name, row_number() OVER (ORDER BY round(sum(s) / (SELECT count(*) FROM t), 8) DESC, name) AS r FROM s GROUP BY 1),
labelled AS (SELECT d, CASE WHEN r <= 3 THEN name ELSE 'Other' END AS name, s FROM s JOIN r USING (name))
SELECT strftime(d, '%Y-%m-%d') AS day, name, round(coalesce(sum(s), 0), 4) AS pct FROM (SELECT d, name FROM t CROSS JOIN (SELECT DISTINCT name FROM labelled)) LEFT JOIN labelled USING (d, name) GROUP BY d, name""")
def fund_trend_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fund's shares by node in the stored snapshots; unknown nodes have no name."""
    nodes = S.classifications(spark, sf_dir).filter(F.col("node_id") != S.UNKNOWN_NODE).select("node_id", F.col("node_id").alias("name")).distinct()
    trend = E.stored_trend(_stored_snapshots(spark, sf_dir), nodes, "7", n=3)
    return trend.select(F.date_format("snapshot_date", "yyyy-MM-dd").alias("day"), "name", "pct")


@_query(f""", q AS (SELECT company_id, md5('q|' || company_id) AS item, reported_sector AS ai_sector FROM dim_company WHERE company_id % 4 = 0),
ap AS (SELECT company_id, item, CASE WHEN company_id % 8 = 0 THEN 'Manual' ELSE ai_sector END AS sector, company_id % 8 = 0 AS manual FROM q WHERE company_id % 16 <> 4),
changed AS (SELECT c.company_id, primary_sector, sector FROM dim_company c JOIN ap USING (company_id) WHERE primary_sector IS DISTINCT FROM sector)
SELECT 'ai_classification' AS action, 'company' AS entity_type, company_id::VARCHAR AS entity_id, 'model-1' AS actor, node_id AS detail FROM classifications
UNION ALL SELECT 'review_queue_insert', 'review_queue_item', item, 'review_queue_generator', 'low_confidence' FROM q
UNION ALL SELECT 'entity_resolution', 'holding', raw_id::VARCHAR, 'entity_resolver', CASE WHEN max(company_id) IS NULL THEN 'unresolved' ELSE 'direct' END FROM holdings GROUP BY raw_id
UNION ALL SELECT 'pipeline_run_complete', 'pipeline', 'run-1', 'run_pipeline', count(*)::VARCHAR FROM holdings
UNION ALL SELECT 'review_queue_approve', 'company', company_id::VARCHAR, 'reviewer', CASE WHEN manual THEN 'true' ELSE 'false' END FROM ap
UNION ALL SELECT 'row_update', 'company', company_id::VARCHAR, 'catalog', sector FROM changed""")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored log of a run, told twice, of reviewers' approvals, and of the changes that these made to the companies."""
    catalog, company = _catalog(spark), S.dim_company(spark, sf_dir)
    key, holdings = F.col("company_id"), S.holdings(spark, sf_dir)
    classified = S.classifications(spark, sf_dir).select("company_id", "node_id", key.cast("string").alias("classification_id"), F.lit("model-1").alias("model"), F.lit("sector").alias("taxonomy_type"), F.lit(0.5).alias("confidence"), F.lit("").alias("rationale"))
    no_text = F.lit(None).cast("string")
    queue = company.filter(key % 4 == 0).select(F.md5(F.concat(F.lit("q|"), key.cast("string"))).alias("queue_item_id"), "company_id", F.lit("low_confidence").alias("reason"), F.lit("low").alias("priority"), F.col("reported_sector").alias("ai_sector"), no_text.alias("ai_industry"), no_text.alias("ai_country"))
    resolution = holdings.groupBy("raw_id").agg(F.max("company_id").alias("company_id")).select(F.col("raw_id").alias("id"), F.when(F.col("company_id").isNull(), "unresolved").otherwise("direct").alias("method"), F.lit(1.0).alias("confidence"), "company_id")
    decisions = queue.select("queue_item_id", F.when(key % 16 == 4, "rejected").otherwise("approved").alias("status"), F.when(key % 8 == 0, "Manual").otherwise("").alias("manual_sector"), no_text.alias("manual_industry"), no_text.alias("manual_country"), F.lit("reviewer").alias("resolved_by"))
    for _ in range(2):
        catalog.append_new("audit", G.audit_trail("run-1", classified, queue, resolution, holdings), ["audit_event_id"])
    catalog.replace("companies", company.select("company_id", "primary_sector"))
    approved = G.approvals(queue, decisions, company)
    catalog.merge("companies", approved.select("company_id", F.col("sector").alias("primary_sector")), ["company_id"])
    catalog.append_new("audit", G.approval_events("review-1", approved), ["audit_event_id"])
    catalog.append_new("audit", G.change_events("review-1", "company", catalog.changes("companies", 1, keys=["company_id"]), "company_id"), ["audit_event_id"])
    fields = ("node_name", "reason", "match_method", "exposure_count", "manual_override", "after.primary_sector")
    detail = F.coalesce(*[F.get_json_object("payload", f"$.{f}") for f in fields])
    return catalog.table("audit").select("action", "entity_type", "entity_id", "actor", detail.alias("detail"))
