"""Stored snapshots, idempotent logs and approvals."""

import datetime as dt
import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from prismfold.plans import exposure as E
from prismfold.plans import governance as G
from prismfold.sources.catalog import Catalog


def records(spark, *pairs):
    return spark.createDataFrame([("", n, float(v)) for n, v in pairs], "fund string, node_id string, total double")


def test_snapshots_flip_expire_and_replace_themselves(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    days = [dt.date(2022, 1, 31), dt.date(2022, 2, 28), dt.date(2024, 1, 31), dt.date(2024, 2, 29)]
    for i, day in enumerate(days):
        E.store_snapshot(catalog, "s", records(spark, ("a", i), ("b", 10 + i)), f"run{i}", day)
    told = lambda: sorted((str(r.snapshot_date), r.is_latest, r.node_id, r.total) for r in catalog.table("s").collect())
    # 24 months before 29 February 2024 is 28 February 2022, taken by the calendar: that day stays, January goes
    want = [("2022-02-28", False, "a", 1.0), ("2022-02-28", False, "b", 11.0), ("2024-01-31", False, "a", 2.0), ("2024-01-31", False, "b", 12.0), ("2024-02-29", True, "a", 3.0), ("2024-02-29", True, "b", 13.0)]
    assert told() == want
    E.store_snapshot(catalog, "s", records(spark, ("a", 3), ("b", 13)), "run3", days[3])
    assert told() == want
    before = catalog._state("s").files
    E.store_snapshot(catalog, "s", records(spark, ("a", 9)), "run4", dt.date(2024, 2, 29))
    after = catalog._state("s").files
    kept = {(folder, f) for folder, some in before.items() for f in some if "2022-02-28" in f or "2024-01-31" in f}
    assert kept and kept <= {(folder, f) for folder, some in after.items() for f in some}  # only the latest day's files are new
    assert sum(r[1] for r in told()) == 1


def test_trend_of_stored_snapshots(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    for i, day in enumerate([dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2024, 3, 31)]):
        E.store_snapshot(catalog, "s", records(spark, ("a", 60 + i), ("b", 40 - i), ("unknown", 900)), f"run{i}", day)
    nodes = spark.createDataFrame([("a", "A"), ("b", "B")], "node_id string, name string")
    got = sorted((str(r.snapshot_date), r.name, r.pct) for r in E.stored_trend(catalog.table("s"), nodes, "", periods=2, n=1).collect())
    assert got == [("2024-02-29", "A", 61.0), ("2024-02-29", "Other", 39.0), ("2024-03-31", "A", 62.0), ("2024-03-31", "Other", 38.0)]


def test_a_log_takes_each_event_once_from_many_writers(spark, tmp_path):
    events = spark.range(50).select(F.col("id").cast("string").alias("audit_event_id"), F.lit("x").alias("action"))
    Catalog(spark, str(tmp_path)).append_new("log", events.filter("id < 5"), ["audit_event_id"])
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda n: Catalog(spark, str(tmp_path)).append_new("log", events.filter(F.col("id") % 4 <= n), ["audit_event_id"]), range(4)))
    log = Catalog(spark, str(tmp_path)).table("log")
    assert log.count() == log.distinct().count() == 50


def test_audit_trail_of_a_run(spark):
    classified = spark.createDataFrame([("c1", 7, "m", "sector", "n1", 0.5, "r"), ("c2", None, None, "sector", "n2", None, None)], "classification_id string, company_id long, model string, taxonomy_type string, node_id string, confidence double, rationale string")
    queue = spark.createDataFrame([("q1", "low", "high")], "queue_item_id string, reason string, priority string")
    names = spark.createDataFrame([("h1", "alias", 0.95, 7), ("h2", "unresolved", None, None)], "id string, method string, confidence double, company_id long")
    exposures = spark.range(3)
    events = {(r.action, r.entity_id): r for r in G.audit_trail("r1", classified, queue, names, exposures).collect()}
    assert set(events) == {("ai_classification", "7"), ("ai_classification", "c2"), ("review_queue_insert", "q1"), ("entity_resolution", "h1"), ("entity_resolution", "h2"), ("pipeline_run_complete", "r1")}
    assert events["ai_classification", "c2"].actor == "unknown_model"
    assert json.loads(events["entity_resolution", "h2"].payload) == {"match_method": "unresolved", "match_confidence": None, "matched_company_id": None}
    assert json.loads(events["pipeline_run_complete", "r1"].payload) == {"classification_count": 2, "review_queue_count": 1, "entity_resolution_count": 2, "exposure_count": 3}
    again = {r.audit_event_id for r in G.audit_trail("r1", classified, queue, names, exposures).collect()}
    assert again == {r.audit_event_id for r in events.values()} and len(again) == 6
    assert not again & {r.audit_event_id for r in G.audit_trail("r2", classified, queue, names, exposures).collect()}
    assert "pipeline_run_complete" not in {r.action for r in G.audit_trail("r1", classified, queue, names, exposures.limit(0)).collect()}


def test_approvals_write_values_and_events(spark):
    queue = spark.createDataFrame([("a", 1, "Tech", None, ""), ("b", 2, "Tech", None, None), ("c", 3, "", None, None), ("d", 9, "X", None, None), ("e", None, "X", None, None)], "queue_item_id string, company_id long, ai_sector string, ai_industry string, ai_country string")
    decisions = spark.createDataFrame([("a", "approved", "Health"), ("b", "rejected", None), ("c", "approved", ""), ("d", "approved", None), ("e", "approved", None)], "queue_item_id string, status string, manual_sector string")
    none = F.lit(None).cast("string")
    decisions = decisions.withColumns({"manual_industry": none, "manual_country": F.when(F.col("queue_item_id") == "a", "US"), "resolved_by": F.lit("me@x")})
    companies = spark.createDataFrame([(1,), (2,), (3,)], "company_id long")
    approved = G.approvals(queue, decisions, companies)
    assert [tuple(r) for r in approved.collect()] == [(1, "a", "Health", None, "US", True, "me@x")]
    event = G.approval_events("run", approved).first()
    assert (event.actor_type, event.actor, event.action, event.entity_id) == ("user", "me@x", "review_queue_approve", "1")
    assert json.loads(event.payload) == {"company_id": 1, "sector": "Health", "industry": None, "country": "US", "manual_override": True, "approved_by": "me@x", "queue_item_id": "a"}
