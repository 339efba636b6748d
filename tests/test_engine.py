"""Hand-computed cases of the operators and plans."""

import datetime as dt

from pyspark.sql import functions as F

from prismfold.operators import frames as O
from prismfold.operators import tables as T
from prismfold.plans import exposure as E
from prismfold.plans import governance as G
from prismfold.plans.resolution import consolidate, resolve_names
from prismfold.plans.silver import UNKNOWN_NODE

Q = dt.date(2024, 12, 31)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def exposures(spark, scale=True):
    reports = spark.createDataFrame([("F1", Q, 0.8), ("F2", Q, 1.0)], "fund_id string, as_of_date date, coverage double")
    data = [("F1", Q, "H1", "a", 60.0, None), ("F1", Q, "H2", "b", 20.0, None), ("F1", Q, "H3", None, None, 0.10), ("F1", Q, "H4", "d", None, None), ("F2", Q, "H5", "e", 5.0, None)]
    holdings = spark.createDataFrame(data, "fund_id string, as_of_date date, holding_id string, company_id string, value double, pct double").withColumn("value", F.col("value").cast("decimal(18,2)"))
    return {r.holding_id: r.exposure for r in E.infer_exposures(reports, holdings, scale_to_nav=scale).collect()}


def test_exposure_inference(spark):
    got = exposures(spark)
    want = {"H1": 33_333_333.33, "H2": 11_111_111.11, "H3": 5_555_555.56, "H4": 0, None: 10_000_000, "H5": 50_000_000}
    assert {k: round(v, 2) for k, v in got.items()} == want
    assert round(sum(got.values())) == 110_000_000
    unscaled = exposures(spark, scale=False)
    assert [round(unscaled[k]) for k in ("H1", "H2", "H3")] == [30_000_000, 10_000_000, 5_000_000]


def test_report_without_holdings_takes_its_slot(spark):
    reports = spark.createDataFrame([("F1", Q, 0.5), ("F2", Q, 1.0)], "fund_id string, as_of_date date, coverage double")
    holdings = spark.createDataFrame([("F2", Q, "H", "c", 5.0, None)], "fund_id string, as_of_date date, holding_id string, company_id string, value double, pct double")
    got = {r.fund_id: r.exposure for r in E.infer_exposures(reports, holdings).collect()}
    assert got == {"F1": 25_000_000, "F2": 50_000_000}


def test_interpolation(spark):
    line = lambda n: [spark.range(1).select(E.interpolate(F.lit(i), F.lit(n), 62.0, 69.0)).first()[0] for i in range(n)]
    assert line(1) == [62]
    assert line(3) == [62, 65.5, 69]
    assert line(10) == [62, 63, 64, 65, 66, 67, 68, 69, 69, 69]


def test_investor_scaling(spark):
    days = [dt.date(2024, 3, 31), dt.date(2024, 6, 30), dt.date(2024, 9, 30)]
    own = [("C", "Conf", "bdc_filing", d, f"{i}-{v}", v) for i, d in enumerate(days) for v in (30.0, 70.0)]
    pdf = [("P", "Pdf", "pdf_document", days[0], "p1", 50.0), ("P", "Pdf", "pdf_document", days[1], "p2", 50.0)]
    holdings = spark.createDataFrame(own + pdf, "fund_id string, fund_name string, source string, as_of_date date, holding_id string, value double")
    reports = spark.createDataFrame([("P", days[0], 10.0, 200.0), ("P", days[1], 0.0, 200.0)], "fund_id string, as_of_date date, nav double, net_assets double")
    got = {r.holding_id: (r.holding_pct, r.scaled) for r in E.scale_to_investor(holdings, reports, {"Conf": (62.0, 69.0)}).collect()}
    assert got["1-30.0"] == (0.3, 19.65) and round(got["1-70.0"][1], 2) == 45.85
    assert got["p1"] == (0.25, 2.5) and "p2" not in got


def test_coverage(spark):
    df = spark.createDataFrame([("g", "a", 60), ("g", "b", 20), ("g", "?", 20), ("z", "a", 0), ("u", "?", 5)], "k string, node string, v int")
    got = rows(O.coverage(df, "v", F.col("node") != "?", ["k"]).select("k", "coverage_pct").distinct(), "k")
    assert got == [("g", 0.8), ("u", 0.0), ("z", 0.0)]


def test_keep_last_mixes_dates(spark):
    df = spark.createDataFrame([("X", "Q3", 10), ("X", "Q4", 12), ("Y", "Q3", 7)], "node string, d string, v int")
    assert rows(E.keep_last(df, ["node"], "d"), "node") == [("X", "Q4", 12), ("Y", "Q3", 7)]


def test_per_fund_latest(spark):
    df = spark.createDataFrame([("F1", "Q3", 100), ("F1", "Q4", 110), ("F2", "Q3", 50)], "f string, d string, v int")
    assert O.with_latest(df, "f", "d").agg(F.sum("v")).first()[0] == 160


def test_top_n_other(spark):
    df = spark.createDataFrame([(f"s{i:02}", 12 - i) for i in range(12)] + [("Unclassified", 22)], "name string, v int")
    got = {r.name: (r.v, r.pct) for r in O.top_n_other(df, "name", "v", 10, "Unclassified").collect()}
    assert len(got) == 11 and got["Other"] == (3, 3.0) and got["s00"] == (12, 12.0)


def test_pages(spark):
    assert (O.page_count(0, 50), O.page_count(101, 50)) == (1, 3)
    df = spark.range(101)
    pages = [[r.id for r in O.page(df, [F.col("id")], p, 50).collect()] for p in (1, 2, 3)]
    assert sum(pages, []) == list(range(101))


def test_upsert_and_merge(spark):
    old = spark.createDataFrame([(1, 1, 2)], "k int, a int, b int")
    new = spark.createDataFrame([(1, 9)], "k int, a int")
    assert rows(T.upsert(old, new, ["k"])) == [(1, 9, None)]
    assert rows(T.merge_nonnull(old, new, ["k"])) == [(1, 9, 2)]
    kept = spark.createDataFrame([(1, "bdc_filing")], "k int, source string")
    assert rows(T.merge_nonnull(kept, kept.withColumn("source", F.lit("pdf")), ["k"], {"source": ["bdc_filing"]})) == [(1, "bdc_filing")]


def test_retention_clamps_month_ends(spark):
    df = spark.createDataFrame([(dt.date(2022, 2, 28),), (dt.date(2022, 2, 27),)], "d date")
    assert T.retain(df, "d", F.lit("2024-02-29").cast("date")).count() == 1


def test_resolution_cascade(spark):
    companies = spark.createDataFrame([(1, "Acme Robotics Inc"), (2, "Nova Health Systems East")], "company_id long, company_name string")
    aliases = spark.createDataFrame([(1, "ACR")], "company_id long, alias string")
    raw = [" acme robotics inc ", "acr", "Acme Robotics, LLC", "Nova Health Systems", "Acme Robotics LLC and Zeta Partners Fund Two", "Unrelated", None, "NaN"]
    df = spark.createDataFrame(list(enumerate(raw)), "id int, name string")
    got = rows(resolve_names(df, companies, aliases).select("id", "method", "confidence", "company_id"), "id")
    assert got == [
        (0, "direct", 1.0, 1),
        (1, "alias", 0.95, 1),
        (2, "normalized", 0.90, 1),
        (3, "token_overlap", 0.80, 2),
        (4, "first_entity", 0.75, 1),
        (5, "unresolved", 0.0, None),
        (6, "unresolved", 0.0, None),
        (7, "unresolved", 0.0, None),
    ]


def test_greedy_stars_are_not_components(spark):
    words = [f"w{i}" for i in range(24)]
    names = [" ".join(words[:21]), " ".join(words[1:22]), " ".join(words[2:23]), "Alpha Beta Inc", "Alpha Beta and (x)"]
    companies = spark.createDataFrame(list(enumerate(names)), "company_id long, company_name string")
    got = dict(rows(consolidate(companies), "company_id"))
    assert got[0] == got[1] == 0 and 2 not in got
    assert got[3] == got[4] == 3


def test_review_rules(spark):
    c = [(1, "n", 0.29), (2, "n", 0.30), (3, "n", 0.70), (4, UNKNOWN_NODE, 0.0), (5, UNKNOWN_NODE, 0.0)]
    classified = spark.createDataFrame(c, "company_id long, node_id string, confidence double")
    companies = spark.createDataFrame([(i, "Tech" if i == 5 else None) for i in range(1, 9)], "company_id long, primary_sector string")
    e = [("a", None, 1_000_000.0, "unknown"), ("b", None, 1_000_001.0, "unknown"), ("c", 6, 500_000.0, "reported"), ("d", 7, 500_001.0, "reported")]
    exposures_ = spark.createDataFrame(e, "exposure_id string, company_id long, exposure double, exposure_type string")
    log = spark.createDataFrame([("h", "unresolved"), ("i", "direct")], "id string, method string")
    got = {(r.reason, r.subject): r.priority for r in G.review_queue(classified, log, exposures_, companies, UNKNOWN_NODE).collect()}
    assert got == {
        ("low_confidence", "1"): "high",
        ("low_confidence", "2"): "medium",
        ("unclassifiable_company", "4"): "high",
        ("unresolved_entity", "h"): "high",
        ("large_unknown_exposure", "b"): "medium",
        ("large_unclassified_company", "7"): "medium",
    }


def test_audit_events_are_appended_once(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    events = G.audit_events("classified", "company", df, "k", F.lit("rule"), ["k", "v"])
    assert [r.payload for r in events.orderBy("entity_id").collect()] == ['{"k":1,"v":null}', '{"k":2,"v":"x"}']
    log = G.append_unseen(events.limit(0), events)
    assert G.append_unseen(log, events).count() == 2


def test_forward_fill_and_dedupe(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "b"), (2, 1, None)], "g int, o int, v string")
    assert rows(O.forward_fill(df, "v", ["g"], "o"), "g", "o") == [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, None)]
    assert rows(O.dedupe(df, ["g"], [F.desc("o")]).select("g", "o"), "g") == [(1, 3), (2, 1)]


def test_every_stage_of_resolution_fires(spark, sf_dir):
    from prismfold.plans.matching import resolution_stages

    found = {r.method: r["count"] for r in resolution_stages(spark, sf_dir).groupBy("method").count().collect()}
    assert set(found) == {"direct", "alias", "normalized", "token_overlap", "first_entity", "unresolved"} and min(found.values()) > 10
