import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from prismfold.plans.classification import classify_companies, classify_countries, map_sectors, match_folders, write_back
from prismfold.sources.catalog import use_checkpoints
from prismfold.sources.exports import EXPORT_COLUMNS, NO_VALUE, export_rows, holdings_csv, summary_frames, summary_metrics, with_resolution
from prismfold.sources.synthetic import synthetic_holdings


def provider():
    """A fake, made here so that it is sent to the workers by value."""
    known = {"Acme": ("Tech", 0.9), "Zed": ("Tech", 0.5), "Odd": ("Nowhere", 0.9)}

    def answer(names, allowed):
        return [("Software", 1.5) if "Software" in a else known.get(n, (None, 0.0)) for n, a in zip(names, allowed)]

    return answer


def test_two_steps_with_rules(spark):
    use_checkpoints(spark)
    companies = spark.createDataFrame([(1, "Acme"), (2, "Zed"), (3, "Odd"), (4, "Bitcoin Trust"), (5, "Done")], "company_id long, company_name string")
    taxonomy = spark.createDataFrame([("Tech", "Software"), ("Energy", "Oil")], "sector string, industry string")
    done = spark.createDataFrame([(5,)], "company_id long")
    got = {(r.company_id, r.taxonomy_type): (r.node_id, r.confidence) for r in classify_companies(companies, done, taxonomy, provider(), "?").collect()}
    assert got == {
        (1, "sector"): ("Tech", 0.9), (1, "industry"): ("Software", 1.0), (2, "sector"): ("Tech", 0.5), (3, "sector"): ("?", 0.0),
        (4, "sector"): ("Financials", 1.0), (4, "industry"): ("Capital Markets", 1.0),
    }


def test_countries(spark):
    rows = [(1, "A", "13f_filing", None), (2, "B", "bdc_filing", None), (3, "C warrant", "bdc_filing", None), (4, "D", "bdc_filing", "X"), (5, "E", "bdc_filing", None)]
    companies = spark.createDataFrame(rows, "company_id long, company_name string, source string, primary_country string")
    codes = spark.createDataFrame([(2, "DE"), (5, "de")], "company_id long, code string")
    assert {r.company_id: r.country for r in classify_countries(companies, codes).collect()} == {1: "US", 2: "DE", 5: None}


def test_sector_mapping_and_write_back(spark):
    holdings = spark.createDataFrame([(1, " Software ", 1), (1, "OIL", 2), (2, "Other", 1), (3, "oil", 1)], "company_id long, reported_sector string, ordinal int")
    answers = spark.createDataFrame([("Software", "45", 0.8), ("OIL", "99", 0.9)], "reported_sector string, code string, confidence double")
    nodes = spark.createDataFrame([("45",)], "code string")
    mapped = map_sectors(holdings, spark.createDataFrame([("oil",)], "reported_sector string"), answers, nodes)
    assert {r.reported_sector: (r.code, r.confidence) for r in mapped.collect()} == {"Software": ("45", 0.8), "OIL": (None, 0.0), "Other": (None, 0.0)}
    companies = spark.createDataFrame([(1, "bdc_filing", "Old"), (2, "bdc_filing", "Old"), (3, "13f_filing", None)], "company_id long, source string, primary_sector string")
    back = write_back(companies, holdings, spark.createDataFrame([("Oil", "Energy")], "reported_sector string, sector string"))
    assert {r.company_id: r.primary_sector for r in back.collect()} == {1: "Energy", 2: "Old", 3: None}


def test_folders(spark):
    folders = spark.createDataFrame([("Alpha_Fund-II",), ("Beta Growth",), ("zzz",)], "folder string")
    funds = spark.createDataFrame([(1, "Alpha Fund II"), (2, "Beta Growth Partners"), (3, "Alpha Fund")], "fund_id long, fund_name string")
    got = {r.folder: (r.fund_id, round(r.score, 3)) for r in match_folders(folders, funds).collect()}
    assert got == {"Alpha_Fund-II": (1, 1.0), "Beta Growth": (2, 0.833)}


def test_exports_and_synthetic_data(spark, tmp_path):
    a = synthetic_holdings(spark)
    assert a.count() == 8 * 8 * 40 and sorted(map(str, a.collect())) == sorted(map(str, synthetic_holdings(spark).repartition(7).collect()))
    assert 0.02 < a.filter("company_id is null").count() / a.count() < 0.09
    frames = summary_frames(a.withColumn("sector", F.lit(None).cast("string")).withColumn("value", F.lit(None).cast("double")))
    assert {r.total for r in frames["By fund"].collect()} == {"N/A"}
    holdings_csv(a.limit(3), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3


def test_export_rows_shares_nulls_and_resolution_log(spark, tmp_path):
    schema = "holding_id string, fund_id int, fund_name string, company_name string, sector string, industry string, country string, value decimal(18,2), as_of_date date, source string, extraction_confidence double"
    day, none = dt.date(2024, 3, 31), [None] * 4
    rows = [("a", 1, "F", "A", "S", "I", "C", 30, day, "x", 0.9), ("b", 1, "F", *none, 10, day, "x", None), ("c", 1, "F", *none, None, day, "x", None), ("d", 2, None, *none, 0, None, None, None)]
    log = spark.createDataFrame([("a", "direct", 0.95), ("b", "unresolved", None)], "holding_id string, match_method string, match_confidence double")
    held = spark.createDataFrame([(*r[:7], None if r[7] is None else Decimal(r[7]), *r[8:]) for r in rows], schema)
    out = export_rows(with_resolution(held, log))
    assert out.columns == list(EXPORT_COLUMNS)
    got = sorted(tuple(r) for r in out.select("Fund", "Company Name", F.coalesce("Reported Value (USD)", F.lit(-1.0)), F.coalesce("% of Fund", F.lit(-1.0)), "As of Date", "Match Method").collect())
    assert got == [("", "", 0.0, -1.0, "", ""), ("F", "", -1.0, -1.0, "2024-03-31", ""), ("F", "", 10.0, 25.0, "2024-03-31", "unresolved"), ("F", "A", 30.0, 75.0, "2024-03-31", "direct")]
    assert [tuple(r) for r in summary_metrics(held, dt.date(2024, 5, 1)).collect()] == [("Total Holdings", "4"), ("Total AUM (USD)", "40.00"), ("Export Date", "2024-05-01")]
    assert summary_metrics(held.limit(0), day).collect()[1].value == NO_VALUE and export_rows(with_resolution(held.limit(0), log)).count() == 0
    holdings_csv(out, str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sum(x == ",".join(EXPORT_COLUMNS) for x in lines) >= 1 and ",F,,,,,,2024-03-31,x,,," in lines
