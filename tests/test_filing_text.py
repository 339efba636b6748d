"""Filing texts, provider answers, lists and loads, by hand."""

import pytest
from pyspark.sql import functions as F

from prismfold.functions import filing_text as X
from prismfold.functions import values as V
from prismfold.operators import lists as L
from prismfold.plans import classification as C
from prismfold.plans import merging as M
from prismfold.sources import filings
from prismfold.sources.catalog import Catalog


def told(spark, values, *columns):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_numbers_with_brackets_are_negative(spark):
    cells = ["$(1,234)", "$ (5.0)", "(12)%", "(7)", "1,000", "—", "-", "", None, "x", "(", "-3"]
    got = [r[0] for r in told(spark, cells, V.clean_number(F.col("x")))]
    assert got == [-1234.0, -5.0, -12.0, -7.0, 1000.0, None, None, None, None, None, None, -3.0]


def test_dates_and_names(spark):
    assert [r[0] for r in told(spark, ["1/2/2024", "12/2024", " 3/4/2020 ", "2024", "1/2/24", None], X.is_date_like(F.col("x")))] == [True, True, True, False, False, None]
    texts = ["as of June 30, 2021 and December 31, 2024", "March 31 2022", "none", "December 31, 2019", None]
    assert [r[0] for r in told(spark, texts, X.schedule_date(F.col("x")))] == ["2024-12-31", "2022-03-31", None, None, None]
    names = ["by ACME CORP. and MAIN ROAD CAPITAL PARTNERS now", "nothing here"]
    assert [r[0] for r in told(spark, names, X.fund_name(F.col("x"), F.lit("OBDC_10K_2024.html")))] == ["MAIN ROAD CAPITAL PARTNERS", "OBDC Capital"]
    assert told(spark, ["x"], X.report_date(F.col("x"), F.lit("a_2025.html")), X.report_date(F.lit("fiscal year ended June 2023"), F.col("x")), X.report_date(F.col("x"), F.col("x")))[0] == ("2024-12-31", "2023-12-31", None)
    dates = ["2024-01-05", "1/5/2024", "January 5, 2024", "soon", None]
    assert [r[0] for r in told(spark, dates, X.iso_date(F.col("x")))] == ["2024-01-05"] * 3 + ["soon", None]


def test_net_assets_and_answers(spark):
    rows = [["Total net assets", "$", "14,318", "9,000"], ["Total liabilities and net assets", "500"], ["Total stockholders’ equity", "(200)", "50", "101"], ["Cash", "900"], []]
    df = spark.createDataFrame([(r,) for r in rows], "c array<string>")
    assert [r[0] for r in df.select(X.net_assets(F.col("c"))).collect()] == [14318.0, None, 101.0, None, None]
    answers = ['```json\n{"a": 1}\n```', '{"a": 2}', "```\n{}\n```", "no", None]
    assert [r[0] for r in told(spark, answers, X.json_answer(F.col("x"), "a int")["a"])] == [1, 2, None, None, None]


def test_denomination_counts_each_unit_by_its_own_patterns(spark):
    texts = ["( $ in millions ) (in thousands)", "($ in millions) amounts in millions (in thousands)", "(in thousands) ( $ in thousands )", "", "(in thousands) (in millions)"]
    assert [r[0] for r in told(spark, texts, filings.denomination(F.col("x")))] == [1_000, 1_000_000, 1_000, 1_000_000, 1_000_000]


def test_investment_type_is_no_date_or_rate(spark):
    cells = [["Portfolio Company", "Investment", "Fair Value", "x"], ["Acme Corp (3)", "First lien senior secured", "SOFR + 5.25%", "06/2027", "1,000", "990", "985"], ["Beta LLC", "Notes", "7.5 %", "1/2/2030", "10", "20", "30"], ["Gamma Inc", "Class A units", "50", "12312024"], ["", "", "", ""]]
    rows = spark.createDataFrame([("p", 0, i, c) for i, c in enumerate(cells)], "id string, table int, row int, cells array<string>")
    got = {r.company: (r.investment_type, r.principal, r.cost, r.fair_value) for r in filings.schedule_holdings(rows, "id", 1).collect()}
    assert got["Acme Corp"] == ("First lien senior secured", 1000.0, 990.0, 985.0) and got["Beta LLC"][0] == "Notes" and got["Gamma Inc"] == ("Class A units", None, None, 50.0)


def test_lists(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, "a", 7)], "id int, k string, v int")
    assert [r.id for r in L.filter_rows(df, {"k": "a", "id": None}, {"v": True}).collect()] == [3]
    assert [r.id for r in L.filter_rows(df, {}, {"v": False, "k": None}).orderBy("id").collect()] == [1, 2, 3]
    assert [r.id for r in df.orderBy(*L.sort_keys({"v": "v", "id": "id"}, "oops", "v", False, "id")).collect()] == [2, 3, 1]
    assert {(r.key, r.n) for r in L.counts_of(df, "k", ["a", "z"]).collect()} == {("a", 2), ("z", 0)}
    assert [r.id for r in L.delete_where(df, F.col("v") > 6).orderBy("id").collect()] == [1, 2]
    assert [r.id for r in L.bootstrap(df.select("k", "id", "v"), df.filter("id = 2").select("k"), [F.col("id")], ["id", "k", "v"], ["k"]).collect()] == [1]
    path = str(tmp_path / "t.csv")
    assert L.read_csv(spark, path, missing="none") is None and L.read_csv(spark, path, "a int", "empty").count() == 0
    with pytest.raises(FileNotFoundError):
        L.read_csv(spark, path)
    df.coalesce(1).write.option("header", "true").csv(path)
    assert L.read_csv(spark, path).agg(F.sum("v")).first()[0] == 12
    assert L.query(spark, "SELECT id FROM {t} WHERE v > :n", {"t": df}, n=5).first()[0] == 3


def test_catalog_versions_and_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, k string")
    for kind in ("parquet", "json"):
        catalog = Catalog(spark, str(tmp_path / kind), kind)
        assert not catalog.exists("t")
        catalog.replace("t", df)
        held = catalog.table("t")
        catalog.append("t", df.select("id"))
        assert held.count() == 2 and catalog.table("t").count() == 4
        assert len([p for p in (tmp_path / kind / "t" / "log").iterdir() if p.suffix == ".json"]) == 2


def test_stubs_and_reviews(spark):
    companies = spark.createDataFrame([("1", "Acme", None, "base")], "company_id string, company_name string, primary_sector string, source string")
    filed = spark.createDataFrame([("ACME", "Energy"), ("New Co", None), ("NEW CO", "Tech"), (None, "x")], "raw_company_name string, reported_sector string")
    got = {(r.company_name, r.primary_sector, r.source) for r in M.merge_sources(companies, filed, "bdc").collect()}
    assert got == {("Acme", "Energy", "base"), ("NEW CO", "Tech", "bdc")}
    assert M.merge_sources(companies, filed.limit(0), "bdc").count() == 1


def test_folders_are_paired_by_words(spark):
    folders = spark.createDataFrame([("Acme Growth Fund",), ("zzz",)], "folder string")
    funds = spark.createDataFrame([(1, "acme growth fund"), (2, "Acme Fund"), (3, "Other")], "fund_id long, fund_name string")
    out = C.match_folders(folders, funds)
    assert [(r.folder, r.fund_id) for r in out.collect()] == [("Acme Growth Fund", 1)]
    assert "CartesianProduct" not in out._jdf.queryExecution().toString() and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
