import json

from pyspark.sql import functions as F

from prismfold.sources.catalog import Catalog
from prismfold.sources.filings import denomination, document_type, filing_list, filings_by_filer, info_table_holdings, new_files, read_info_tables, schedule_holdings, table_rows
from prismfold.streaming.feeds import ingest, windowed_counts

XML = """<?xml version="1.0"?><ns1:informationTable xmlns:ns1="http://x"><ns1:infoTable><ns1:nameOfIssuer>ACME</ns1:nameOfIssuer>
<ns1:titleOfClass>COM</ns1:titleOfClass><ns1:cusip>00123</ns1:cusip><ns1:value>1,500</ns1:value></ns1:infoTable>
<ns1:infoTable><ns1:nameOfIssuer>ZED</ns1:nameOfIssuer><ns1:cusip>9</ns1:cusip><ns1:value>x</ns1:value></ns1:infoTable></ns1:informationTable>"""


def test_info_table_keeps_zeros_and_prefixes(spark, tmp_path):
    (tmp_path / "t.xml").write_text(XML)
    got = [tuple(r) for r in read_info_tables(spark, str(tmp_path / "t.xml")).orderBy("cusip").collect()]
    assert got == [("ACME", "00123", 1500.0, "United States"), ("ZED", "9", 0.0, "United States")]


def test_filing_list_takes_the_exact_form(spark):
    body = '{"filings":{"recent":{"accessionNumber":["1","2","3"],"form":["13F-HR","13F-HR/A","13F-HR"],"filingDate":["a","b","c"],"reportDate":["2024-01-01","2024-02-01","2024-03-01"],"primaryDocument":["x","y","z"]}}}'
    df = spark.createDataFrame([(body,)], "body string")
    assert [r.accessionNumber for r in filing_list(df, "body").collect()] == ["3", "1"]


def listing(rows, files=()):
    names = ["accessionNumber", "form", "filingDate", "reportDate", "primaryDocument"]
    return json.dumps({"filings": {"recent": {n: [r[i] for r in rows] for i, n in enumerate(names)}, "files": [{"name": f} for f in files]}})


def test_history_pages_are_followed_while_filings_are_few(spark):
    row = lambda acc, report, form="13F-HR": (acc, form, "2020-01-01", report, "x")
    index = [
        ("one", listing([row("a", "2024-03-31"), row("b", "2024-06-30", "13F-HR/A")], ["p1", "p2", "p3"])),
        ("two", listing([row("c", "2024-03-31"), row("d", "2023-12-31"), row("e", "")], ["p1"])), ("none", "no json"), ("null", None), ("bare", listing([], ["missing"])),
    ]
    pages = [("p1", listing([row("f", "2023-03-31"), row("g", "2023-06-30", "10-K")])), ("p2", listing([row("h", "2025-03-31"), row("i", "2022-03-31")])), ("p3", listing([row("j", "2026-03-31")]))]
    schema = "string, body string"
    got = filings_by_filer(spark.createDataFrame(index, "cik " + schema), spark.createDataFrame(pages, "name " + schema), newest=3)
    # the third page is not read, as two pages gave enough; the second is whole, so its newer filing counts
    assert sorted((r.cik, r.reportDate, r.accessionNumber) for r in got.collect()) == [
        ("one", "2023-03-31", "f"), ("one", "2024-03-31", "a"), ("one", "2025-03-31", "h"), ("two", "2020-01-01", "e"), ("two", "2023-12-31", "d"), ("two", "2024-03-31", "c"),
    ]


def test_info_tables_with_their_filing(spark):
    plain = "<informationTable><infoTable><nameOfIssuer>B</nameOfIssuer><cusip></cusip><value>2</value></infoTable></informationTable>"
    rows = [("r1", "2024-03-31", XML.split("?>")[1]), ("r2", "2024-06-30", plain), ("r3", "2024-06-30", "<broken"), ("r4", None, None)]
    found = info_table_holdings(spark.createDataFrame(rows, "fund_report_id string, period string, body string"), 1000)
    got = sorted((r.fund_report_id, r.row_number, r.raw_company_name, r.cusip, r.reported_value_usd, r.as_of_date, r.extraction_confidence) for r in found.collect())
    assert got == [("r1", 1, "ACME", "00123", 1500000.0, "2024-03-31", 1.0), ("r1", 2, "ZED", "9", 0.0, "2024-03-31", 1.0), ("r2", 1, "B", None, 2000.0, "2024-06-30", 1.0)]
    assert found.select("reported_holding_id").distinct().count() == 3


def test_denomination_votes(spark):
    texts = ["(in thousands) (in thousands) (in millions)", "(in millions) (in thousands)", "none", "amounts in thousands"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.d for r in df.select("i", denomination(F.col("t")).alias("d")).orderBy("i").collect()] == [1000, 1_000_000, 1_000_000, 1000]


def test_document_types(spark):
    files = [("Q3_Transparency.pdf", ""), ("x.pdf", "Capital Account for"), ("10-K.pdf", ""), ("x.pdf", "our holdings and % of NAV"), ("x.pdf", "hello")]
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "i int, n string, t string")
    got = [r.d for r in df.select("i", document_type(F.col("n"), F.col("t")).alias("d")).orderBy("i").collect()]
    assert got == ["transparency_report", "lp_statement", "financial_statements", "transparency_report", None]


def test_new_files_by_hash(spark):
    files = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("c", b"3")], "path string, content binary")
    manifest = files.filter("path = 'a'").select("path", F.md5("content").alias("hash")).union(spark.createDataFrame([("b", "old")], "path string, hash string"))
    assert {r.path: r.status for r in new_files(files, manifest).collect()} == {"b": "changed", "c": "new"}


HTML = """<table><tr><th>Portfolio Company</th><th>Investment</th><th>Principal</th><th>Cost</th><th>Fair Value</th></tr>
<tr><td>Acme Robotics (3)</td></tr><tr><td>First lien loan</td><td>$10</td><td>9.5</td><td>9.0</td></tr>
<tr><td>Common stock</td><td></td><td>2.0</td><td>(3.0)</td></tr><tr><td>First lien loan</td><td>10</td><td>9.5</td><td>9.0</td></tr></table>
<table><tr><th>Portfolio Company</th><th>Investment</th><th>Fair Value</th></tr><tr><td>Warrants</td><td>1</td><td>5.0</td></tr><tr><td>Zed Foods</td></tr><tr><td>Notes</td><td>7</td><td>6</td><td>12</td></tr></table>"""


def test_schedule_state_machine(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None)], "id int, html string")
    found = schedule_holdings(table_rows(pages, "id", "html"), "id", 1000)
    got = sorted((r.company.strip(), r.investment_type, r.fair_value) for r in found.collect())
    # the last holding of Acme is in the next table, as the company is carried on
    assert got == [("Acme Robotics", "Common stock", -3000.0), ("Acme Robotics", "First lien loan", 9000.0), ("Acme Robotics", "Warrants", 5000.0), ("Zed Foods", "Notes", 12000.0)]


def test_catalog_versions(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    catalog.replace("t", first)
    catalog.upsert("t", spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    catalog.append("t", spark.createDataFrame([(4, "e")], "k int, v string"))
    assert {r.k: r.v for r in catalog.table("t").collect()} == {1: "a", 2: "c", 3: "d", 4: "e"}
    assert catalog.table("t", k=3, no_such_column=1).count() == 1
    assert catalog.table("none", first.schema).count() == 0


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "cat"))
    schema = "k int, v string, o int"
    spark.createDataFrame([(1, "a", 1), (1, "b", 2)], schema).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), schema, catalog, "t", ["k"], "o", str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame([(1, "c", 3), (2, "x", 1)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    ingest(spark, str(tmp_path / "in"), schema, catalog, "t", ["k"], "o", str(tmp_path / "ck")).awaitTermination()
    assert {r.k: r.v for r in catalog.table("t").collect()} == {1: "c", 2: "x"}


def test_stream_and_batch_windows_agree(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "ev"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), "ts", "event_type", "value")
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    pick = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert pick(spark.table("windows")) == pick(windowed_counts(events, "ts", "event_type", "value"))
