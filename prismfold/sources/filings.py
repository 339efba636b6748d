"""Readers of filings: information tables (XML), filing lists (JSON), schedules of investments (HTML), documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismfold.functions.names import md5_uuid

INFO_TABLE = "nameOfIssuer string, titleOfClass string, cusip string, value string, shrsOrPrnAmt struct<sshPrnamt:string,sshPrnamtType:string>"


def read_info_tables(spark: SparkSession, path: str, multiplier: int = 1) -> DataFrame:
    """issuer, cusip (text, zeros kept), value of each row of 13F information tables, whatever their namespace."""
    rows = spark.read.format("xml").option("rowTag", "infoTable").option("ignoreNamespace", "true").schema(INFO_TABLE).load(path)
    value = F.coalesce(F.regexp_replace("value", ",", "").try_cast("double"), F.lit(0.0)) * multiplier
    return rows.select(F.trim("nameOfIssuer").alias("raw_company_name"), F.trim("cusip").alias("cusip"), value.alias("reported_value_usd"), F.lit("United States").alias("reported_country"))


def filing_list(submissions: DataFrame, column: str, form: str = "13F-HR", newest: int = 8) -> DataFrame:
    """The newest filings of exactly one form out of a list that is given as parallel arrays in JSON."""
    names = ["accessionNumber", "form", "filingDate", "reportDate", "primaryDocument"]
    schema = "filings struct<recent:struct<" + ",".join(f"{n}:array<string>" for n in names) + ">>"
    recent = F.from_json(column, schema)["filings"]["recent"]
    rows = submissions.select(F.inline(F.arrays_zip(*[recent[n].alias(n) for n in names])))
    return rows.filter(F.col("form") == form).orderBy(F.desc("reportDate"), F.desc("accessionNumber")).limit(newest)


LISTED = ["accessionNumber", "form", "filingDate", "reportDate", "primaryDocument"]


def filings_by_filer(indexes: DataFrame, pages: DataFrame, form: str = "13F-HR", newest: int = 8) -> DataFrame:
    """cik and the newest filings of exactly one form of each filer, from stored listings: the index (cik, body) and the history
    pages (name, body) that it names, in its order.

    A page counts if the index and the pages before it list fewer than `newest` such filings; one that is not stored lists none.
    A filing without a report date has its filing date. Bodies that are no JSON list nothing.
    """
    recent = "recent:struct<" + ",".join(f"{n}:array<string>" for n in LISTED) + ">"
    index = indexes.select("cik", F.from_json("body", f"filings struct<{recent},files:array<struct<name:string>>>")["filings"].alias("f"))
    named = index.select("cik", F.posexplode("f.files.name").alias("at", "name")).withColumn("at", F.col("at") + 1)
    paged = named.join(pages.select("name", F.from_json("body", f"filings struct<{recent}>")["filings"]["recent"].alias("r")), "name")
    lists = index.select("cik", F.lit(0).alias("at"), F.col("f.recent").alias("r")).unionByName(paged.select("cik", "at", "r"))
    rows = lists.select("cik", "at", F.filter(F.arrays_zip(*[F.col(f"r.{n}").alias(n) for n in LISTED]), lambda x: x["form"] == form).alias("rows")).filter("rows is not null")
    before = F.sum(F.size("rows")).over(Window.partitionBy("cik").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    counted = rows.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < newest).select("cik", F.inline("rows"))
    dated = counted.withColumn("reportDate", F.when(F.col("reportDate") != "", F.col("reportDate")).otherwise(F.col("filingDate")))
    rank = F.row_number().over(Window.partitionBy("cik").orderBy(F.desc("reportDate"), F.desc("accessionNumber")))
    return dated.withColumn("rank", rank).filter(F.col("rank") <= newest).select("cik", *LISTED)


def info_table_holdings(filings: DataFrame, multiplier: int = 1) -> DataFrame:
    """The holdings of information tables (fund_report_id, period, body: a table's XML), with the fields of their filing.

    Rows are numbered from 1 in the order of the table and take their id from report, CUSIP and number. An empty CUSIP is null;
    a value that is no number is 0; a body that is no XML, or missing, has no rows.
    """
    tables = F.from_xml("body", f"infoTable array<struct<{INFO_TABLE}>>", {"ignoreNamespace": "true"})
    rows = filings.select("fund_report_id", "period", F.posexplode(tables["infoTable"]).alias("at", "h"))
    number, cusip = F.col("at") + 1, F.trim(F.coalesce("h.cusip", F.lit("")))
    value = F.coalesce(F.regexp_replace("h.value", ",", "").try_cast("double"), F.lit(0.0)) * multiplier
    return rows.select(
        md5_uuid(F.concat_ws("_", F.lit("13f"), "fund_report_id", cusip, number.cast("string"))).alias("reported_holding_id"), "fund_report_id", F.trim(F.coalesce("h.nameOfIssuer", F.lit(""))).alias("raw_company_name"),
        F.lit("United States").alias("reported_country"), value.alias("reported_value_usd"), F.nullif(cusip, F.lit("")).alias("cusip"), F.lit("13f_xml").alias("extraction_method"),
        F.lit(1.0).alias("extraction_confidence"), number.alias("row_number"), F.lit("13f_filing").alias("source"), F.col("period").alias("as_of_date"),
    )


# How filings name their denomination.
IN_MILLIONS = [r"\(in\s+millions?\)", r"amounts?\s+in\s+millions", r"dollars?\s+in\s+millions", r"\(\$\s*in\s+millions\)"]
IN_THOUSANDS = [r"\(in\s+thousands?\)", r"amounts?\s+in\s+thousands", r"dollars?\s+in\s+thousands", r"\(\s*\$\s*in\s*thousands\s*\)"]
# Words of a file's name, or of a text's start, that tell what a document is.
DOCUMENT_NAMES = {
    "transparency_report": ["transparency", "holdings_letter"],
    "lp_statement": ["lp_statement", "capital_account", "lp statement"],
    "financial_statements": ["financial_statement", "quarterly_report", "schedule_of_investments", "10-k"],
}
DOCUMENT_STARTS = {
    "financial_statements": ["schedule of investments", "portfolio investments"],
    "lp_statement": ["capital account", "limited partner statement"],
    "transparency_report": ["transparency report"],
}
# Words that show the type of an investment.
INVESTMENT_TYPES = [
    "secured debt", "unsecured debt", "subordinated", "preferred", "common stock", "common equity", "warrants", "member units", "llc interest", "class a", "class b",
    "first lien", "second lien", "senior secured", "senior subordinated", "junior secured", "unitranche", "mezzanine", "limited partnership", "llc equity", "revolving",
]


def denomination(text: Column) -> Column:
    """1 000 or 1 000 000, whichever a filing names more often; a million on ties and without any."""
    low = F.lower(text)
    count = lambda patterns: sum((F.regexp_count(low, F.lit(p)) for p in patterns), F.lit(0))
    return F.when(count(IN_THOUSANDS) > count(IN_MILLIONS), 1_000).otherwise(1_000_000)


def document_type(name: Column, text: Column) -> Column:
    """What a fund document is, by words in its file name, else by words early in its text."""
    start = F.lower(F.substring(text, 1, 3000))
    tables = ((F.lower(name), DOCUMENT_NAMES), (start, DOCUMENT_STARTS))
    first = [F.when(where.rlike("|".join(map(re.escape, words))), kind) for where, table in tables for kind, words in table.items()]
    return F.coalesce(*first, F.when(start.contains("holdings") & start.contains("% of nav"), "transparency_report"))


def new_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, content) whose hash no manifest row (hash) has; `status` says whether the path was known."""
    hashed = files.withColumn("hash", F.md5("content"))
    known = manifest.select(F.col("path"), F.lit(True).alias("known")).distinct()
    fresh = hashed.join(manifest.select("hash"), "hash", "left_anti").join(known, "path", "left")
    return fresh.withColumn("status", F.when(F.col("known"), "changed").otherwise("new")).drop("known", "content")


class _Tables(HTMLParser):
    """Rows of cell texts of the tables of a page, in page order: (table, row, cells)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int, list[str]]] = []
        self.table, self.row, self.cells, self.text = -1, 0, None, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table, self.row = self.table + 1, 0
        elif tag == "tr":
            self._end_row()
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self._end_cell()
            self.text = []

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self._end_cell()
        elif tag in ("tr", "table"):
            self._end_row()

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)

    def _end_cell(self):
        if self.text is not None:
            self.cells.append(" ".join("".join(self.text).split()))
            self.text = None

    def _end_row(self):
        self._end_cell()
        if self.cells:
            self.rows.append((self.table, self.row, self.cells))
            self.row += 1
        self.cells = None


def table_rows(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, table, row, cells of every table row of a page."""
    kind = pages.schema[id_col].dataType.simpleString()

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, html in zip(frame[id_col], frame[html_col]):
                parser = _Tables()
                parser.feed(html or "")
                parser.close()
                parser._end_row()
                out += [(key, *row) for row in parser.rows]
            yield pd.DataFrame(out, columns=[id_col, "table", "row", "cells"])

    return pages.select(id_col, html_col).mapInPandas(parse, f"{id_col} {kind}, table int, row int, cells array<string>")


def schedule_holdings(rows: DataFrame, id_col: str, multiplier: Column | int = 1_000_000, largest: float = 5e9) -> DataFrame:
    """Holdings of schedules of investments: company, investment type, principal, cost and fair value.

    A table counts if its first five rows name a company and a value column and it has more than three rows. A row
    with text in its first cell and no numbers names the company of the rows below, across tables; of a row with
    numbers the last is the fair value, those before it cost and principal. Equal (company, type, fair value to tens)
    count once; values beyond `largest` are share counts and go.
    """
    from prismfold.functions.filing_text import is_date_like
    from prismfold.functions.values import clean_number
    from prismfold.operators.frames import dedupe, forward_fill

    text = F.lower(F.array_join("cells", " "))
    of_table = Window.partitionBy(id_col, "table")
    top = F.concat_ws(" ", F.array_sort(F.collect_list(F.when(F.col("row") < 5, F.struct("row", text.alias("t")))).over(of_table))["t"])
    company = top.contains("portfolio company") | (top.contains("company") & (top.contains("investment") | top.contains("business description") | top.contains("industry")))
    is_schedule = company & (top.contains("fair value") | top.contains("amortized cost")) & (F.count("*").over(of_table) > 3)
    live = rows.withColumn("ok_", is_schedule).filter("ok_").drop("ok_")
    filled = F.filter("cells", lambda c: c != "")
    # a fair value that reads as a day of the 2020s, MMDD20YY, is no amount
    day = lambda v: (v == F.floor(v)) & v.between(1012020, 12312029) & F.format_string("%08d", v.cast("long")).rlike(r"^(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])202[0-9]$")
    numeric = lambda c: c.rlike(r"^[\d,.\-$()%\s—–]+$")
    numbers = F.filter(F.transform(F.filter(filled, numeric), clean_number), lambda v: v.isNotNull() & ((F.abs(v) >= 1) | (v == 0)) & ~day(v))
    numbers = F.slice(numbers, F.greatest(F.lit(1), F.size(numbers) - 3), F.lit(4))  # four at the most, from the right
    words = F.filter(filled, lambda c: ~numeric(c) & (F.length(c) >= 3))
    section = text.rlike("control investments|affiliate investments|non-control/non-affiliate|total investments|total control|total affiliate|subtotal")
    header = text.rlike("fair value|amortized cost")
    shaped = live.withColumns({"numbers": numbers, "words": words}).filter(~section & ~header & (F.size("words") > 0))
    names = F.when(F.size("numbers") == 0, F.col("words")[0]).when(F.size("words") >= 2, F.col("words")[0])
    shaped = shaped.withColumn("company", F.regexp_replace(names, r"\s*\(\d+\)\s*", " ")).withColumn("place", F.struct("table", "row"))
    carried = forward_fill(shaped, "company", [id_col], "place").filter((F.size("numbers") > 0) & F.col("company").isNotNull())
    at = lambda n: F.try_element_at("numbers", F.lit(-n))
    named = F.filter("words", lambda w: F.lower(w).rlike("|".join(INVESTMENT_TYPES)))
    plain = F.filter("words", lambda w: ~is_date_like(w) & ~w.rlike(r"[0-9]\s*%"))
    kind = F.coalesce(F.get(named, 0), F.try_element_at(plain, F.lit(-1)), F.col("words")[0])
    found = carried.select(id_col, "place", F.trim("company").alias("company"), kind.alias("investment_type"), at(3).alias("principal"), at(2).alias("cost"), at(1).alias("fair_value"))
    found = found.withColumn("key_", F.bround("fair_value", -1)).withColumns({"c_": F.lower("company"), "t_": F.lower("investment_type")})
    found = dedupe(found, [id_col, "c_", "t_", "key_"], [F.col("place")])
    for c in ("principal", "cost", "fair_value"):
        found = found.withColumn(c, F.col(c) * multiplier)
    return found.filter(F.abs("fair_value") <= largest).drop("key_", "c_", "t_", "place")
