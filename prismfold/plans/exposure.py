"""Exposure inference, investor scaling, taxonomy resolution, rollup and snapshots."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismfold.operators.frames import join_dealt, share_trend
from prismfold.sources.catalog import Catalog

UNALLOCATED = "UNALLOCATED / UNKNOWN"


def infer_exposures(reports: DataFrame, holdings: DataFrame, *, total: float = 100_000_000.0, scale_to_nav: bool = True) -> DataFrame:
    """Each report's allocation, dealt to its holdings in proportion to their values.

    A quarter's funds share the total equally. A holding counts with its value if positive, else with its fraction
    of the estimated net assets if positive, else with 0. A report whose coverage is below 1 adds an unknown row, on
    top of the holdings' full allocation. Reports without holdings take their slot too.

    `reports`: fund_id, as_of_date, coverage; `holdings`: fund_id, as_of_date, holding_id, company_id, value, pct.
    """
    by_quarter = reports.groupBy("as_of_date").agg(F.countDistinct("fund_id").alias("funds"))
    allotted = reports.join(F.broadcast(by_quarter), "as_of_date").withColumn("alloc", F.lit(total) / F.col("funds"))
    covered = holdings.groupBy("fund_id", "as_of_date").agg(F.sum("value").cast("double").alias("covered"))
    base = allotted.join(covered, ["fund_id", "as_of_date"], "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))
    nav = F.when((F.col("covered") > 0) & (F.col("coverage") > 0), F.col("covered") / F.col("coverage")).when(F.col("covered") > 0, F.col("covered")).otherwise(1.0)
    base = base.withColumn("nav", nav)
    rows = holdings.join(base.select("fund_id", "as_of_date", "alloc", "nav"), ["fund_id", "as_of_date"])
    worth = F.when(F.col("value") > 0, F.col("value").cast("double")).when(F.col("pct") > 0, F.col("pct") * F.col("nav")).otherwise(0.0)
    rows = rows.withColumn("worth", F.round(worth, 6).cast("decimal(28,6)"))
    if scale_to_nav:
        # a row for each report is joined back: no report's holdings meet in one task
        rows = rows.join(rows.groupBy("fund_id", "as_of_date").agg(F.sum("worth").cast("double").alias("whole")), ["fund_id", "as_of_date"])
    denominator = F.coalesce(F.nullif(F.col("whole"), F.lit(0.0)), F.lit(1.0)) if scale_to_nav else F.col("nav")
    known = rows.select("fund_id", "as_of_date", "holding_id", "company_id", (F.col("alloc") * F.col("worth").cast("double") / denominator).alias("exposure"), F.lit("reported").alias("exposure_type"))
    rest = base.filter("coverage < 1").select(
        "fund_id", "as_of_date", F.lit(None).cast("string").alias("holding_id"), F.lit(None).cast(holdings.schema["company_id"].dataType).alias("company_id"), (F.col("alloc") * (1 - F.col("coverage"))).alias("exposure"), F.lit("unknown").alias("exposure_type")
    )
    return known.unionByName(rest)


def interpolate(index: Column, count: Column, start: float, end: float, steps: int = 8) -> Column:
    """A straight line over at most `steps` quarters, flat from then on; one quarter takes the start."""
    last = F.least(count, F.lit(steps)) - 1
    return F.when(last <= 0, F.lit(float(start))).otherwise(start + F.least(index, last) / last * (end - start))


def scale_to_investor(holdings: DataFrame, reports: DataFrame, configured: dict[str, tuple[float, float]], rate: float = 0.05) -> DataFrame:
    """Holdings at the investor's net asset value times their share of the fund.

    The value comes from a configured line by fund name, else, for PDF funds, from their statement (a quarter
    without one is left out), else as a fixed rate of the holdings' sum. `holdings`: fund_id, fund_name, source,
    as_of_date, holding_id, value > 0; `reports`: fund_id, as_of_date, nav, net_assets.
    """
    live = holdings.filter("value > 0 and as_of_date is not null")
    # a row for each fund's quarter: ranks and totals are of these, and the holdings stay in place
    quarters = live.groupBy("fund_id", "as_of_date").agg(F.sum("value").cast("double").alias("total"))
    of_fund = Window.partitionBy("fund_id")
    quarters = quarters.withColumn("index", F.row_number().over(of_fund.orderBy("as_of_date")) - 1).withColumn("count", F.count("*").over(of_fund))
    told = reports.groupBy("fund_id", "as_of_date").agg(F.max("nav").alias("nav"), F.max("net_assets").alias("net_assets"))
    rows = live.join(quarters.join(told, ["fund_id", "as_of_date"], "left"), ["fund_id", "as_of_date"])
    is_pdf = F.col("source") == "pdf_document"
    value = F.when(is_pdf, F.nullif(F.col("nav"), F.lit(0.0))).otherwise(F.col("total") * rate)
    base = F.when(is_pdf, F.coalesce(F.nullif(F.col("net_assets"), F.lit(0.0)), F.col("total"))).otherwise(F.col("total"))
    for name, (start, end) in configured.items():
        value = F.when(F.col("fund_name") == name, interpolate(F.col("index"), F.col("count"), start, end)).otherwise(value)
        base = F.when(F.col("fund_name") == name, F.col("total")).otherwise(base)
    out = rows.withColumn("lp_nav", value).withColumn("base", base).filter("lp_nav is not null")
    pct = F.col("value").cast("double") / F.col("base")
    return out.select("fund_id", "as_of_date", "holding_id", "lp_nav", pct.alias("holding_pct"), (F.col("lp_nav") * pct).alias("scaled"))


def resolve_taxonomy(exposures: DataFrame, classified: DataFrame, by_text: DataFrame, company: DataFrame, unknown: str, text_confidence: float = 0.75) -> DataFrame:
    """node_id and confidence of each exposure: classification, then reported text, then the company's own node.

    A classification wins even where it is the unknown node. `classified`: company_id, node_id, confidence; `by_text`:
    company_id, text_node; `company`: company_id, own_node. A null company is unknown with confidence 0.
    """
    c = classified.select("company_id", F.col("node_id").alias("ai_node"), F.col("confidence").alias("ai_confidence"))
    # the companies' tables meet first, so that the exposures are joined once
    told = c.join(by_text, "company_id", "full").join(company, "company_id", "full")
    rows = join_dealt(exposures, told, "company_id")
    node = F.coalesce("ai_node", "text_node", "own_node", F.lit(unknown))
    confidence = F.when(F.col("ai_node").isNotNull(), F.col("ai_confidence")).when(F.col("text_node").isNotNull(), text_confidence).when(F.col("own_node").isNotNull(), 1.0).otherwise(0.0)
    return rows.withColumn("node_id", node).withColumn("confidence", confidence).drop("ai_node", "ai_confidence", "text_node", "own_node")


def rollup(exposures: DataFrame, value: str, dimensions: dict[str, str], confidence: str) -> DataFrame:
    """Sums by taxonomy node and date for each fund, and for the portfolio (fund '') from the sums of its funds."""
    stack = ", ".join(f"'{kind}', `{column}`" for kind, column in dimensions.items())
    long = exposures.select("fund_id", "as_of_date", F.col(value).alias("v_"), (F.col(value) * F.col(confidence)).alias("w_"), F.expr(f"stack({len(dimensions)}, {stack}) as (taxonomy_type, node_id)"))
    sums = [F.sum("v_").alias("v_"), F.sum("w_").alias("w_")]
    by_fund = long.groupBy(F.col("fund_id").cast("string").alias("fund"), "as_of_date", "taxonomy_type", "node_id").agg(*sums)
    whole = by_fund.groupBy("as_of_date", "taxonomy_type", "node_id").agg(*sums).withColumn("fund", F.lit(""))
    return whole.unionByName(by_fund).withColumnsRenamed({"v_": "total", "w_": "weighted"})


def store_snapshot(catalog: Catalog, name: str, records: DataFrame, snapshot_id: str, day: dt.date, months: int = 24) -> int:
    """Add a snapshot to the stored ones: it is the latest, the one before no longer is, and those of more than `months`
    calendar months ago go. One commit, which rewrites the files of the snapshots that change and no others; a snapshot
    that is stored again replaces itself."""
    stamps = {"snapshot_id": F.lit(snapshot_id), "snapshot_date": F.lit(day), "is_latest": F.lit(True)}
    new = records.withColumns(stamps)
    first_day = F.add_months(F.lit(day), -months)
    expired, own = F.col("snapshot_date") < first_day, F.col("snapshot_id") == snapshot_id

    def renewed(old: DataFrame) -> DataFrame:
        return old.filter(~expired & ~own).withColumn("is_latest", F.lit(False)).unionByName(new)

    return catalog.rewrite(name, "snapshot", lambda old: old.filter(F.col("is_latest") | expired | own), renewed, new.schema, ["snapshot_date"])


def stored_trend(snapshots: DataFrame, nodes: DataFrame, fund: str, periods: int = 8, n: int = 6) -> DataFrame:
    """snapshot_date, name and pct of a fund (or the portfolio, '') in the newest stored snapshots; `nodes`: node_id, name.

    The unknown node has no name and drops out; snapshots of one day are added up.
    """
    rows = snapshots.filter(F.col("fund") == fund).join(nodes, "node_id")
    days = rows.select("snapshot_date").distinct().orderBy(F.col("snapshot_date").desc()).limit(periods)
    return share_trend(rows.join(F.broadcast(days), "snapshot_date"), "snapshot_date", "name", "total", n)


def keep_last(snapshot: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """For each node the row of the newest date on which it appears, so that one snapshot may mix dates."""
    rest = [c for c in snapshot.columns if c not in keys]
    best = snapshot.groupBy(*keys).agg(F.max_by(F.struct(*rest), date).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


# Drift of a sector's share for each quarter back, by the first word that its name holds.
DRIFT = [
    ("technology", -0.030),
    ("information technology", -0.030),
    ("healthcare", -0.025),
    ("health care", -0.025),
    ("communication", -0.020),
    ("financials", 0.010),
    ("finance", 0.010),
    ("industrials", -0.010),
    ("energy", 0.030),
    ("utilities", 0.025),
    ("real estate", 0.020),
]


def drift_rate(name: Column, node: Column) -> Column:
    """The listed rate, else one from the node's hash."""
    h = F.conv(F.substring(F.md5(node), 1, 6), 16, 10).cast("long")
    size = F.lit(0.008) + (h % 1000) / 50000
    rate = F.when(h % 2 == 0, size).otherwise(-size)
    for word, r in reversed(DRIFT):
        rate = F.when(F.lower(name).contains(word), F.lit(r)).otherwise(rate)
    return rate


def drift_history(shares: DataFrame, quarters: int = 8) -> DataFrame:
    """Earlier shares of names (name, node, value): drifted by steps back, at least 0.001, made whole again."""
    total = shares.agg(F.sum("value").cast("double").alias("total"))
    steps = shares.sparkSession.range(quarters).select((quarters - 1 - F.col("id")).cast("int").alias("steps"))
    rows = shares.join(F.broadcast(total)).join(F.broadcast(steps))
    moved = F.greatest(F.col("value").cast("double") / F.col("total") + drift_rate(F.col("name"), F.col("node")) * F.col("steps"), F.lit(0.001))
    rows = rows.withColumn("moved", moved)
    return rows.select("name", "steps", (F.col("moved") / F.sum("moved").over(Window.partitionBy("steps")) * F.col("total")).alias("value"))
