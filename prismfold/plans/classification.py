"""Classification of companies: rules first, then a pluggable provider; sector text mapping; write-back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismfold.functions.values import clamp01, is_instrument
from prismfold.plans.providers import Provider, ask
from prismfold.sources.catalog import shared_folder


def _ask(rows: DataFrame, provider: Provider, batch: int, folder: str) -> DataFrame:
    """company_id, answer and confidence for rows (company_id, company_name, allowed), `batch` names to a call."""
    asked = rows.select("company_id", F.col("company_name").alias("text"), "allowed")
    return ask(asked, provider, folder, key="company_id", batch=batch).drop("error")


def classify_companies(companies: DataFrame, done: DataFrame, taxonomy: DataFrame, provider: Provider, unknown: str, *, threshold: float = 0.70, batch: int = 20, folder: str | None = None) -> DataFrame:
    """company_id, taxonomy_type, node_id, confidence and model of companies that `done` (company_id) lacks.

    Instruments take the rule's sector with confidence 1. Others are asked for a sector and, where that is
    known with enough confidence, for one of its industries. An answer outside the allowed names is the unknown node
    with confidence 0. `taxonomy`: sector, industry, by name. Answers are recorded in `folder`, where a later run goes on.
    """
    folder = folder or shared_folder(companies.sparkSession, "calls")
    todo = companies.join(done.select("company_id"), "company_id", "left_anti")
    rule = todo.filter(is_instrument(F.col("company_name")))
    pair = lambda kind, value: F.struct(F.lit(kind).alias("taxonomy_type"), F.lit(value).alias("node_id"))
    by_rule = rule.select("company_id", F.explode(F.array(pair("sector", "Financials"), pair("industry", "Capital Markets"))).alias("p"))
    by_rule = by_rule.select("company_id", "p.*", F.lit(1.0).alias("confidence"), F.lit("instrument_rule").alias("model"))
    sectors = taxonomy.agg(F.sort_array(F.collect_set("sector")).alias("allowed"))
    asked = todo.filter(~is_instrument(F.col("company_name"))).join(F.broadcast(sectors))
    sector = _ask(asked, provider, batch, f"{folder}/sector")
    industries = taxonomy.groupBy(F.col("sector").alias("answer")).agg(F.sort_array(F.collect_set("industry")).alias("allowed"))
    next_step = sector.filter(F.col("confidence") >= threshold).select("company_id", "answer").join(F.broadcast(industries), "answer").join(companies.select("company_id", "company_name"), "company_id")
    industry = _ask(next_step, provider, batch, f"{folder}/industry")
    label = lambda df, kind: df.select("company_id", F.lit(kind).alias("taxonomy_type"), F.coalesce("answer", F.lit(unknown)).alias("node_id"), "confidence", F.lit("provider").alias("model"))
    return by_rule.unionByName(label(sector, "sector")).unionByName(label(industry, "industry"))


def classify_countries(companies: DataFrame, codes: DataFrame) -> DataFrame:
    """company_id and country of companies without one: US for 13F sources, a valid ISO-2 answer of `codes` (company_id,
    code) for others; instruments are left out."""
    todo = companies.filter(F.col("primary_country").isNull()).join(codes, "company_id", "left")
    is_13f = F.col("source") == "13f_filing"
    code = F.when(is_13f, F.lit("US")).when(F.col("code").rlike("^[A-Z]{2}$"), F.col("code"))
    return todo.filter(is_13f | ~is_instrument(F.col("company_name"))).select("company_id", code.alias("country"))


def map_sectors(holdings: DataFrame, mapped: DataFrame, answers: DataFrame, nodes: DataFrame) -> DataFrame:
    """reported_sector, code and confidence of sector texts that `mapped` lacks (exact case); a code that `nodes` lacks
    is null with confidence 0."""
    texts = holdings.select(F.trim("reported_sector").alias("reported_sector")).filter("reported_sector <> ''").distinct()
    fresh = texts.join(mapped.select("reported_sector"), "reported_sector", "left_anti").join(answers, "reported_sector", "left")
    known = fresh.join(F.broadcast(nodes.select(F.col("code").alias("valid"))), F.col("code") == F.col("valid"), "left")
    return known.select("reported_sector", F.col("valid").alias("code"), F.when(F.col("valid").isNotNull(), clamp01(F.col("confidence"))).otherwise(0.0).alias("confidence"))


def write_back(companies: DataFrame, holdings: DataFrame, mapping: DataFrame, source: str = "bdc_filing") -> DataFrame:
    """`companies` with the mapped sector of their last reported sector text, whatever its case.

    Only companies of `source` change, and only to a sector that is not null; known sectors are overwritten too.
    `holdings`: company_id, reported_sector, ordinal; `mapping`: reported_sector, sector.
    """
    last = holdings.filter("reported_sector is not null").groupBy("company_id").agg(F.lower(F.max_by("reported_sector", "ordinal")).alias("key"))
    told = mapping.filter("sector is not null").groupBy(F.lower("reported_sector").alias("key")).agg(F.max("sector").alias("new_sector"))
    joined = companies.join(last.join(F.broadcast(told), "key"), "company_id", "left")
    change = (F.col("source") == source) & F.col("new_sector").isNotNull()
    return joined.withColumn("primary_sector", F.when(change, F.col("new_sector")).otherwise(F.col("primary_sector"))).select(*companies.columns)


def match_folders(folders: DataFrame, funds: DataFrame, accept: float = 0.6) -> DataFrame:
    """folder, fund_id and score of the best fund name for each folder name, if good enough.

    Equal word sets score 1; else the Jaccard similarity, raised where one set holds the other.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", " ")), " "), lambda w: w != ""))
    left = folders.select("folder", words(F.col("folder")).alias("a"))
    right = funds.select("fund_id", words(F.col("fund_name")).alias("b"))
    # only names that share a word are paired, by an equi-join on the word
    shared = left.select("folder", F.explode("a").alias("w")).join(right.select("fund_id", F.explode("b").alias("w")), "w").select("folder", "fund_id").distinct()
    pairs = shared.join(left, "folder").join(right, "fund_id")
    common, union = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    similar = common / union
    held = F.least(F.size("a"), F.size("b"))
    bonus = F.when(common == held, F.greatest(similar, 0.5 + 0.5 * held / F.greatest(F.size("a"), F.size("b")))).otherwise(similar)
    score = F.when(common == union, 1.0).otherwise(bonus)
    best = pairs.select("folder", "fund_id", score.alias("score")).filter(F.col("score") >= accept)
    return best.groupBy("folder").agg(F.max_by(F.struct("fund_id", "score"), F.struct("score", -F.col("fund_id"))).alias("m")).select("folder", "m.*")
