"""Sources merged into one set of companies, and reviewers' values written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismfold.functions.names import md5_uuid
from prismfold.operators.tables import merge_nonnull


def company_stubs(names: DataFrame, companies: DataFrame, source: str) -> DataFrame:
    """company_id, company_name and source of a new company for each name that no company has, whatever its case.

    Of names that differ by case only, the least stays. `names`: raw_company_name; `companies`: company_name.
    """
    found = names.filter("raw_company_name is not null").groupBy(F.lower("raw_company_name").alias("key_")).agg(F.min("raw_company_name").alias("company_name"))
    known = companies.select(F.lower("company_name").alias("key_")).filter("key_ is not null").distinct()
    fresh = found.join(known, "key_", "left_anti")
    return fresh.select(md5_uuid(F.concat(F.lit(f"{source}_company_"), "company_name")).alias("company_id"), "company_name", F.lit(source).alias("source"))


def merge_sources(companies: DataFrame, filed: DataFrame, source: str) -> DataFrame:
    """`companies` after a filing (raw_company_name, reported_sector): stubs for new names, and a sector where a company
    had none. Names match whatever their case; the least sector of a name counts."""
    stubs = company_stubs(filed, companies, source)
    every = companies.unionByName(stubs, allowMissingColumns=True).withColumn("key_", F.lower("company_name"))
    told = filed.filter("raw_company_name is not null").groupBy(F.lower("raw_company_name").alias("key_")).agg(F.min("reported_sector").alias("told_"))
    out = every.join(told, "key_", "left").withColumn("primary_sector", F.coalesce("primary_sector", "told_"))
    return out.select(*companies.columns)


def resolve_review(queue: DataFrame, decisions: DataFrame, ai: DataFrame, companies: DataFrame) -> DataFrame:
    """`companies` with the sector that reviewers settled: their own value, else the provider's where they approved it.

    `queue`: queue_item_id, company_id; `decisions`: queue_item_id, status, manual_sector; `ai`: company_id, ai_sector.
    Dismissed items change nothing.
    """
    settled = queue.join(decisions.filter("status in ('approved', 'resolved')"), "queue_item_id").join(ai, "company_id", "left")
    values = settled.groupBy("company_id").agg(F.max(F.coalesce("manual_sector", "ai_sector")).alias("primary_sector"))
    return merge_nonnull(companies, companies.select("company_id").join(values, "company_id"), ["company_id"])


def surface_columns(primary: Column, reported: Column) -> dict[str, Column]:
    """The value that each surface shows: dashboards and taxonomy pages prefer a company's own, holdings the reported
    one; sector cells of dashboards and holdings never fall back."""
    return {"own_first": F.coalesce(primary, reported), "reported_first": F.coalesce(reported, primary), "own_only": primary}
