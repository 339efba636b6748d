"""Entity resolution in five stages, and consolidation of duplicate companies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismfold.functions.names import first_entity, normalize_name, tokens
from prismfold.functions.values import clean_text
from prismfold.operators.frames import join_dealt
from prismfold.operators.similarity import greedy_stars, similar_pairs, token_join
from prismfold.sources.catalog import use_checkpoints

# Confidence of each stage.
CONFIDENCE = {"direct": 1.0, "alias": 0.95, "normalized": 0.90, "token_overlap": 0.80, "first_entity": 0.75, "unresolved": 0.0}


def resolve_names(raw: DataFrame, companies: DataFrame, aliases: DataFrame, threshold: float = 0.70) -> DataFrame:
    """id, company_id, method and confidence of each raw name (id, name).

    `companies`: company_id, company_name; `aliases`: company_id, alias. Where names collide, the last id wins for
    names and aliases, the first for normal forms. Each distinct name is resolved once; a null name is unresolved. Joins are
    merged: by the size of the files, which repeat few words, Spark would send whole tables of names to the driver.
    """
    use_checkpoints(raw.sparkSession)
    names = raw.select(clean_text(F.col("name")).alias("name")).filter("name is not null").distinct()
    names = names.withColumn("key", F.lower(F.trim("name"))).withColumn("norm", normalize_name(F.col("name"))).withColumn("first", normalize_name(first_entity(F.col("name"))))
    direct = companies.groupBy(F.lower(F.trim("company_name")).alias("key")).agg(F.max("company_id").alias("direct_id"))
    alias = aliases.groupBy(F.lower(F.trim("alias")).alias("key")).agg(F.max("company_id").alias("alias_id"))
    normal = companies.withColumn("norm", normalize_name(F.col("company_name"))).filter("norm <> ''").groupBy("norm").agg(F.min("company_id").alias("normal_id"))
    normal = normal.checkpoint()
    found = names.join(direct.hint("merge"), "key", "left").join(alias.hint("merge"), "key", "left").join(normal.hint("merge"), "norm", "left")
    found = found.join(normal.select(F.col("norm").alias("first"), F.col("normal_id").alias("first_id")).hint("merge"), "first", "left").checkpoint()
    open_names = found.filter("direct_id is null and alias_id is null and normal_id is null")
    left = open_names.select(F.col("name").alias("id"), tokens(F.col("norm")).alias("tokens")).filter(F.size("tokens") >= 2)
    right = normal.select(F.col("normal_id").alias("id"), tokens(F.col("norm")).alias("tokens"))
    near = token_join(left, right, threshold)
    best = near.groupBy(F.col("left_id").alias("name")).agg(F.max_by("right_id", F.struct("score", -F.col("right_id"))).alias("token_id"))
    found = found.join(best.hint("merge"), "name", "left")
    stages = {"direct": "direct_id", "alias": "alias_id", "normalized": "normal_id", "token_overlap": "token_id", "first_entity": "first_id"}
    method = F.lit("unresolved")
    for stage, column in reversed(stages.items()):
        method = F.when(F.col(column).isNotNull(), F.lit(stage)).otherwise(method)
    resolved = found.select("name", F.coalesce(*stages.values()).alias("company_id"), method.alias("method"))
    out = join_dealt(raw.withColumn("name", clean_text(F.col("name"))), resolved.hint("merge"), "name").withColumn("method", F.coalesce("method", F.lit("unresolved")))
    confidence = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.col("method"))
    return out.select("id", "company_id", "method", confidence.alias("confidence"))


def consolidate(companies: DataFrame, threshold: float = 0.90) -> DataFrame:
    """company_id and canonical_id of companies that are duplicates.

    Equal normal forms of two words or more form a group; the others are clustered greedily at the threshold. A
    group's canonical name has no " and ", no bracket, is shortest, and comes first.
    """
    use_checkpoints(companies.sparkSession)
    named = companies.select("company_id", "company_name", normalize_name(F.col("company_name")).alias("norm")).withColumn("tokens", tokens(F.col("norm"))).filter(F.size("tokens") >= 2).checkpoint()
    same = named.groupBy("norm").agg(F.count("*").alias("n"), F.min("company_id").alias("seed")).checkpoint()
    exact = named.join(same.filter("n > 1").hint("merge"), "norm").select("company_id", "company_name", "seed")
    alone = named.join(same.filter("n = 1").select("norm").hint("merge"), "norm", "left_semi").select(F.col("company_id").alias("id"), "tokens")
    stars = greedy_stars(similar_pairs(alone, threshold), lambda df: df.checkpoint())
    groups = exact.unionByName(stars.withColumnRenamed("id", "company_id").join(named.hint("merge"), "company_id").select("company_id", "company_name", "seed")).checkpoint()
    # the first in this order combines in the map tasks: no task holds a group
    order = F.struct(F.lower("company_name").contains(" and ").alias("a"), F.col("company_name").contains("(").alias("b"), F.length("company_name").alias("c"), F.col("company_id").alias("id"))
    heads = groups.groupBy("seed").agg(F.count("*").alias("n"), F.min(order).alias("best")).filter("n > 1")
    return groups.join(heads.hint("merge"), "seed").select("company_id", F.col("best.id").alias("canonical_id"))
