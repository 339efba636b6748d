"""Taxonomies whose codes hold their ancestors: two digits for each level down to the node's own.

The node list (code, name) is a parameter: a table or file that names the nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismfold.functions.names import uuid5

# Names of the levels from the top, and the namespace of node ids.
LEVELS = ["sector", "industry_group", "industry", "sub_industry"]
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"

DIGITS = 2


def level(code: Column) -> Column:
    return (F.length(code) / DIGITS).cast("int")


def _prefixes(code: Column) -> Column:
    """The codes from the top node down to the node itself; null has none."""
    return F.transform(F.sequence(F.lit(1), F.greatest(level(code), F.lit(1))), lambda i: F.substring(code, F.lit(1), i * DIGITS))


def closure(nodes: DataFrame) -> DataFrame:
    """ancestor, code and distance of each node and those above it, itself included, as far as they are in the list.

    The codes tell the ancestors, so that one join by code does it, whatever the depth.
    """
    pairs = nodes.select("code", F.explode(_prefixes(F.col("code"))).alias("ancestor"))
    distance = level(F.col("code")) - level(F.col("ancestor"))
    return pairs.join(nodes.select(F.col("code").alias("ancestor")), "ancestor", "left_semi").select("ancestor", "code", distance.alias("distance"))


def described(nodes: DataFrame) -> DataFrame:
    """code, name, level, level_name, parent_code, path and node_id of each node. An ancestor that the list lacks is left out of
    the path; the parent is the nearest one that it has."""
    above = closure(nodes).join(nodes.select(F.col("code").alias("ancestor"), F.col("name").alias("ancestor_name")), "ancestor")
    line = F.array_sort(F.collect_list(F.struct("ancestor", "ancestor_name")))  # one entry a level at the most
    paths = above.groupBy("code").agg(line.alias("line")).withColumn("path", F.concat(F.lit("/"), F.array_join("line.ancestor_name", "/"))).withColumn("parent_code", F.get("line.ancestor", F.size("line") - 2))
    name = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), level(F.col("code")))
    return nodes.join(paths, "code").select("code", "name", level(F.col("code")).alias("level"), name.alias("level_name"), "parent_code", "path", uuid5(NAMESPACE, F.col("code")).alias("node_id"))


def lookup(nodes: DataFrame) -> DataFrame:
    """For each node of the lowest level, the code and name of its node on every level."""
    low = nodes.filter(level(F.col("code")) == len(LEVELS)).select("code")
    out = low
    for i, name in enumerate(LEVELS):
        codes = nodes.select(F.col("code").alias(f"{name}_code"), F.col("name").alias(f"{name}_name"))
        out = out.withColumn(f"{name}_code", F.substring("code", 1, (i + 1) * DIGITS)).join(codes, f"{name}_code", "left")
    return out.select(*[f"{name}_{x}" for name in LEVELS for x in ("code", "name")])


def rollup_levels(values: DataFrame, nodes: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """code, total and n for every node and `keys`: what is booked on it and below. `values` has a code and a value; they are
    summed by code before the closure spreads them over the levels."""
    keys = keys or []
    sums = values.groupBy(*keys, "code").agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return sums.join(closure(nodes), "code").groupBy(*keys, F.col("ancestor").alias("code")).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
