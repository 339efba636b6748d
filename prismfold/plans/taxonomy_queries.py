"""The registered queries of code taxonomies: levels, paths, lookups and rollups over a node list made from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismfold.plans import silver as S
from prismfold.plans import taxonomy as T
from prismfold.plans.providers import map_texts
from prismfold.plans.queries import _query
from prismfold.sources.catalog import shared_folder

_CODE = "lpad(p_size::VARCHAR, 2, '0') || lpad(substr(p_brand, 7), 2, '0') || lpad((p_partkey % 7)::VARCHAR, 2, '0') || lpad((p_partkey % 3)::VARCHAR, 2, '0')"
# level-3 nodes that end in 05 are not in the list
_NODES = f"""WITH leaf AS (SELECT p_partkey, {_CODE} AS code FROM part),
nodes AS (SELECT DISTINCT substr(code, 1, 2 * i) AS code, 'Node ' || substr(code, 1, 2 * i) AS name FROM leaf, (SELECT unnest([1, 2, 3, 4]) AS i) WHERE NOT (i = 3 AND substr(code, 5, 2) = '05'))
"""


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    key = F.col("p_partkey")
    code = F.concat(two(F.col("p_size")), two(F.substring("p_brand", 7, 99)), two(key % 7), two(key % 3))
    return S.table(spark, sf_dir, "part").select("p_partkey", code.alias("code"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _leaves(spark, sf_dir).select(F.explode(T._prefixes(F.col("code"))).alias("code")).distinct()
    return codes.filter("not (length(code) = 6 and code like '%05')").withColumn("name", F.concat(F.lit("Node "), "code"))


@_query(_NODES + """, up AS (SELECT n.code, a.code AS above, a.name FROM nodes n JOIN nodes a ON starts_with(n.code, a.code) AND length(a.code) % 2 = 0 AND a.code = substr(n.code, 1, length(a.code)))
SELECT code, (length(code) // 2)::INT AS level, ['sector', 'industry_group', 'industry', 'sub_industry'][length(code) // 2] AS level_name,
max(CASE WHEN above <> code THEN above END) AS parent_code, '/' || string_agg(name, '/' ORDER BY above) AS path FROM up GROUP BY code""", silver=False)
def taxonomy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.described(_nodes(spark, sf_dir)).select("code", "level", "level_name", "parent_code", "path")


@_query(_NODES + """SELECT s.code AS sector_code, s.name AS sector_name, g.code AS industry_group_code, g.name AS industry_group_name, substr(u.code, 1, 6) AS industry_code, i.name AS industry_name,
u.code AS sub_industry_code, u.name AS sub_industry_name FROM nodes u LEFT JOIN nodes s ON s.code = substr(u.code, 1, 2) LEFT JOIN nodes g ON g.code = substr(u.code, 1, 4)
LEFT JOIN nodes i ON i.code = substr(u.code, 1, 6) WHERE length(u.code) = 8""", silver=False)
def taxonomy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.lookup(_nodes(spark, sf_dir))


@_query(_NODES + """, v AS (SELECT code, l_extendedprice::DECIMAL(18,2) AS v FROM lineitem JOIN leaf ON l_partkey = p_partkey),
u AS (SELECT v, unnest([substr(code, 1, 2), substr(code, 1, 4), substr(code, 1, 6), code]) AS code FROM v)
SELECT code, (length(code) // 2)::INT AS level, sum(v)::DOUBLE AS total, count(*) AS n FROM u JOIN nodes USING (code) GROUP BY 1""", silver=False)
def taxonomy_level_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = S.table(spark, sf_dir, "lineitem").join(_leaves(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey")).select("code", F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    return T.rollup_levels(items, _nodes(spark, sf_dir), "v").select("code", T.level(F.col("code")).alias("level"), F.col("total").cast("double").alias("total"), "n")


def _coded(texts: list[str], allowed: list[list[str]]) -> list[tuple[str | None, float]]:
    """Stands in for an outside provider: a code by the length of a text, which may not exist."""
    return [(f"{len(t) * 3 % 60:02d}", len(t) % 13 / 10) for t in texts]


@_query(_NODES + """, p AS (SELECT p_partkey, trim(concat_ws(' ', p_name, p_brand, p_size)) AS s FROM part), t AS (SELECT DISTINCT s FROM p WHERE s NOT IN (SELECT s FROM p WHERE p_partkey % 9 = 0)),
a AS (SELECT s, lpad((length(s) * 3 % 60)::VARCHAR, 2, '0') AS answer, least(1.0, (length(s) % 13)::DOUBLE / 10) AS c FROM t)
SELECT s AS reported_sector, code, name, CASE WHEN code IS NULL THEN 0.0 ELSE c END AS confidence, CASE WHEN code IS NULL THEN 'Invalid code returned: ' || answer END AS rationale
FROM a LEFT JOIN nodes ON code = answer""", silver=False)
def provider_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sector texts that are not mapped yet, asked in batches of twenty whose answers are recorded one by one."""
    part = S.table(spark, sf_dir, "part").select("p_partkey", F.trim(F.concat_ws(" ", "p_name", "p_brand", "p_size")).alias("reported_sector"))
    return map_texts(part, part.filter("p_partkey % 9 = 0").distinct(), _nodes(spark, sf_dir), _coded, shared_folder(spark, "calls"))
