"""The registered queries of names that must be matched: resolution in all its stages, and consolidation of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismfold.plans import silver as S
from prismfold.plans.queries import _NORM, _query
from prismfold.plans.resolution import consolidate, resolve_names

# Company names of five words from a part and six that all share, so that few companies differ by a word only.
_COMPANY = "p_name || ' ' || p_brand || ' ' || p_type || ' size' || p_size || ' international industrial systems services fund america'"


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.lit(" international industrial systems services fund america")
    name = F.concat("p_name", F.lit(" "), "p_brand", F.lit(" "), "p_type", F.lit(" size"), F.col("p_size").cast("string"), tail)
    return S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("company_id"), name.alias("company_name"))


_WORDS = "list_distinct(list_filter(string_split({0}, ' '), lambda w: w <> ''))"


@_query(f"""WITH RECURSIVE c AS (SELECT p_partkey AS id, {_COMPANY} AS name, {_NORM.format(_COMPANY)} AS norm FROM part),
a AS (SELECT 'alias ' || id AS k, max(id) AS alias_id FROM c WHERE id % 6 = 1 GROUP BY 1),
d AS (SELECT lower(trim(name)) AS k, max(id) AS direct_id FROM c GROUP BY 1), n AS (SELECT norm, min(id) AS normal_id FROM c GROUP BY 1),
r AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ' ' || upper({_COMPANY}) WHEN 1 THEN 'Alias ' || p_partkey WHEN 2 THEN {_COMPANY} || ', Inc. (old)'
  WHEN 3 THEN substr({_COMPANY}, strpos({_COMPANY}, ' ') + 1) WHEN 4 THEN CASE WHEN p_partkey % 12 = 4 THEN 'Unknown ' || p_partkey END
  ELSE {_COMPANY} || ' Inc, Zeta Omega Partners Kappa Two Delaware' END AS raw FROM part),
x AS (SELECT p_partkey, raw, {_NORM.format('raw')} AS norm, {_NORM.format("split_part(raw, ' Inc, Zeta', 1)")} AS first FROM r),
f AS (SELECT x.*, direct_id, alias_id, n.normal_id, g.normal_id AS first_id FROM x LEFT JOIN d ON lower(trim(raw)) = d.k LEFT JOIN a ON lower(trim(raw)) = a.k LEFT JOIN n ON x.norm = n.norm LEFT JOIN n g ON x.first = g.norm),
l AS (SELECT DISTINCT norm AS id, {_WORDS.format('norm')} AS w FROM f WHERE direct_id IS NULL AND alias_id IS NULL AND normal_id IS NULL AND norm IS NOT NULL),
t AS (SELECT normal_id AS id, {_WORDS.format('norm')} AS w FROM n),
lw AS (SELECT id, len(w) AS k, unnest(w) AS w FROM l WHERE len(w) >= 2), tw AS (SELECT id, len(w) AS k, unnest(w) AS w FROM t),
p AS (SELECT lw.id AS norm, tw.id AS token_id, count(*)::DOUBLE / (min(lw.k) + min(tw.k) - count(*)) AS score FROM lw JOIN tw USING (w) GROUP BY 1, 2),
b AS (SELECT norm, token_id FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY score DESC, token_id) AS i FROM p WHERE score >= 0.7) WHERE i = 1)
SELECT p_partkey, coalesce(direct_id, alias_id, normal_id, token_id, first_id) AS company_id,
CASE WHEN direct_id IS NOT NULL THEN 'direct' WHEN alias_id IS NOT NULL THEN 'alias' WHEN normal_id IS NOT NULL THEN 'normalized' WHEN token_id IS NOT NULL THEN 'token_overlap' WHEN first_id IS NOT NULL THEN 'first_entity' ELSE 'unresolved' END AS method
FROM f LEFT JOIN b ON f.norm = b.norm""", silver=False)
def resolution_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as filings write them, a sixth for each stage: as it is, by alias, with a suffix, without its first word, as the
    first of two, and unknown or missing."""
    companies = _companies(spark, sf_dir)
    key, name = F.col("company_id"), F.col("company_name")
    unknown = F.when(key % 12 == 4, F.concat(F.lit("Unknown "), key.cast("string")))
    ways = [
        F.concat(F.lit(" "), F.upper(name)), F.concat(F.lit("Alias "), key.cast("string")), F.concat(name, F.lit(", Inc. (old)")),
        F.substring_index(name, " ", -10), unknown, F.concat(name, F.lit(" Inc, Zeta Omega Partners Kappa Two Delaware")),
    ]
    raw = F.get(F.array(*ways), (key % 6).cast("int"))
    aliases = companies.filter(key % 6 == 1).select("company_id", F.concat(F.lit("ALIAS "), key.cast("string")).alias("alias"))
    out = resolve_names(companies.select(key.alias("id"), raw.alias("name")), companies, aliases)
    return out.select(F.col("id").alias("p_partkey"), "company_id", "method")


@_query(f"""WITH RECURSIVE raw AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 1 THEN replace({_COMPANY}, ' size', ' and size') || ' (x)' ELSE {_COMPANY} END AS name FROM part),
c AS (SELECT id, name, {_NORM.format('name')} AS norm FROM raw), t AS (SELECT id, norm, name, {_WORDS.format('norm')} AS w FROM c),
g AS (SELECT norm, count(*) AS n, min(id) AS seed FROM t WHERE len(w) >= 2 GROUP BY 1),
u AS (SELECT id, len(w) AS k, unnest(w) AS w FROM t JOIN g USING (norm) WHERE n = 1),
e AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2 HAVING count(*)::DOUBLE / (min(a.k) + min(b.k) - count(*)) >= 0.8),
v AS (SELECT a AS id FROM e UNION SELECT b FROM e), z AS (SELECT b, list(a) AS near FROM e GROUP BY 1),
o AS (SELECT id, row_number() OVER (ORDER BY id) AS i, near FROM v LEFT JOIN z ON b = id),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS seeds UNION ALL SELECT o.i, CASE WHEN near IS NOT NULL AND len(list_intersect(seeds, near)) > 0 THEN seeds ELSE list_append(seeds, id) END FROM walk JOIN o ON o.i = walk.i + 1),
s AS (SELECT unnest(seeds) AS seed FROM (SELECT seeds FROM walk ORDER BY i DESC LIMIT 1)),
m AS (SELECT seed AS id, seed FROM s UNION ALL SELECT b, min(a) FROM e JOIN s ON a = s.seed WHERE b NOT IN (SELECT seed FROM s) GROUP BY 1
  UNION ALL SELECT id, seed FROM t JOIN g USING (norm) WHERE n > 1),
h AS (SELECT m.id, m.seed, row_number() OVER (PARTITION BY m.seed ORDER BY contains(lower(name), ' and '), contains(name, '('), length(name), m.id) AS i, count(*) OVER (PARTITION BY m.seed) AS n FROM m JOIN t ON t.id = m.id)
SELECT x.id AS company_id, y.id AS canonical_id FROM h x JOIN h y ON y.seed = x.seed AND y.i = 1 WHERE x.n > 1""", silver=False)
def consolidated_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates at a similarity of 0.8: equal normal forms, and names that differ by a word or so."""
    key, name = F.col("company_id"), F.col("company_name")
    other = F.concat(F.regexp_replace(name, " size", " and size"), F.lit(" (x)"))
    return consolidate(_companies(spark, sf_dir).withColumn("company_name", F.when(key % 4 == 1, other).otherwise(name)), 0.8)
