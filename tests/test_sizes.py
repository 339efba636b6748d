"""Joins and sums that hold at size: rounding of ties, null keys, few groups."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from prismfold.operators import quantiles
from prismfold.operators.frames import join_dealt
from prismfold.plans import exposure
from prismfold.plans.queries import ORACLES


def test_shares_just_below_a_tie_round_as_sql_does(spark, tmp_path):
    from prismfold.plans.pages import known_share_gate

    nation = [(i, f"NATION_{i}", 0) for i in range(25)]
    part = [(i, "red ring", "b", "t", 1, 1.0) for i in range(25)]
    item, cents = [], lambda k, m: (20 * k * m, 20 * (2000 - k) * m)
    for fund, (k, m) in enumerate((k, m) for k in range(1, 2000, 2) for m in (1, 3)):
        item += [(fund, p, fund, p, price / 100, dt.datetime(1998, 1, 1)) for p, price in zip((1, 2), cents(k, m)) if fund % 11]
    schemas = {
        "nation": (nation, "n_nationkey int, n_name string, n_regionkey int"), "supplier": ([(0, "s", 0, 0.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "part": (part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "lineitem": ([(*r[:5], 0.1, r[5]) for r in item], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in schemas.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(map(tuple, known_share_gate(spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(ORACLES["known_share_gate"]).fetchall()) and len(got) > 3000


def test_values_of_few_groups_are_not_shuffled_by_group(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = quantiles.exact_quantiles(df, ["g"], "v", {"m": 0.5}, settle=100)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.g: (r.n, r.m) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {g: (1000, g + 1498.5) for g in range(3)}
    assert "BroadcastHashJoin" in plan


def test_null_keys_do_not_meet_in_one_task(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).alias("company_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        told = spark.range(0, 2000, 20).select(F.col("id").alias("company_id"), F.lit("n").alias("node_id"), F.lit(0.5).alias("confidence"))
        by_text, own = (told.select("company_id", F.col("node_id").alias(c)).limit(0) for c in ("text_node", "own_node"))
        out = exposure.resolve_taxonomy(rows, told, by_text, own, "unknown").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {r.id: r.node_id for r in out} == {i: "n" if i % 20 == 0 else "unknown" for i in range(2000)} and len(out) == 2000
    nulls = [r.task for r in out if r.company_id is None]
    assert max(nulls.count(t) for t in set(nulls)) < 0.5 * len(nulls)
    assert join_dealt(rows, told, "company_id").columns == ["company_id", "id", "node_id", "confidence"]


def _plan(spark, query, sf_dir):
    """The plan without broadcasts, as large tables have it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        return query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_countries_are_counted_without_copies_or_sorts_of_the_holdings(spark, sf_dir):
    from prismfold.plans.pages import country_by_surface

    plan = _plan(spark, country_by_surface, sf_dir)
    assert "Expand" not in plan and "ShuffledHashJoin" in plan


def test_export_deals_the_holdings_once_by_holding(spark, sf_dir):
    from prismfold.plans.pages import holdings_export

    lines = _plan(spark, holdings_export, sf_dir).split("\n")
    dealt = [x for x in lines if "Exchange hashpartitioning(holding_id" in x]
    assert sum("ReusedExchange" not in x for x in dealt) == 1
