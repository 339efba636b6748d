"""Code taxonomies: paths, nearest parents, lookups, ids."""

import uuid

from pyspark.sql import functions as F

from prismfold.operators import frames as O
from prismfold.operators import lists as L
from prismfold.plans import taxonomy as T

NODES = [("10", "Energy"), ("1010", "Energy Group"), ("101010", "Equipment"), ("10101010", "Drilling"), ("20", "Industrials"), ("20101010", "Aerospace")]


def nodes(spark):
    return spark.createDataFrame(NODES, "code string, name string")


def test_paths_parents_and_ids(spark):
    got = {r.code: r for r in T.described(nodes(spark)).collect()}
    assert got["10101010"].path == "/Energy/Energy Group/Equipment/Drilling" and got["10101010"].parent_code == "101010" and got["10101010"].level_name == "sub_industry"
    assert got["10"].parent_code is None and got["10"].path == "/Energy" and got["10"].level == 1
    assert got["20101010"].parent_code == "20" and got["20101010"].path == "/Industrials/Aerospace"  # levels between are not in the list
    assert all(r.node_id == str(uuid.uuid5(uuid.UUID(T.NAMESPACE), c)) for c, r in got.items())


def test_lookup_and_rollup(spark):
    low = {r.sub_industry_code: r for r in T.lookup(nodes(spark)).collect()}
    assert low["10101010"].industry_name == "Equipment" and low["20101010"].industry_name is None and low["20101010"].sector_name == "Industrials"
    values = spark.createDataFrame([("10101010", 5.0), ("1010", 2.0), ("20101010", 1.0), ("99", 7.0), (None, 3.0)], "code string, v double")
    assert {r.code: (r.total, r.n) for r in T.rollup_levels(values, nodes(spark), "v").collect()} == {"10": (7.0, 2), "1010": (7.0, 2), "101010": (5.0, 1), "10101010": (5.0, 1), "20": (1.0, 1), "20101010": (1.0, 1)}


def test_shares_with_null_keys_need_no_window(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 3.0), (2, None, 5.0), (3, None, 5.0)], "id int, k string, v double")
    out = O.with_share(df, "v", ["k"])
    assert sorted((r.id, r.pct) for r in out.collect()) == [(1, 25.0), (1, 75.0), (2, 50.0), (3, 50.0)] and out.columns == ["id", "k", "v", "pct"]
    assert "Window" not in out._jdf.queryExecution().toString()


def test_patterns_keep_their_classes(spark):
    df = spark.createDataFrame([("Ab 1",), ("Äb",)], "n string")
    told = lambda p: [r[0] for r in df.select(L.contains(F.col("n"), p, pattern=True)).collect()]
    assert told(r"^\S+$") == [False, True] and told(r"^ab \d$") == [True, False] and told("^äB$") == [False, True] and told(r"\D$") == [False, True]
