import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismfold.operators.quantiles import exact_quantiles

ASKED = {"low": 0.01, "q1": 0.25, "median": 0.5, "p90": 0.9, "most": 1.0}


def brute(rows):
    groups = {}
    for k, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(k, []).append(v)
    return {k: (len(v), *[round(float(np.quantile(v, f)), 9) for f in ASKED.values()]) for k, v in groups.items()}


def found(df, settle):
    return {r.k: (r.n, *[round(r[name], 9) for name in ASKED]) for r in exact_quantiles(df, ["k"], "v", ASKED, settle).collect()}


@pytest.mark.parametrize("settle", [0, 100_000])
def test_equal_to_brute_force_with_ties_nulls_and_skew(spark, settle):
    rng = np.random.default_rng(5)
    rows = [("hot", float(x)) for x in rng.lognormal(0, 3, 3000)] + [("ties", float(x % 3)) for x in range(400)]
    rows += [("two", -1.0)] * 5 + [("two", 1.0)] * 5 + [("one", 4.0), (None, 2.0), (None, 3.0), ("none", None), ("nan", float("nan")), ("hot", None)]
    rows += [("wide", x) for x in (-1e300, -1.0, 0.0, 1e-300, 1e300)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    assert found(df, settle) == brute(rows)


def test_no_rows_no_groups_and_ranks_outside_the_first_band(spark, monkeypatch):
    monkeypatch.setattr("prismfold.operators.quantiles.MARGIN", 1e-9)  # bands miss the rank and are widened
    df = spark.range(5000).select(F.lit("a").alias("k"), (F.xxhash64("id") % 100000).cast("double").alias("v"))
    assert found(df, 10) == brute([tuple(r) for r in df.collect()])
    assert exact_quantiles(df.limit(0), ["k"], "v", ASKED).count() == 0
    alone = exact_quantiles(df, [], "v", {"m": 0.5}, 10)
    assert alone.columns == ["n", "m"] and alone.first().n == 5000


def test_what_is_left_to_sort_is_bounded(spark):
    """Between passes a group keeps sketches, not values: the checkpointed rows are a band for each rank."""
    df = spark.range(200_000).select(F.lit(1).alias("k"), F.rand(3).alias("v"))
    out = exact_quantiles(df, ["k"], "v", {"m": 0.5}, 500).first()
    exact = df.agg(F.percentile("v", 0.5)).first()[0]
    assert out.m == pytest.approx(exact, abs=1e-12)
