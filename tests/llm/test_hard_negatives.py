"""Hard negatives against all pairs in Python's integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismfold.llm import hard_negatives
from prismfold.llm.hard_negatives import mine

SCHEMA = "vec_id long, embedding array<double>, label int, anchor string, score int, other double"


def brute(rows, is_anchor, scale=256):
    fine = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab, *_ in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, lab in fine:
        if is_anchor(i):
            scored = sorted((-sum(x * y for x, y in zip(v, u)), k, other) for k, u, other in fine if len(u) == len(v))
            for p, pid, _ in [s for s in scored if s[2] == lab and s[1] != i][:5]:
                hard = [s for s in scored if s[2] != lab and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
                out += [(i, pid, r + 1, s[1], -p, -s[0]) for r, s in enumerate(hard)]
    return sorted(out)


def rows(seed, n, dim=8, size=1.0):
    r = random.Random(seed)
    out = [(i, [r.uniform(-0.4, size) for _ in range(dim)], r.randrange(3)) for i in range(n)]
    copy = [0.5] * dim
    out += [(n + i, copy, i % 3) for i in range(40)]  # ties
    out += [(n + 40, None, 1), (n + 41, copy, None), (n + 42, [None] * dim, 1), (n + 43, [math.nan, *copy[1:]], 1), (n + 44, [math.inf, *copy[1:]], 1), (None, copy, 1)]
    out += [(n + 45 + i, copy[: i % 3], i % 2) for i in range(30)]  # other lengths, empty vectors
    return [(*x, "clash", 1, 2.0) for x in out]


def result(df, anchors="vec_id % 10 = 0"):
    return sorted(tuple(r) for r in mine(df, F.expr(anchors)).collect())


@pytest.mark.parametrize("anchor_bytes, block", [(16 << 20, 4096), (8 * 8 * 5, 7)])
def test_equals_all_pairs(spark, monkeypatch, anchor_bytes, block):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", anchor_bytes)
    data = rows(1, 100)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    want = brute(data, lambda i: i % 10 == 0)
    assert len(want) > 100
    assert result(df) == want


def test_small_blocks_merge():
    best, k = hard_negatives._Best(4, 5), np.arange(300)
    scores = np.array([[(i * 37 + r * 11) % 23 for i in range(300)] for r in range(4)])
    for at in range(0, 300, 7):
        best.offer(scores[:, at : at + 7], scores[:, at : at + 7] % 2 == 0, k[at : at + 7])
    for r in range(4):
        want = sorted(((-s, i) for i, s in enumerate(scores[r].tolist()) if s % 2 == 0))[:5]
        assert [(-int(s), int(i)) for s, i in zip(best.score[best.row == r], best.id[best.row == r])] == want


def test_beyond_53_bits_is_exact(spark):
    r = random.Random(5)
    data = [(i, [2.0**22 * r.uniform(0.5, 1) + i / 256, 2.0**22 * r.uniform(0.5, 1)], i % 2, "c", 1, 1.0) for i in range(60)]
    want = brute(data, lambda i: i % 10 == 0)
    assert len(want) > 100 and all(w[4] > 2**53 for w in want)
    assert result(spark.createDataFrame(data, SCHEMA)) == want
    with pytest.raises(Exception, match="beyond 64 bits"):
        result(spark.createDataFrame([(*d[:1], [1e30, 1e30], *d[2:]) for d in data], SCHEMA))


def test_repeated_rows_count_as_rows(spark):
    data = rows(3, 30)
    df = spark.createDataFrame(data, SCHEMA)
    assert result(df.unionByName(df)) == brute(data + data, lambda i: i % 10 == 0)


def test_empty_tables(spark):
    df = spark.createDataFrame(rows(3, 5), SCHEMA)
    assert result(df.limit(0)) == [] == result(df, "false")
    assert mine(df.limit(0), F.lit(True)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
