"""Similarity joins and greedy clusters against the plain rules."""

import random

import pytest

from prismfold.operators import similarity as sim
from prismfold.operators.similarity import greedy_stars, similar_pairs, token_join


def save(df):
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def sets(seed, n, first=0):
    """Word sets of unlike sizes around a few bases, with words that nearly all share."""
    r = random.Random(seed)
    bases = [[f"w{r.randrange(60)}" for _ in range(r.randrange(1, 16))] for _ in range(12)]
    out = {}
    for i in range(n):
        words = {w for w in r.choice(bases) if r.random() > 0.1} | {f"w{r.randrange(60)}" for _ in range(r.randrange(3))} | ({"hot"} if r.random() < 0.9 else set())
        out[first + i] = sorted(words)
    return out


def similarity(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 0


@pytest.mark.parametrize("threshold, hot", [(0.5, 10_000), (0.7, 5), (0.9, 10_000), (1.0, 5)])
def test_joins_find_all_pairs(spark, monkeypatch, threshold, hot):
    monkeypatch.setattr(sim, "HOT", hot)
    x, y = sets(1, 120) | {900: []}, sets(2, 90, 500) | {901: []}
    a, b = (spark.createDataFrame(list(d.items()), "id long, tokens array<string>") for d in (x, y))
    got = {(r.left_id, r.right_id): round(r.score, 9) for r in token_join(a, b, threshold).collect()}
    assert got == {(i, j): round(s, 9) for i, s_ in x.items() for j, t in y.items() if s_ and t and (s := similarity(s_, t)) >= threshold}
    own = [(r.a, r.b) for r in similar_pairs(a, threshold).collect()]
    assert len(own) == len(set(own)) and set(own) == {(i, j) for i in x for j in x if i < j and x[i] and similarity(x[i], x[j]) >= threshold}
    assert similar_pairs(a.limit(0), threshold).count() == 0


def in_order(edges):
    near, seed = {}, {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    for x in sorted({x for e in edges for x in e}):
        if x not in seed:
            seed[x] = x
            for y in near.get(x, ()):
                seed.setdefault(y, x)
    return seed


@pytest.mark.parametrize("one_task", [200_000, 7, 40])
def test_greedy_stars_equal_the_sequential_rule(spark, monkeypatch, one_task):
    monkeypatch.setattr(sim, "ONE_TASK", one_task)
    r = random.Random(3)
    graphs = [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [tuple(sorted(r.sample(range(50), 2))) for _ in range(150)], [(i, j) for i in range(12) for j in range(i + 1, 12)], [(59 - i - 1, 59 - i) for i in range(59)]]
    for edges in graphs:
        df = spark.createDataFrame(edges, "a long, b long").repartition(3)
        assert {x.id: x.seed for x in greedy_stars(df, save).collect()} == in_order(set(edges))
    names = spark.createDataFrame([(f"n{a:03d}", f"n{b:03d}") for a, b in graphs[2]], "a string, b string")
    assert {x.id: x.seed for x in greedy_stars(names, save).collect()} == in_order({(f"n{a:03d}", f"n{b:03d}") for a, b in graphs[2]})
    assert greedy_stars(spark.createDataFrame([], "a long, b long"), save).count() == 0


def test_a_component_of_a_hundred_thousand_names(spark, monkeypatch):
    """A chain in id order, the longest dependency there is, over several ranges, beside random links."""
    monkeypatch.setattr(sim, "ONE_TASK", 50_000)
    r = random.Random(4)
    edges = {(i, i + 1) for i in range(99_999)} | {tuple(sorted(r.sample(range(100_000), 2))) for _ in range(30_000)}
    df = spark.createDataFrame(sorted(edges), "a long, b long")
    assert {x.id: x.seed for x in greedy_stars(df, save).collect()} == in_order(edges)


@pytest.mark.parametrize("most", [1, 2, 4])
def test_signatures_of_any_width_find_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(sim, "MOST", most)
    x = sets(5, 150)
    df = spark.createDataFrame(list(x.items()), "id long, tokens array<string>")
    for threshold in (0.4, 0.75):
        got = {(r.a, r.b) for r in similar_pairs(df, threshold).collect()}
        assert got == {(i, j) for i in x for j in x if i < j and x[i] and similarity(x[i], x[j]) >= threshold}


def test_names_of_few_words_meet_in_few_pairs(spark, monkeypatch):
    """Eight words a place and six that all share: a single word of each name is in an eighth of all names."""
    x = {i: [f"{p}{(i >> 3 * p) % 8}" for p in range(5)] + list("uvwxyz") for i in (k * 7919 % 32768 for k in range(2000))}
    df = spark.createDataFrame(list(x.items()), "id long, tokens array<string>")
    tried = []
    whole = sim._verified
    monkeypatch.setattr(sim, "_verified", lambda pairs, *rest: tried.append(pairs.count()) or whole(pairs, *rest))
    found = {(r.a, r.b) for r in similar_pairs(df, 0.8).collect()}
    assert found == {(i, j) for i in x for j in x if i < j and sum(p == q for p, q in zip(x[i][:5], x[j][:5])) >= 4}
    assert tried[0] < 10 * len(x)



def test_resolution_broadcasts_nothing_unmeasured(spark, tmp_path):
    from prismfold.plans.resolution import resolve_names

    companies = spark.createDataFrame([(1, "Red Ring Works"), (2, "Blue Bolt Works")], "company_id long, company_name string")
    raw = spark.createDataFrame([(1, "red ring works"), (2, None), (3, "Nobody Knows")], "id long, name string")
    frames = {"raw": raw, "companies": companies, "aliases": spark.createDataFrame([(2, "bb")], "company_id long, alias string")}
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}")
    out = resolve_names(*[spark.read.parquet(f"{tmp_path}/{name}") for name in frames])
    assert "BroadcastHashJoin [name" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin [key" not in plan
    assert {(r.id, r.company_id, r.method) for r in out.collect()} == {(1, 1, "direct"), (2, None, "unresolved"), (3, None, "unresolved")}
