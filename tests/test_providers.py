import os

from pyspark.sql import functions as F

from prismfold.plans.providers import ask, batches, map_texts, write_back_classes


def logging_provider(log, fail_on=None, die_on=None):
    """Writes the texts of each call to a file of its own; fails, or takes its worker down, when it first meets a text."""

    def provider(texts, allowed):
        for where, act in ((fail_on, 0), (die_on, 1)):
            mark = os.path.join(log, f"once-{act}")
            if where in texts and not os.path.exists(mark):
                open(mark, "w").close()
                if act:
                    os._exit(1)
                raise TimeoutError("slow")
        number = len(os.listdir(log))
        with open(os.path.join(log, f"{os.getpid()}-{number}-{texts[0]}"), "w") as f:
            f.write("\n".join(texts))
        return [(t.upper(), 2.0) for t in texts]

    return provider


def calls(log):
    return [open(os.path.join(log, n)).read().split("\n") for n in os.listdir(log) if not n.startswith("once")]


def requests(spark, n):
    return spark.range(n).select(F.col("id").alias("key"), F.concat(F.lit("t"), "id").alias("text"), F.array(F.concat(F.lit("T"), "id"), F.lit("X")).alias("allowed"))


def test_each_key_is_asked_once_over_retries_rereads_and_new_runs(spark, tmp_path):
    log, folder = tmp_path / "log", str(tmp_path / "calls")
    log.mkdir()
    told = ask(requests(spark, 95).union(requests(spark, 10)), logging_provider(str(log), fail_on="t50"), folder, pause=0.0, parallel=2)
    for _ in range(2):
        rows = {r.key: (r.answer, r.confidence, r.error) for r in told.collect()}
        assert rows == {i: (f"T{i}", 1.0, None) for i in range(95)}
    asked = [t for c in calls(log) for t in c]
    assert sorted(asked) == sorted(f"t{i}" for i in range(95)) and max(map(len, calls(log))) == 20
    again = ask(requests(spark, 95), lambda texts, allowed: 1 / 0, folder, parallel=3)
    assert again.filter("error is not null").count() == 0


def test_a_lost_worker_repeats_one_batch_at_most(spark, tmp_path):
    log, folder = tmp_path / "log", str(tmp_path / "calls")
    log.mkdir()
    provider = logging_provider(str(log), die_on="t70")
    try:
        ask(requests(spark, 100), provider, folder, parallel=1).collect()
    except Exception:  # local mode does not try a task again: the next run goes on
        pass
    before = [t for c in calls(log) for t in c]
    assert before and "t70" not in before
    rows = ask(requests(spark, 100), provider, folder, parallel=1).collect()
    assert {r.answer for r in rows} == {f"T{i}" for i in range(100)}
    assert sorted(t for c in calls(log) for t in c) == sorted(f"t{i}" for i in range(100))


def test_failures_are_told_and_asked_again(spark, tmp_path):
    folder = str(tmp_path / "calls")
    bad = ask(requests(spark, 25), lambda texts, allowed: [("X", 0.5)], folder, tries=2, pause=0.0).collect()
    assert {(r.answer, r.confidence) for r in bad} == {(None, 0.0)} and all("answers to" in r.error for r in bad)
    good = ask(requests(spark, 25), lambda texts, allowed: [("X" if t != "t3" else "other", 0.5) for t in texts], folder).collect()
    assert {r.key: (r.answer, r.confidence) for r in good} == {i: ("X", 0.5) if i != 3 else (None, 0.0) for i in range(25)}


def test_batches_are_stable_and_bounded(spark):
    pick = lambda df: sorted((r.shard, r.number, [x.key for x in r.requests]) for r in df.collect())
    a = pick(batches(requests(spark, 5000), "key", 20))
    assert a == pick(batches(requests(spark, 5000).repartition(7), "key", 20))
    assert sorted(k for _, _, keys in a for k in keys) == list(range(5000)) and max(len(k) for _, _, k in a) == 20
    assert batches(requests(spark, 0), "key", 20).count() == 0


def test_mapped_texts_and_write_back(spark, tmp_path):
    holdings = spark.createDataFrame([(" Oil ",), ("Oil",), ("oil",), ("",), ("NaN",), (None,), ("Gas",), ("Done",)], "reported_sector string")
    nodes = spark.createDataFrame([("10", "Energy")], "code string, sector string")
    answers = {"Oil": ("10", 0.7), "oil": ("99", 0.7), "Gas": (None, 0.2)}
    got = map_texts(holdings, spark.createDataFrame([("Done",)], "reported_sector string"), nodes, lambda texts, _: [answers[t] for t in texts], str(tmp_path / "c"))
    rows = {r.reported_sector: (r.code, r.sector, r.confidence, r.rationale) for r in got.collect()}
    assert rows == {"Oil": ("10", "Energy", 0.7, None), "oil": (None, None, 0.0, "Invalid code returned: 99"), "Gas": (None, None, 0.0, "Invalid code returned: none")}
    companies = spark.createDataFrame([(1, "S", "I", "n"), (2, "S", None, None), (3, None, None, None)], "company_id long, primary_sector string, primary_industry string, industry_node_id string")
    classified = spark.createDataFrame([(1, "industry", "a", 0.2), (1, "industry", "b", 0.9), (2, "industry", "?", 1.0), (3, "sector", "a", 1.0)], "company_id long, taxonomy_type string, node_id string, confidence double")
    tree = spark.createDataFrame([("a", "A", "SA"), ("b", "B", "SB"), ("?", "U", "U")], "node_id string, industry string, sector string")
    back = {r[0]: tuple(r[1:]) for r in write_back_classes(companies, classified, tree, "?").collect()}
    assert back == {1: ("SB", "B", "b"), 2: ("S", None, None), 3: (None, None, None)}
