"""Transactional tables: concurrent writers, files that stay, versions, changes."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from prismfold.sources import catalog as C
from prismfold.sources.catalog import Catalog, Conflict

SCHEMA = "k long, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def test_two_writers_from_one_version(spark, tmp_path):
    """The second to publish fails, and the first one's rows stay."""
    a, b = (Catalog(spark, str(tmp_path)) for _ in range(2))
    a.replace("t", frame(spark, [(1, "x")]))
    read_a, read_b = a.table("t"), b.table("t")
    a.replace("t", read_a.unionByName(frame(spark, [(2, "a")])))
    with pytest.raises(Conflict):
        b.replace("t", read_b.unionByName(frame(spark, [(3, "b")])))
    assert rows(b.table("t")) == [(1, "x"), (2, "a")]
    b.replace("t", b.table("t").unionByName(frame(spark, [(3, "b")])))
    assert rows(a.table("t")) == [(1, "x"), (2, "a"), (3, "b")]
    assert rows(a.table("t", version=1)) == [(1, "x")]


def test_concurrent_appends_and_upserts_lose_nothing(spark, tmp_path):
    Catalog(spark, str(tmp_path)).replace("t", frame(spark, [(i, "start") for i in range(20)]).repartition(4, "k"))

    def write(n):
        catalog = Catalog(spark, str(tmp_path))
        if n % 2:
            catalog.append("t", frame(spark, [(100 + n, f"append{n}")]))
        else:
            catalog.upsert("t", frame(spark, [(n, f"upsert{n}")]), ["k"])

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(write, range(12)))
    catalog = Catalog(spark, str(tmp_path))
    want = {i: "start" for i in range(20)} | {n: f"upsert{n}" for n in range(0, 12, 2)} | {100 + n: f"append{n}" for n in range(1, 12, 2)}
    assert rows(catalog.table("t")) == rows(frame(spark, list(want.items())))
    log = catalog.history("t").orderBy("version").collect()
    assert [r.version for r in log] == list(range(1, 14)) and all(r.base == r.version - 1 for r in log)


def test_only_touched_files_are_rewritten(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    catalog.replace("t", spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("v")).repartitionByRange(10, "k"))
    before = catalog._state("t").files
    catalog.append("t", frame(spark, [(5000, "new")]).coalesce(1))
    catalog.upsert("t", frame(spark, [(7, "seven"), (6000, "far")]).coalesce(1), ["k"])
    catalog.delete("t", F.col("k") == 999)
    log = {r.action: (r.files_added, r.files_removed) for r in catalog.history("t").collect()}
    assert log["append"] == (1, 0) and log["upsert"][1] == 1 and log["delete"][1] == 1
    (folder, files), after = next(iter(before.items())), catalog._state("t").files
    assert len(set(files) & set(after[folder])) == len(files) - 2
    assert catalog.table("t").count() == 1001 and catalog.table("t", k=7).first().v == "seven"


def test_merge_protects_and_new_columns_are_null_before(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    catalog.merge("t", frame(spark, [(1, "manual"), (2, "auto")]), ["k"])
    catalog.merge("t", frame(spark, [(1, "new"), (2, None), (3, "c")]), ["k"], {"v": ["manual"]})
    assert rows(catalog.table("t")) == [(1, "manual"), (2, "auto"), (3, "c")]
    catalog.append("t", spark.createDataFrame([(4, "d", 1.5)], SCHEMA + ", w double"))
    assert rows(catalog.table("t"))[0] == (1, "manual", None) and rows(catalog.table("t"))[-1] == (4, "d", 1.5)
    catalog.upsert("t", frame(spark, [(4, "e")]), ["k"])
    assert rows(catalog.table("t", k=4)) == [(4, "e", None)]


def test_partitions_and_csv(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path), "csv", header="true")
    catalog.replace("t", frame(spark, [(1, "a"), (2, "b: ü/%"), (3, "a")]), partition_by=["v"])
    catalog.append("t", frame(spark, [(4, "b: ü/%")]))
    assert rows(catalog.table("t")) == [(1, "a"), (2, "b: ü/%"), (3, "a"), (4, "b: ü/%")]
    assert rows(catalog.table("t", v="b: ü/%").select("k")) == [(2,), (4,)]
    catalog.delete("t", F.col("k") == 2)
    assert rows(catalog.table("t")) == [(1, "a"), (3, "a"), (4, "b: ü/%")]


def test_many_versions_are_read_from_a_whole_list(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "WHOLE_EVERY", 3)
    catalog = Catalog(spark, str(tmp_path))
    for i in range(8):
        catalog.append("t", frame(spark, [(i, "x")]).coalesce(1))
    assert [catalog.table("t", version=n).count() for n in range(1, 9)] == list(range(1, 9))
    with pytest.raises(FileNotFoundError):
        catalog.table("t", version=9)


@pytest.mark.parametrize("seed", range(3))
def test_changes_turn_one_version_into_another(spark, tmp_path, seed):
    r, catalog = random.Random(seed), Catalog(spark, str(tmp_path))
    catalog.replace("t", frame(spark, [(i, r.choice("ab")) for i in range(30)]).repartition(3))
    catalog.upsert("t", frame(spark, [(i, r.choice("abc")) for i in range(20, 40, 3)]), ["k"])
    catalog.delete("t", F.col("k") % 7 == 0)
    catalog.append("t", frame(spark, [(90, "z"), (91, None)]))
    versions = {n: dict(rows(catalog.table("t", version=n))) for n in range(1, 5)} | {0: {}}
    for since, until in ((0, 1), (1, 4), (2, 3), (0, 4), (4, 4)):
        old, new = versions[since], versions[until]
        want = {("insert", k, None, new[k]) for k in new.keys() - old.keys()} | {("delete", k, old[k], None) for k in old.keys() - new.keys()}
        want |= {("update", k, old[k], new[k]) for k in new.keys() & old.keys() if old[k] != new[k]}
        got = catalog.changes("t", since, until, ["k"])
        assert {(x.change, x.k, x.before and x.before.v, x.after and x.after.v) for x in got.collect()} == want


def test_changes_of_repeated_and_null_keys(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    catalog.replace("t", frame(spark, [(1, "a"), (1, "a"), (1, "b"), (None, "n"), (2, "x")]))
    catalog.replace("t", frame(spark, [(1, "a"), (1, "c"), (None, "m"), (2, "x")]))
    got = sorted((x.change, x.k, x.before and x.before.v, x.after and x.after.v) for x in catalog.changes("t", 1, 2, ["k"]).collect())
    assert got[:2] == [("delete", 1, "a", None), ("delete", 1, "b", None)] and got[2] == ("insert", 1, None, "c")
    assert got[3] == ("update", None, "n", "m") and len(got) == 4
    assert sorted(x.change for x in catalog.changes("t", 1, 2).collect()) == ["delete"] * 3 + ["insert"] * 2
