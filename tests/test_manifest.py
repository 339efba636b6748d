import os

import pytest
from pyspark.sql import functions as F

from prismfold.sources.catalog import Catalog
from prismfold.sources.manifest import FILES, MANIFEST, ingest, read_files, statuses, summary, watch


def lines(files):
    return files.select("hash", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))


def put(folder, **files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def told(df):
    return {r.path.rsplit("/", 1)[-1]: (r.status, r.fresh) for r in df.collect()}


def test_new_changed_ingested_copies_and_force(spark, tmp_path):
    catalog, source = Catalog(spark, str(tmp_path / "cat")), tmp_path / "in"
    put(source / "fund-a", a="one\ntwo", b="one\ntwo", c="three")
    put(source / "fund-b", d="0", empty="")
    run = lambda name, **more: ingest(catalog, "manifest", read_files(spark, str(source)), name, lines, "lines", **more)
    assert told(run("r1")) == {"a": ("new", True), "b": ("new", False), "c": ("new", True), "d": ("new", True)}
    assert sorted(r.line for r in catalog.table("lines").collect()) == ["0", "one", "three", "two"]
    assert told(run("r2")) == {x: ("ingested", False) for x in "abcd"}
    put(source / "fund-a", c="four")
    put(source / "fund-b", e="three")  # the content that c had
    found = run("r3")
    assert told(found) == {"a": ("ingested", False), "b": ("ingested", False), "c": ("changed", True), "d": ("ingested", False), "e": ("ingested", False)}
    assert sorted(r.line for r in catalog.table("lines").collect()) == ["0", "four", "one", "three", "two"]
    got = {r.folder: (r.tracked, r.ingested, r.changed, r.new) for r in summary(found, catalog.table("manifest")).collect()}
    assert got == {"fund-a": (3, 2, 1, 0), "fund-b": (2, 2, 0, 0)}
    assert told(run("r4", force=True)) == {"a": ("ingested", True), "b": ("ingested", False), "c": ("ingested", True), "d": ("ingested", True), "e": ("ingested", True)}
    assert catalog.table("lines").count() == 5 and catalog.table("manifest").filter("run = 'r4'").count() == 5
    assert catalog.table("manifest").count() == 6  # c with two contents


def test_stream_goes_on_after_a_crash_between_its_two_tables(spark, tmp_path, monkeypatch):
    catalog, source, checkpoint = Catalog(spark, str(tmp_path / "cat")), tmp_path / "in", str(tmp_path / "check")
    put(source, a="one", b="two", c="one")
    start = lambda: watch(spark, str(source), catalog, "manifest", checkpoint, lines, "lines", files_per_batch=2)
    with monkeypatch.context() as broken:
        broken.setattr(catalog, "append_new", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            start().awaitTermination()
    assert catalog.exists("lines") and not catalog.exists("manifest")
    for _ in range(2):
        start().awaitTermination()
    assert sorted(r.line for r in catalog.table("lines").collect()) == ["one", "two"]
    put(source, d="two", e="five")
    start().awaitTermination()
    assert sorted(r.line for r in catalog.table("lines").collect()) == ["five", "one", "two"]
    rows = {os.path.basename(r.path): r.parsed for r in catalog.table("manifest").collect()}
    assert rows["d"] is False and rows["e"] is True and len(rows) == 5 and sum(rows.values()) == 3


def test_empty_listing_missing_content_and_repeated_paths(spark):
    none = spark.createDataFrame([], MANIFEST)
    assert statuses(spark.createDataFrame([], FILES), none).count() == 0
    files = spark.createDataFrame([("x/a", None, 0, None), ("x/b", None, 0, bytearray()), ("x/b", None, 0, bytearray())], FILES)
    assert sorted((r.path, r.fresh) for r in statuses(files, none).collect()) == [("x/a", True), ("x/b", False), ("x/b", False)]
