"""Ingest of files by content: a manifest table of what was seen, statuses against it, runs that can be repeated.

The manifest has a row for each path and content (hash) that was ever seen: path, hash, length, modified, run, and whether
this file was the one that was parsed for its content (`parsed`). It is the only state: a run writes the parsed rows first and the
manifest after, both by key, so that a run which ends between the two gives the same tables when it is started again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prismfold.sources.catalog import Catalog, use_checkpoints

FILES = "path string, modificationTime timestamp, length long, content binary"
MANIFEST = "path string, hash string, length long, modified timestamp, parsed boolean, run string"

#: Makes rows out of files (the columns of FILES and hash); the rows carry the hash of their file.
Parser = Callable[[DataFrame], DataFrame]


def read_files(spark: SparkSession, source: str, glob: str = "*", modified_after: str | None = None) -> DataFrame:
    """The files below a folder, in the columns of FILES; `modified_after` (a time as text) leaves older ones unread. Spark lists no
    files of zero bytes."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return reader.load(source)


def statuses(files: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """path, hash, length, modified, status and fresh of each file.

    status: "ingested" if the content is known under any path, else "changed" if the path is known, else "new".
    fresh: the file is to be parsed: its content is not known, or `force`; of equal contents only the least path is.
    Missing content counts as empty. A path that is listed twice has two rows.
    """
    content = F.coalesce("content", F.lit(b""))
    hashed = files.select("path", F.md5(content).alias("hash"), "length", F.col("modificationTime").alias("modified")).checkpoint()  # each file is read once
    first = hashed.groupBy("hash").agg(F.min("path").alias("first_"))  # merged in the map tasks, however many copies there are
    known = manifest.select("hash", F.lit(True).alias("known_")).distinct()
    paths = manifest.select("path", F.lit(True).alias("seen_")).distinct()
    joined = hashed.join(first.join(known, "hash", "left"), "hash").join(paths, "path", "left")
    status = F.when(F.col("known_"), "ingested").when(F.col("seen_"), "changed").otherwise("new")
    fresh = (F.col("path") == F.col("first_")) & (F.lit(force) | F.col("known_").isNull())
    return joined.select("path", "hash", "length", "modified", status.alias("status"), fresh.alias("fresh"))


def ingest(catalog: Catalog, table: str, files: DataFrame, run: str, parse: Parser | None = None, target: str | None = None, force: bool = False) -> DataFrame:
    """Parse the files whose content is not known into `target`, record all of them in the manifest, and return their statuses.

    Rows of `target` are replaced by hash. With `force` every content is parsed again, once. Rows of a content that a file no longer
    has stay: the manifest tells which hashes a path had.
    """
    use_checkpoints(catalog.spark)
    manifest = catalog.table(table) if catalog.exists(table) else catalog.spark.createDataFrame([], MANIFEST)
    found = statuses(files, manifest, force).checkpoint()
    if parse and target:
        fresh = found.filter("fresh").select("path", "hash").distinct()
        catalog.upsert(target, parse(files.dropDuplicates(["path"]).join(fresh, "path")), ["hash"])
    rows = found.select("path", "hash", "length", "modified", F.col("fresh").alias("parsed"), F.lit(run).alias("run")).dropDuplicates(["path", "hash"])
    if force:
        catalog.upsert(table, rows, ["path", "hash"])
    else:
        catalog.append_new(table, rows, ["path", "hash"])
    return found


def watch(
    spark: SparkSession,
    source: str,
    catalog: Catalog,
    table: str,
    checkpoint: str,
    parse: Parser | None = None,
    target: str | None = None,
    *,
    glob: str = "*",
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """A stream that ingests the files which appear below a folder, in batches of a bounded number.

    It may be stopped and started anywhere: a batch that is run again adds nothing. A stream takes a path once; what was
    changed in place is found by `ingest` over `read_files`.
    """
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    files = stream.option("maxFilesPerTrigger", files_per_batch).load(source)

    def write(batch: DataFrame, number: int) -> None:
        ingest(catalog, table, batch, f"batch-{number}", parse, target)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summary(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """folder, tracked (contents in the manifest), ingested, changed, new (files of `found`), for each folder of either."""
    folder = F.element_at(F.split("path", "/"), -2)
    tracked = manifest.groupBy(F.coalesce(folder, F.lit("")).alias("folder")).agg(F.countDistinct("hash").alias("tracked"))
    now = found.groupBy(F.coalesce(folder, F.lit("")).alias("folder")).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ingested", "changed", "new")])
    return tracked.join(now, "folder", "full").na.fill(0)
