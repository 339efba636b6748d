"""Transactional tables of files: read a version, append, replace, upsert, merge, delete; changes between versions.

A table is a log of commits and folders of data. Each commit names the version it was made from, the files it adds and
those it takes away; its log entry is put in place by one atomic step that fails if the number is taken. So of two writers
that read the same version, one fails or is replayed on the other's result, and no row is lost. An append writes only its
own files; upsert, merge and delete rewrite only the files that hold the rows they touch. Data files are never changed, so
every version can still be read.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismfold.operators.tables import merge_nonnull

#: Commits after which a log entry lists the whole table, so that a reader goes through few entries.
WHOLE_EVERY = 20

#: Times that a write is replayed on the newest version before it gives up.
TRIES = 20

_PART = "write_"


class Conflict(Exception):
    """Another writer published the version that this write was to become."""


def use_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the session names. Without one, a cluster has no folder that all see: that is an
    error; a local session takes a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="prismfold-"))


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share."""
    use_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{label}-{uuid.uuid4().hex}"


@dataclass
class Version:
    """A table's state: its number, schema, partition columns, and live files by folder."""

    number: int
    schema: T.StructType
    partition_by: list[str] = field(default_factory=list)
    files: dict[str, list[str]] = field(default_factory=dict)


class Catalog:
    """Tables below a path that driver and executors share, in any format that Spark writes.

    `replace` fails with Conflict if the table is no longer at the version that this catalog last read of it; the other
    writes are replayed on the newest version. On a local disk a log entry is put in place by a hard link, elsewhere by a
    rename that does not overwrite; both fail if the entry is there.
    """

    def __init__(self, spark: SparkSession, path: str, format: str = "parquet", **options: str):
        self.spark, self.path, self.format, self.options = spark, path.rstrip("/"), format, options
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)
        self._read: dict[str, int] = {}

    # the log

    def _entry(self, name: str, number: int) -> str:
        return f"{self.path}/{name}/log/{number:012d}.json"

    def _numbers(self, name: str) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.path}/{name}/log/*.json"))
        return sorted(int(f.getPath().getName().split(".")[0]) for f in found or [])

    def _load(self, name: str, number: int) -> dict:
        stream = self._fs.open(self._path(self._entry(name, number)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, name: str, number: int, entry: dict) -> None:
        """Put a log entry in place, whole or not at all."""
        folder = f"{self.path}/{name}/log"
        draft, target = f"{folder}/.{uuid.uuid4().hex}", self._entry(name, number)
        self._fs.mkdirs(self._path(folder))
        out = self._fs.create(self._path(draft), True)
        out.write(json.dumps(entry).encode())
        out.close()
        try:
            if self._fs.getScheme() == "file":
                as_file = lambda p: self._jvm.java.io.File(self._fs.makeQualified(self._path(p)).toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(as_file(target), as_file(draft))
            else:
                options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._path(draft), self._path(target), options)
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            raise Conflict(f"{name} already has a version {number}") from None
        finally:
            self._fs.delete(self._path(draft), False)

    def _state(self, name: str, number: int | None = None) -> Version:
        """A version's files: the newest whole list at or before it, and the commits behind that."""
        numbers = [n for n in self._numbers(name) if number is None or n <= number]
        if not numbers or (number is not None and numbers[-1] != number):
            raise FileNotFoundError(f"no table {name} under {self.path}" + (f" at version {number}" if number is not None else ""))
        entries = []
        for n in reversed(numbers):
            entries.append(self._load(name, n))
            if "files" in entries[-1]:
                break
        files: dict[str, list[str]] = {}
        for entry in reversed(entries):
            files = _changed(files, entry)
        return Version(numbers[-1], T.StructType.fromJson(entries[0]["schema"]), entries[0]["partition_by"], files)

    def exists(self, name: str) -> bool:
        return bool(self._numbers(name))

    def version(self, name: str) -> int:
        """The number of the newest version; 0 where there is no table."""
        return max(self._numbers(name), default=0)

    def history(self, name: str) -> DataFrame:
        """version, base, action, files_added, files_removed of each commit."""
        rows = [(n, e["base"], e["action"], sum(map(len, e["add"].values())), sum(map(len, e["remove"].values()))) for n in self._numbers(name) for e in [self._load(name, n)]]
        return self.spark.createDataFrame(rows, "version long, base long, action string, files_added int, files_removed int")

    # reading

    def _data(self, name: str, schema: T.StructType, files: dict[str, list[str]], place: str | None = None) -> DataFrame:
        """The rows of some files, and in column `place` the file of each."""
        if not files:
            df = self.spark.createDataFrame([], schema)
            return df.withColumn(place, F.lit("")) if place else df
        base = f"{self.path}/{name}/data"
        reader = self.spark.read.format(self.format).options(**self.options).option("basePath", base)
        df = reader.schema(T.StructType([*schema.fields, T.StructField(_PART, T.StringType())])).load([f"{base}/{folder}/{f}" for folder, some in files.items() for f in some])
        columns = [F.col(f"`{c}`") for c in schema.fieldNames()]
        return df.select(*columns, *([F.col("_metadata.file_path").alias(place)] if place else []))

    def table(self, name: str, schema: T.StructType | None = None, version: int | None = None, **equals) -> DataFrame:
        """The rows that match `equals`, of the newest version or of another; names of columns that the table lacks are left
        out of account."""
        if not self.exists(name):
            if schema is None:
                raise FileNotFoundError(f"no table {name} under {self.path}")
            self._read[name] = 0
            return self.spark.createDataFrame([], schema)
        state = self._state(name, version)
        if version is None:
            self._read[name] = state.number
        df = self._data(name, schema or state.schema, state.files)
        for column, value in equals.items():
            if column in df.columns:
                df = df.filter(df[column] == value)
        return df

    # writing

    def _write(self, name: str, df: DataFrame, partition_by: list[str]) -> dict[str, list[str]]:
        """Data in a folder of its own, which nobody reads before a commit names it."""
        folder = f"{_PART}={uuid.uuid4().hex}"
        root = f"{self.path}/{name}/data/{folder}"
        df.write.partitionBy(*partition_by).format(self.format).options(**self.options).save(root)
        top, found = self._fs.makeQualified(self._path(root)).toString(), []
        listed = self._fs.listFiles(self._path(root), True)
        while listed.hasNext():
            path = listed.next().getPath()
            if not path.getName().startswith(("_", ".")):
                found.append(path.toString()[len(top) + 1 :])
        return {folder: sorted(found)} if found else {}

    def _commit(self, name: str, base: Version | None, action: str, schema: T.StructType, partition_by: list[str], add: dict, remove: dict, whole: bool = False) -> int:
        number = (base.number if base else 0) + 1
        entry = {"base": number - 1, "action": action, "schema": json.loads(schema.json()), "partition_by": partition_by, "add": add, "remove": remove}
        if whole or base is None or number % WHOLE_EVERY == 0:
            entry["files"] = _changed(base.files if base else {}, entry)
        self._publish(name, number, entry)
        self._read[name] = number
        return number

    def _replayed(self, name: str, attempt: Callable[[Version | None], int]) -> int:
        for _ in range(TRIES):
            try:
                return attempt(self._state(name) if self.exists(name) else None)
            except Conflict:
                continue
        raise Conflict(f"{name} changed {TRIES} times meanwhile")

    def replace(self, name: str, df: DataFrame, partition_by: list[str] | None = None, base: int | None = None) -> int:
        """The table becomes `df`, if it still is at version `base`: by default the one that was last read here."""
        base = self._read.get(name, self.version(name)) if base is None else base
        state = self._state(name, base) if base else None
        by = partition_by or []
        return self._commit(name, state, "replace", df.schema, by, self._write(name, df, by), state.files if state else {}, whole=True)

    def append(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """More rows, dealt as the table is: their files are written once, and added to whichever version is the newest."""
        written: dict[tuple[str, ...], dict] = {}

        def attempt(state: Version | None) -> int:
            by = state.partition_by if state else partition_by or []
            if tuple(by) not in written:
                written[tuple(by)] = self._write(name, df, by)
            return self._commit(name, state, "append", _joined(state.schema, df.schema) if state else df.schema, by, written[tuple(by)], {})

        return self._replayed(name, attempt)

    def rewrite(self, name: str, action: str, touched: Callable[[DataFrame], DataFrame], rewritten: Callable[[DataFrame], DataFrame], schema: T.StructType, partition_by: list[str] | None = None) -> int:
        """Replace the files that hold a row of `touched` by what `rewritten` makes of all their rows, in one commit.

        Without a table, `rewritten` gets no rows of `schema`, and makes the first version, dealt by `partition_by`.
        """

        def attempt(state: Version | None) -> int:
            if state is None:
                by = partition_by or []
                return self._commit(name, None, action, schema, by, self._write(name, rewritten(self.spark.createDataFrame([], schema)), by), {})
            place = "file_"
            rows = touched(self._data(name, state.schema, state.files, place))
            names = (unquote(r[0]) for r in rows.select(place).distinct().collect())  # names of files, not rows
            hit = {n[n.rindex(f"/{_PART}=") + 1 :] for n in names if n}
            old = {folder: own for folder, some in state.files.items() if (own := [f for f in some if f"{folder}/{f}" in hit])}
            out = rewritten(self._data(name, state.schema, old))
            return self._commit(name, state, action, state.schema, state.partition_by, self._write(name, out, state.partition_by), old)

        return self._replayed(name, attempt)

    def upsert(self, name: str, df: DataFrame, keys: list[str]) -> int:
        """Rows of `df` replace those with their keys whole: columns that `df` lacks become null."""
        mine = df.select(*keys).distinct()
        return self.rewrite(
            name, "upsert", lambda old: old.join(mine, keys, "left_semi"), lambda old: old.join(mine, keys, "left_anti").unionByName(df, allowMissingColumns=True).select(*(old.columns or df.columns)), df.schema
        )

    def merge(self, name: str, df: DataFrame, keys: list[str], protect: dict | None = None) -> int:
        """Values of `df` win where they are not null; a column in `protect` keeps an old value that is listed."""
        mine = df.select(*keys).distinct()
        return self.rewrite(name, "merge", lambda old: old.join(mine, keys, "left_semi"), lambda old: merge_nonnull(old, df, keys, protect), df.schema)

    def append_new(self, name: str, df: DataFrame, keys: list[str]) -> int:
        """The rows of `df` whose keys the table lacks, one for each key: to append the same rows again adds none."""

        def fresh(old: DataFrame) -> DataFrame:
            return df.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*df.columns)

        def attempt(state: Version | None) -> int:
            by = state.partition_by if state else []
            rows = fresh(self._data(name, state.schema, state.files)) if state else df.dropDuplicates(keys)
            return self._commit(name, state, "append", _joined(state.schema, df.schema) if state else df.schema, by, self._write(name, rows, by), {})

        return self._replayed(name, attempt)

    def delete(self, name: str, where: Column) -> int:
        """Rows for which `where` holds go; null counts as not."""
        keep = ~F.coalesce(where, F.lit(False))
        return self.rewrite(name, "delete", lambda old: old.filter(~keep), lambda old: old.filter(keep), self._state(name).schema)

    # changes

    def changes(self, name: str, since: int, until: int | None = None, keys: list[str] | None = None) -> DataFrame:
        """change (insert, update or delete), the keys, and structs before and after, of rows that differ between two
        versions (0: the empty table). Only files that are in one of them alone are read.

        Without keys, or where a key is repeated, equal rows cancel out one by one, and there are no updates.
        """
        new = self._state(name, until)
        old = self._state(name, since) if since else Version(0, new.schema)
        columns = new.schema.fieldNames()
        sides = []
        for state, other, sign in ((old, new, -1), (new, old, 1)):
            own = {folder: [f for f in some if f not in set(other.files.get(folder, ()))] for folder, some in state.files.items()}
            rows = self._data(name, state.schema, {folder: some for folder, some in own.items() if some})
            missing = [F.lit(None).cast(new.schema[c].dataType).alias(c) for c in columns if c not in rows.columns]
            sides.append(rows.select("*", *missing).select(*columns, F.lit(sign).alias("sign_")))
        # equal rows on both sides, those that were merely rewritten, cancel out
        left = sides[0].unionByName(sides[1]).groupBy(*columns).agg(F.sum("sign_").alias("n_")).filter("n_ <> 0")
        row = F.struct(*columns)
        flat = left.withColumn("row_", row).withColumn("copy_", F.explode(F.sequence(F.lit(1), F.abs("n_"))))
        if not keys:
            change = F.when(F.col("n_") > 0, "insert").otherwise("delete")
            return flat.select(change.alias("change"), F.when(F.col("n_") < 0, F.col("row_")).alias("before"), F.when(F.col("n_") > 0, F.col("row_")).alias("after"))
        both = flat.groupBy(*keys).agg(
            F.sum(F.when(F.col("n_") < 0, 1).otherwise(0)).alias("gone_"), F.sum(F.when(F.col("n_") > 0, 1).otherwise(0)).alias("come_"),
            F.first(F.when(F.col("n_") < 0, F.col("row_")), ignorenulls=True).alias("before"), F.first(F.when(F.col("n_") > 0, F.col("row_")), ignorenulls=True).alias("after"),
        )
        single = both.filter("gone_ <= 1 and come_ <= 1")
        change = F.when(F.col("gone_") == 0, "insert").when(F.col("come_") == 0, "delete").otherwise("update")
        out = single.select(change.alias("change"), *keys, "before", "after")
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        where = same[0]
        for s in same[1:]:
            where = where & s
        repeated = flat.alias("r").join(both.filter("gone_ > 1 or come_ > 1").select(*keys).alias("b"), where, "left_semi")
        change = F.when(F.col("n_") > 0, "insert").otherwise("delete")
        return out.unionByName(repeated.select(change.alias("change"), *keys, F.when(F.col("n_") < 0, F.col("row_")).alias("before"), F.when(F.col("n_") > 0, F.col("row_")).alias("after")))


def _changed(files: dict[str, list[str]], entry: dict) -> dict[str, list[str]]:
    """The live files after a log entry."""
    if "files" in entry:
        return entry["files"]
    out = {}
    for folder, some in (files | entry["add"]).items():
        gone = set(entry["remove"].get(folder, ()))
        if kept := [f for f in some if f not in gone]:
            out[folder] = kept
    return out


def _joined(old: T.StructType, new: T.StructType) -> T.StructType:
    """The old columns, and behind them those that only the new rows have."""
    return T.StructType([*old.fields, *[f for f in new.fields if f.name not in old.fieldNames()]])
