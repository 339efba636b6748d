"""What the operators share: cut points in the shared folder, size-checked broadcasts, words."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as `bytes.split()` has it: the words are `[^\x20\x09-\x0D]+`.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only when its measured size is below this.
BROADCAST_BYTES = 32 << 20

#: Whether Spark deletes a query's shuffle files when it ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a local session takes a temporary one; on a
    cluster that is an error, as executors could not read each other's files."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="prismfold-"))
    return str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage and survives lost executors.

    The job's shuffle files go when it is written, the table's when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, None)
    try:
        spark.conf.set(_CLEAN_UP, "true")
        df.write.partitionBy(*(partition_by or [])).parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before) if before is not None else spark.conf.unset(_CLEAN_UP)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a frame of `materialize` that nothing reads any more."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python in batches of at most `rows`, so that a worker holds few megabytes of a table at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names with as many underscores behind as keep them apart from `columns`."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def broadcast_if_small(df: DataFrame, row_bytes: int | str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if its measured size is within `limit`; else `df`, for a shuffled join.

    `row_bytes` is a fixed width, or the name of a column of which the byte lengths are summed. Call it on a
    materialized frame: it runs a count.
    """
    if isinstance(row_bytes, int):
        size = df.count() * row_bytes
    else:
        size = df.agg(F.sum(F.octet_length(F.col(row_bytes)) + 64)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of the texts of a batch, null as empty; nothing is decoded."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
