"""Lists as a client asks for them: filters, sort keys, counts with fixed keys; rows changed or added by rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def filter_rows(df: DataFrame, equals: dict[str, object], present: dict[str, bool | None] | None = None) -> DataFrame:
    """The rows that match every value given; None asks nothing, and so does a flag of presence that is not true."""
    for column, value in equals.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    for column, wanted in (present or {}).items():
        if wanted:
            df = df.filter(F.col(column).isNotNull())
    return df


def sort_keys(allowed: dict[str, str], asked: str | None, default: str, descending: bool, tie: str) -> list[Column]:
    """The order of a list by a key that a client names: an unknown one takes the default; nulls last, ties by `tie`."""
    column = F.col(allowed.get(asked or "", allowed[default]))
    return [column.desc_nulls_last() if descending else column.asc_nulls_last(), F.col(tie)]


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "high", 1).when(priority == "medium", 2).when(priority == "low", 3).otherwise(4)


def counts_of(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """kind, key and n for every listed key, 0 where no row has it."""
    found = df.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))
    listed = df.sparkSession.createDataFrame([(column, k) for k in keys], "kind string, key string")
    return listed.join(found, "key", "left").select("kind", "key", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def most_common(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values and their counts."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(column).asc_nulls_last()).limit(n)


def contains(column: Column, text: str | None, pattern: bool = False) -> Column:
    """Whether a name holds the text, in any case; as a pattern if asked for. None asks nothing."""
    if text is None:
        return F.lit(True)
    return F.coalesce(column.rlike("(?iu)" + text) if pattern else F.contains(F.lower(column), F.lit(text.lower())), F.lit(False))


def update_where(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """`df` with new values in the rows for which the condition is true."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(df: DataFrame, where: Column) -> DataFrame:
    """The rows for which the condition is not true; those for which it is null stay, as in SQL."""
    return df.filter(~F.coalesce(where, F.lit(False)))


def bootstrap(df: DataFrame, seen: DataFrame, order: Sequence[Column], columns: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Rows of a first load: one for each value of the first column, in `order`, that `seen` lacks, in the columns of the
    table, without rows that miss a required value."""
    key = df.columns[0]
    first = df.withColumn("rank_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("rank_ = 1")
    fresh = first.join(seen.select(F.col(seen.columns[0]).alias(key)), key, "left_anti")
    return fresh.select(*columns).dropna(subset=list(required))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """`df` in the columns and types of a schema: what it lacks is null, what the schema lacks goes."""
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], **params: object) -> DataFrame:
    """SQL over the named frames ({name}) with named parameters (:name); nothing is registered in the session."""
    return spark.sql(sql, args=params, **tables)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, missing: str = "error") -> DataFrame | None:
    """A CSV file with a header. A missing one is an error, an empty frame ("empty", of the schema) or None ("none")."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        if missing == "none":
            return None
        if missing == "empty":
            return spark.createDataFrame([], schema or T.StructType())
        raise FileNotFoundError(path)
    reader = spark.read.option("header", "true")
    return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)
