"""Table changes as new frames: upsert, merge, protection, retention, contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `new` replace those of `old` whole: columns that `new` lacks become null."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True).select(*old.columns)


def merge_nonnull(old: DataFrame, new: DataFrame, keys: Sequence[str], protect: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Values of `new` win where they are not null; a column in `protect` keeps an old value that is listed."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    out = []
    for c in old.columns:
        value = F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")
        if protect and c in protect:
            value = F.when(F.col(f"o.{c}").isin(*protect[c]), F.col(f"o.{c}")).otherwise(value)
        out.append(value.alias(c))
    return joined.select(*out)


def retain(df: DataFrame, date: str, today: Column, months: int = 24) -> DataFrame:
    """Rows no older than so many calendar months."""
    return df.filter(F.col(date) >= F.add_months(today, -months))


def violations(df: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """id and rule of each row that breaks a contract; null counts as broken. Reporting only."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda r: r.isNotNull())
    return df.select(F.col(id_col), F.explode(broken).alias("rule"))


def duplicated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    from pyspark.sql import Window

    return df.withColumn("n_", F.count("*").over(Window.partitionBy(*keys))).filter("n_ > 1").drop("n_")
