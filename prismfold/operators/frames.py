"""Frame operators: latest per key, top-n, shares, first and last wins, pages, forward fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismfold.functions.values import share


def with_latest(df: DataFrame, key: str | Sequence[str], date: str) -> DataFrame:
    """The rows at each key's own latest date.

    The dates combine in the map tasks to a row for each key, which is joined back: where the keys are few, adaptive
    execution broadcasts them by their measured size and the facts stay in place; no key's rows meet in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    newest = df.groupBy(*keys).agg(F.max(date).alias(date))
    return df.join(newest, [*keys, date], "left_semi")


def join_dealt(df: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The left join on a key that may be null: such rows, which match nothing, are dealt out instead of meeting in one task."""
    # on the right a zero that is no literal, as that would be taken out of the join's keys
    zero = right.withColumn("deal_", F.pmod(F.xxhash64(key), F.lit(1)))
    dealt = df.withColumn("deal_", F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(4096))).otherwise(F.lit(0)).cast("long"))
    return dealt.join(zero, [key, "deal_"], "left").drop("deal_")


def top_n(df: DataFrame, n: int, by: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(tie).asc_nulls_last()).limit(n)


def top_per_group(df: DataFrame, group: str, n: int, by: str, tie: str) -> DataFrame:
    """The first n rows of each group, with their rank."""
    order = Window.partitionBy(group).orderBy(F.col(by).desc_nulls_last(), F.col(tie).asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def _largest(totals: DataFrame, name: str, value: str, n: int) -> DataFrame:
    return totals.orderBy(F.col(value).desc_nulls_last(), F.col(name)).limit(n).select(name)


def _named_or_other(df: DataFrame, few: DataFrame, name: str) -> DataFrame:
    """`df` with "Other" for each name that is not among the few."""
    told = df.join(F.broadcast(few.withColumn("few_", F.lit(True))), name, "left")
    return told.withColumn(name, F.when(F.col("few_"), F.col(name)).otherwise("Other")).drop("few_")


def top_n_other(totals: DataFrame, name: str, value: str, n: int, skip: str) -> DataFrame:
    """The n largest names, and "Other" for the rest; `skip` is in neither, but in the total that shares are of.

    `totals` has a row for each name. Each task keeps its n largest; those n names alone are broadcast.
    """
    total = totals.agg(F.sum(value).alias("total_"))
    named = totals.filter(F.col(name).isNotNull() & (F.col(name) != skip))
    out = _named_or_other(named, _largest(named, name, value, n), name).groupBy(name).agg(F.sum(value).alias(value))
    return out.join(F.broadcast(total)).withColumn("pct", share(F.col(value), F.col("total_"))).drop("total_")


def joined_total(df: DataFrame, value: Column, over: Sequence[str], name: str) -> DataFrame:
    """`df` with the sum of `value` over the rows with its keys; null keys are a group of their own."""
    totals = df.groupBy(*over).agg(F.sum(value).alias(name)).withColumnsRenamed({k: f"{k}_of_total" for k in over})
    same = [df[k].eqNullSafe(totals[f"{k}_of_total"]) for k in over]
    return df.join(totals, same, "left").drop(*[f"{k}_of_total" for k in over])


def with_share(df: DataFrame, value: str, over: Sequence[str] = (), name: str = "pct", digits: int = 4) -> DataFrame:
    """`df` with each row's share of the total of its group; the total of all rows is one row, sent to each task.

    Totals combine in the map tasks to a row for each group and are joined back, so that no group meets in one task.
    """
    if not over:
        total = df.agg(F.sum(value).alias("total_"))
        return df.join(F.broadcast(total)).withColumn(name, share(F.col(value), F.col("total_"), digits)).drop("total_")
    return joined_total(df, F.col(value), over, "total_").withColumn(name, share(F.col(value), F.col("total_"), digits)).drop("total_")


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in `order`. Reverse the order to let the last win."""
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("rank_ = 1").drop("rank_")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int, most: int = 200) -> DataFrame:
    """Page `number`, from 1, of `size` rows, `most` at the most. The order must be total."""
    size = max(1, min(size, most))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_count(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def forward_fill(df: DataFrame, column: str, group: Sequence[str], order: str) -> DataFrame:
    """Nulls of `column` take the last value before them in their group."""
    window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(window))


def coverage(df: DataFrame, value: str, known: Column, keys: Sequence[str], name: str = "coverage_pct") -> DataFrame:
    """`df` with the share of its group's value that is known, as a fraction; 0 where the group's value is 0."""
    window = Window.partitionBy(*keys)
    part = F.sum(F.when(known, F.col(value)).otherwise(0)).over(window).cast("double")
    return df.withColumn(name, F.coalesce(F.round(F.try_divide(part, F.sum(value).over(window).cast("double")), 6), F.lit(0.0)))


def share_trend(values: DataFrame, date: str, name: str, value: str, n: int = 6) -> DataFrame:
    """Shares by date of the n names with the largest mean share over all dates, and of "Other".

    A missing pair of date and name counts as 0: a name's mean is the sum of its shares over the number of dates.
    """
    sums = values.groupBy(date, name).agg(F.sum(value).alias("v_"))
    totals = sums.groupBy(date).agg(F.sum("v_").alias("t_"))
    shared = sums.join(totals, date).select(date, name, share(F.col("v_"), F.col("t_"), 10).alias("s_"))
    dates = totals.agg(F.count("*").alias("dates_"))
    means = shared.groupBy(name).agg(F.sum("s_").alias("sum_")).join(F.broadcast(dates)).select(name, F.round(F.col("sum_") / F.col("dates_"), 8).alias("m_"))
    labelled = _named_or_other(shared, _largest(means, name, "m_", n), name)
    labels = labelled.select(name).distinct()
    # at most n + 1 labels: each has a row on each date
    every = totals.select(date).join(F.broadcast(labels))
    out = every.join(labelled, [date, name], "left").groupBy(date, name).agg(F.round(F.coalesce(F.sum("s_"), F.lit(0.0)), 4).alias("pct"))
    return out
