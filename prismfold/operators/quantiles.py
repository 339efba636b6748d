"""Exact quantiles of groups of any size: mergeable sketches bound each wanted rank, counts refine it.

A sketch (KLL, 1.4 % rank error at its default size) of each group is merged from the map tasks. Two of its values, a
little below and above the wanted rank, bound a band; one more pass counts the rows below, at and between them and
sketches those between. So a band shrinks by more than ten times a pass, whatever the values are, until a bound is the
value itself or the band holds at most `settle` rows, which are then sorted. What a group keeps between passes are 65
values of the sketch and a few numbers for each rank; no group's values meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismfold.sources.catalog import use_checkpoints

#: Rank error around the wanted rank that a band allows for, at first; it is doubled where the rank lies outside.
MARGIN = 0.03


#: Steps between the values that are taken from a sketch: from the least, 0, to the greatest, STEPS.
STEPS = 64

#: Bands that are sent to each task; more are joined by a shuffle.
FEW = 10_000


def _few(bands: DataFrame) -> DataFrame:
    return F.broadcast(bands) if bands.count() <= FEW else bands


def _steps(value: Column) -> Column:
    """The least value, the greatest, and those at even ranks between, by a sketch; null without values."""
    ranks = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
    return F.when(F.count(value) > 0, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(value), ranks))


def _step(number: Column) -> Column:
    return F.get("steps_", F.least(F.lit(STEPS), F.greatest(F.lit(0), number)).cast("int"))


def _same(groups: list[str]) -> Column:
    out = F.lit(True)
    for g in groups:
        out = out & F.col(f"v.`{g}`").eqNullSafe(F.col(f"b.`{g}`"))
    return out


def _inside() -> Column:
    """Whether a value lies in a band, whose bounds (null: none) are not part of it."""
    low, high = F.col("b.low_"), F.col("b.high_")
    return (low.isNull() | (F.col("v.value_") > low)) & (high.isNull() | (F.col("v.value_") < high))


def _narrowed(values: DataFrame, bands: DataFrame, groups: list[str]) -> DataFrame:
    """The bands after one pass: with their value, if a bound is the one, else smaller, else with a doubled margin."""
    middle = (F.col("place_") - F.col("below_") + 0.5) / F.col("inside_")
    tried = bands.withColumns({"from_": _step(F.floor((middle - F.col("margin_")) * STEPS)), "to_": _step(F.ceil((middle + F.col("margin_")) * STEPS))})
    rows = values.alias("v").join(_few(tried.drop("steps_")).alias("b"), _same(groups) & _inside())
    value, low, high = F.col("v.value_"), F.col("b.from_"), F.col("b.to_")
    between = (value > low) & (value < high)
    sums = rows.groupBy(*[F.col(f"b.`{g}`") for g in groups], F.col("b.place_").alias("spot_")).agg(
        F.count_if(value < low).alias("under_"), F.count_if(value == low).alias("at_low_"), F.count_if(between).alias("between_"),
        F.count_if((value == high) & (high > low)).alias("at_high_"), _steps(F.when(between, value)).alias("new_steps_"),
    )
    same = F.col("b.place_") == F.col("v.spot_")
    out = tried.alias("b").join(sums.alias("v"), _same(groups) & same)
    start = F.col("place_") - F.col("below_") - F.col("under_")  # place among the rows from the low bound on
    is_low = (start >= 0) & (start < F.col("at_low_"))
    within = (start >= F.col("at_low_")) & (start < F.col("at_low_") + F.col("between_"))
    is_high = (start >= F.col("at_low_") + F.col("between_")) & (start < F.col("at_low_") + F.col("between_") + F.col("at_high_"))
    pick = lambda new, old: F.when(within, F.col(new)).otherwise(F.col(old))
    return out.select(
        *[F.col(f"b.`{g}`") for g in groups],
        F.col("b.place_"),
        F.when(is_low, F.col("from_")).when(is_high, F.col("to_")).alias("value_"),
        pick("from_", "low_").alias("low_"),
        pick("to_", "high_").alias("high_"),
        F.when(within, F.col("below_") + F.col("under_") + F.col("at_low_")).otherwise(F.col("below_")).alias("below_"),
        pick("between_", "inside_").alias("inside_"),
        pick("new_steps_", "steps_").alias("steps_"),
        F.when(within, F.lit(MARGIN)).otherwise(F.col("margin_") * 2).alias("margin_"),
    )


def exact_quantiles(df: DataFrame, groups: list[str], value: str, fractions: dict[str, float], settle: int = 100_000) -> DataFrame:
    """The group columns, n (values), and for each name of `fractions` the interpolated quantile of `value` as a double.

    Nulls and NaN are not counted; a group without any value has no row; null is a group. Equal values and few distinct
    values need no special care: a bound that is the value ends the search.
    """
    spark = df.sparkSession
    use_checkpoints(spark)
    values = df.select(*groups, F.col(f"`{value}`").cast("double").alias("value_")).filter("value_ is not null and not isnan(value_)")
    if not groups:
        values, one = values.withColumn("group_", F.lit(0)), ["group_"]
        return exact_quantiles(values, one, "value_", fractions, settle).drop("group_")
    whole = values.groupBy(*groups).agg(F.count("*").alias("inside_"), _steps(F.col("value_")).alias("steps_")).checkpoint()
    rank = lambda f: F.col("inside_").cast("double") * f - f
    places = [g(rank(f)).cast("long") for f in fractions.values() for g in (F.floor, F.ceil)]
    none = F.lit(None).cast("double")
    bands = whole.withColumn("place_", F.explode(F.array_distinct(F.array(*places)))).select(
        *groups, "place_", none.alias("value_"), none.alias("low_"), none.alias("high_"), F.lit(0).cast("long").alias("below_"), "inside_", "steps_", F.lit(MARGIN).alias("margin_")
    )
    settled = []
    while True:
        is_open = F.col("value_").isNull() & (F.col("inside_") > settle)
        settled.append(bands.filter(~is_open).drop("steps_", "margin_"))
        bands = bands.filter(is_open)
        if bands.isEmpty():
            break
        bands = _narrowed(values, bands, groups).checkpoint()
    done = settled[0]
    for more in settled[1:]:
        done = done.unionByName(more)
    # what is left of a band is counted by value; its groups hold at most `settle` rows
    left = done.filter("value_ is null").drop("value_")
    counted = values.alias("v").join(_few(left).alias("b"), _same(groups) & _inside()).groupBy(*[F.col(f"b.`{g}`") for g in groups], "place_", "below_", "v.value_").agg(F.count("*").alias("n_"))
    listed = counted.groupBy(*groups, "place_", "below_").agg(F.array_sort(F.collect_list(F.struct("value_", "n_"))).alias("list_"))
    empty = F.struct(F.col("below_").alias("sum"), none.alias("found"))

    def step(state: Column, item: Column) -> Column:
        upto = state["sum"] + item["n_"]
        found = F.when(state["found"].isNull() & (upto > F.col("place_")), item["value_"]).otherwise(state["found"])
        return F.struct(upto.alias("sum"), found.alias("found"))

    told = listed.select(*groups, "place_", F.aggregate("list_", empty, step)["found"].alias("value_"))
    every = done.filter("value_ is not null").select(*groups, "place_", "value_").unionByName(told)
    by_group = every.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("place_", "value_"))).alias("map_"))
    out = whole.alias("v").join(by_group.alias("b"), _same(groups)).select(*[F.col(f"v.`{g}`") for g in groups], "inside_", "map_")

    def between(f: float) -> Column:
        low, high = F.element_at("map_", F.floor(rank(f))), F.element_at("map_", F.ceil(rank(f)))
        return low + (high - low) * (rank(f) - F.floor(rank(f)))

    return out.select(*groups, F.col("inside_").alias("n"), *[between(f).alias(name) for name, f in fractions.items()])
