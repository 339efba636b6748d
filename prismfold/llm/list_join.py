"""Links among the members of lists, without all pairs of a list.

A list holds the items that share a token. A round joins each list to one pivot and verifies one pair of each
item; links close to components. Items of one component need no more comparison among themselves, so only
lists that still hold two components go on. When the pairs across components are few, or after the last round,
they are joined in blocks: a list is cut by hash into blocks of about BLOCK members, and each pair of blocks is dealt
out by itself, so that no task takes a whole hot list. Every pair in a list is verified or lies within a component, so
no component is split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismfold.llm.components import connected_components
from prismfold.llm.shared import broadcast_if_small, drop_materialized, materialize

#: Members of a block of the last join.
BLOCK = 1000


def _blocks(now: DataFrame, label: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Both sides of the last join: the tokens of lists over `block` members become one for each pair of blocks.

    Equal new tokens of unlike lists would only bring pairs that are verified in vain.
    """
    hot = now.groupBy("token").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("blocks > 1")
    hot = materialize(hot, f"{label}-hot")
    dealt = now.join(broadcast_if_small(hot, 16), "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    every = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = []
    for first, second in (("own", "other"), ("other", "own")):
        token = F.when(F.col("blocks") == 1, F.col("token")).otherwise(F.xxhash64("token", first, second))
        sides.append(every.withColumn("token", token).drop("blocks", "own", "other"))
    return sides[0], sides[1]


def link_in_lists(lists: DataFrame, candidates: Callable, verify: Callable, label: str, rounds: int, rest_factor: int, links: DataFrame | None = None, block: int = BLOCK, native: bool = False, owned: bool = False) -> DataFrame | None:
    """The links (a, b) found, with those given; None if none are given and no list has two items.

    `lists` has token, doc and what else `candidates(left, right, across)` needs, which returns pairs (x of left,
    y of right) of entries of one list whose components satisfy `across`, repeats included, and `need`, in how many
    lists a pair must meet at least if it is to link. `verify(pairs)` returns those that link, materialized. If `owned`,
    `lists` is a materialized table that is deleted once it has been read.
    """
    given = lists
    support = lists.groupBy("doc").agg(F.count("*").alias("support"))
    lists = materialize(lists.join(support, "doc"), f"{label}-lists")
    if owned:
        drop_materialized(given)
    for turn in range(rounds + 1):
        now = lists
        if links is not None:
            known = connected_components(links, "a", "b", f"{label}-components", native=native)
            now = now.join(known.withColumnRenamed("id", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
            spread = now.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("token")
            now = materialize(now.join(spread, "token", "left_semi"), f"{label}-open")
        else:  # all lists are open: no copy
            now = now.withColumn("component", F.col("doc"))
        opened = now if links is not None else None
        size = now.groupBy("token", "component").agg(F.count("*").alias("k")).groupBy("token").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"))
        entries, pairs_left = size.agg(F.sum("k"), F.sum((F.col("k") * F.col("k") - F.col("kk")) / 2)).first()
        if not entries:
            break
        last = turn == rounds or pairs_left <= rest_factor * entries
        if last:
            pairs = candidates(*_blocks(now, label, block), lambda x, y: x < y)
            pairs = pairs.groupBy("x", "y").agg(F.count("*").alias("shared"), F.max("need").alias("need")).filter("shared >= need")
            pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        else:  # first the item in most lists; later, the one of a component dealt by turns
            chosen = F.struct(F.pmod(F.xxhash64("component", F.lit(turn)), F.lit(1 if turn == 0 else 1 << 20)), "support", F.xxhash64("doc", F.lit(turn)))
            rest = [c for c in now.columns if c != "token"]
            pivots = now.groupBy("token").agg(F.max_by(F.struct(*rest), chosen).alias("p")).select("token", "p.*")
            pairs = candidates(pivots, now, lambda x, y: x != y).groupBy("x", "y").agg(F.count("*").alias("shared"))
            # an item meets one pivot a round, the one it shares most lists with
            pairs = pairs.groupBy(F.col("y").alias("b")).agg(F.max_by("x", F.struct("shared", "x")).alias("a")).select("a", "b")
        found = verify(pairs)
        if opened is not None:
            drop_materialized(opened)
        links = found if links is None else links.unionByName(found)
        if last:
            break
    drop_materialized(lists)
    return links
