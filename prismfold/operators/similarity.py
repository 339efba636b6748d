"""Similarity joins on word sets, and greedy clusters of what they link."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismfold.sources.catalog import use_checkpoints

#: Right rows of a signature that one task takes; more are dealt to several.
HOT = 10_000

#: Edges that one task settles.
ONE_TASK = 200_000

#: Words of a signature at the most.
MOST = 4

#: Signatures and pairs of them that one task takes.
TASK_PAIRS = 1_000_000

#: A counted frame of at most so many rows is broadcast.
FEW = 200_000

_EPS = 1e-9


def _least(size: Column, share: float) -> Column:
    """The least whole number that is `share` of a size."""
    return F.ceil(size * F.lit(share) - F.lit(_EPS)).cast("int")


def _joinable(df: DataFrame) -> DataFrame:
    """A stored frame for the right side of a join: broadcast if it has few rows, else merged. Estimates by the size of
    compressed files would broadcast what a driver cannot hold."""
    return F.broadcast(df) if df.count() <= FEW else df.hint("merge")


def _counts(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.explode("tokens").alias("w")).groupBy("w").agg(F.count("*").alias(name))


def _sets(df: DataFrame, order: DataFrame) -> DataFrame:
    """id, size, words from the rarest to the most frequent, and lone: how many of them, all in front, no other set can share."""
    words = df.select("id", F.explode("tokens").alias("w")).join(_joinable(order), "w", "left")
    sets = words.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "w"))).alias("s"))
    lone = F.size(F.filter("s", lambda x: x["f"] == 0))
    return sets.select("id", F.size("s").alias("size"), F.col("s.w").alias("words"), lone.alias("lone")).checkpoint()


def _fronts(sets: DataFrame, share: float, level: int, most: int) -> DataFrame:
    """The sets that have signatures of `level` words, with the words (front) that these are taken from.

    Two sets that share n words have the first k of these among the first size - n + k of either. Where n must reach `most`,
    k is that; pairs of small sets, which need fewer words, meet at the level that they need.
    """
    least = _least(F.col("size"), share)
    wanted = F.col("size") >= level if level == most else (least <= level) & (F.col("size") >= level)
    upto = F.least(F.col("size"), F.col("size") - least + level)
    return sets.filter(wanted).select("id", "size", "lone", F.slice("words", F.col("lone") + 1, F.greatest(upto - F.col("lone"), F.lit(0))).alias("front"))


def _signatures(sets: DataFrame, share: float, most: int, side: str) -> DataFrame:
    """sig, the hash of `most` words at the most, with side_id, side_size, and side_rest: what a pair that has them as its
    first shared words can share."""
    out = None
    for level in range(1, most + 1):
        found = F.transform("front", lambda w, i: F.struct(F.xxhash64(w).alias("sig"), i.alias("at")))
        for _ in range(level - 1):
            longer = lambda x: F.transform(F.slice("front", x["at"] + 2, F.size("front")), lambda w, j: F.struct(F.xxhash64(x["sig"], w).alias("sig"), (x["at"] + 1 + j).alias("at")))
            found = F.flatten(F.transform(found, longer))
        rows = _fronts(sets, share, level, most).select("id", "size", "lone", F.explode(found).alias("p"))
        rest = F.col("size") - 1 - F.col("lone") - F.col("p.at") + level
        rows = rows.select("p.sig", F.col("id").alias(f"{side}_id"), F.col("size").alias(f"{side}_size"), rest.alias(f"{side}_rest"))
        out = rows if out is None else out.unionAll(rows)
    return out


def _n_signatures(sets: DataFrame, share: float, most: int) -> int:
    total = 0
    for level in range(1, most + 1):
        ways = F.lit(1.0)
        for i in range(level):
            ways = ways * (F.size("front") - i) / (i + 1)
        total += _fronts(sets, share, level, most).agg(F.sum(ways)).first()[0] or 0
    return int(total)


def _candidates(a: DataFrame, b: DataFrame, shares: tuple[float, float], threshold: float, which: Column | None = None) -> DataFrame:
    """left_id and right_id of the pairs of sets that share a signature and may share enough.

    Signatures of one word are few, but those of frequent words meet in many pairs; each word more makes more of them and
    fewer pairs. As many words are taken as keep both together least, by exact counts. A frequent signature's left rows are
    dealt to as many keys as keep its right rows from meeting all of them in one task.
    """
    best = None
    for most in range(1, MOST + 1):
        rows = _n_signatures(a, shares[0], most) + _n_signatures(b, shares[1], most)
        if best and rows >= best[0]:
            break
        left, right = _signatures(a, shares[0], most, "left"), _signatures(b, shares[1], most, "right")
        met = left.groupBy("sig").agg(F.count("*").alias("n_")).join(right.groupBy("sig").agg(F.count("*").alias("m_")).hint("merge"), "sig").checkpoint()
        pairs = met.agg(F.sum(F.col("n_") * F.col("m_"))).first()[0] or 0
        if best and rows + pairs >= best[0]:
            break
        best = rows + pairs, left, right, met
        if pairs <= rows:
            break
    cost, left, right, met = best
    # at most a row for each HOT right rows
    hot = F.broadcast(met.filter(F.col("m_") > HOT).select("sig", (F.col("m_") / HOT).cast("long").alias("more")))
    parts = F.coalesce("more", F.lit(0)) + 1
    tasks = max(a.sparkSession.sparkContext.defaultParallelism, min(5000, -(-cost // TASK_PAIRS)))
    left = left.join(hot, "sig", "left").withColumn("salt", F.pmod(F.xxhash64("left_id"), parts)).drop("more").repartition(tasks, "sig", "salt")
    right = right.join(hot, "sig", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("more").repartition(tasks, "sig", "salt")
    needed = F.ceil((F.col("left_size") + F.col("right_size")) * F.lit(threshold / (1 + threshold)) - F.lit(_EPS))
    enough = F.least("left_rest", "right_rest") >= needed
    sizes = (F.col("left_size") >= _least(F.col("right_size"), threshold)) & (F.col("right_size") >= _least(F.col("left_size"), threshold))
    pairs = left.join(right.hint("merge"), ["sig", "salt"]).filter(sizes & enough & (which if which is not None else F.lit(True)))
    return pairs.select("left_id", "right_id").distinct()


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sets, fetched by id, reach the threshold."""
    l, r = (x.select(F.col("id").alias(f"{side}_id"), F.col("words").alias(side)).hint("merge") for x, side in ((left, "left"), (right, "right")))
    both = pairs.join(l, "left_id").join(r, "right_id")
    common = F.size(F.array_intersect("left", "right"))
    score = common / (F.size("left") + F.size("right") - common)
    return both.select("left_id", "right_id", score.alias("score")).filter(F.col("score") >= threshold - _EPS)


def token_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """left_id, right_id and score of all pairs (id, tokens) whose Jaccard similarity reaches the threshold.

    An inverted index instead of a nested loop: rare-first signatures are joined, sizes and places bound the pairs, and the
    sets of those that remain are fetched by id and compared. Ids are unique on each side; empty sets are similar to nothing.
    """
    use_checkpoints(left.sparkSession)
    left, right = left.select("id", "tokens").checkpoint(), right.select("id", "tokens").checkpoint()
    order = _counts(left, "n_").join(_counts(right, "m_").hint("merge"), "w").select("w", (F.col("n_") + F.col("m_")).alias("f")).checkpoint()
    a, b = _sets(left, order), _sets(right, order)
    return _verified(_candidates(a, b, (threshold, threshold), threshold), a, b, threshold)


def similar_pairs(df: DataFrame, threshold: float) -> DataFrame:
    """a, b and score of all pairs a < b of one table (id, tokens) whose Jaccard similarity reaches the threshold.

    Each pair is met in one direction only, with the smaller set on the left: its front is the shorter one that sets of
    its own size and larger allow.
    """
    use_checkpoints(df.sparkSession)
    df = df.select("id", "tokens").checkpoint()
    sets = _sets(df, _counts(df, "f").filter("f > 1").checkpoint())
    smaller = F.struct("left_size", "left_id") < F.struct("right_size", "right_id")
    found = _verified(_candidates(sets, sets, (2 * threshold / (1 + threshold), threshold), threshold, smaller), sets, sets, threshold)
    return found.select(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"), "score")


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's ids b, in order, those that can be told: claimed if a smaller neighbour is a seed, a seed if all are
    claimed. `a_open` says that a is some edge's b; what is not is a seed. Of an a of an earlier task nothing is known."""
    told: dict = {}
    now, claimed, unsure = None, False, False
    for batch in batches:
        ids, seeds = [], []

        def close() -> None:
            if now is not None and (claimed or not unsure):
                told[now] = not claimed
                ids.append(now)
                seeds.append(not claimed)

        for a, b, a_open in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "a_open"))):
            if b != now:
                close()
                now, claimed, unsure = b, False, False
            state = told.get(a) if a_open else True
            claimed |= state is True
            unsure |= state is None
        kind = batch.schema.field("b").type
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(seeds, pa.bool_())], names=["id", "seed"])
    if now is not None and (claimed or not unsure):
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([not claimed], pa.bool_())], names=["id", "seed"])


def greedy_stars(edges: DataFrame, save) -> DataFrame:
    """id and seed of greedy clusters: in id order, an unclaimed id becomes a seed and claims its unclaimed later neighbours.

    `edges` has a < b. The seeds are the first independent set in id order, which does not need the order to be walked: an
    id is settled as soon as its smaller neighbours are. Each round deals the open edges to tasks by ranges of b; a task
    settles what it can, and the lowest range settles wholly, so there are as many rounds as ranges at the most, however
    long the chains, and usually a few. `save` cuts the lineage of a frame (checkpoint() or a written table).
    """
    edges = save(edges.select("a", "b").distinct())
    kind = edges.schema["a"].dataType.simpleString()
    open_, claimed = edges, None
    while n := open_.count():
        later = open_.select(F.col("b").alias("a")).distinct().withColumn("a_open", F.lit(True))
        marked = open_.join(later, "a", "left").select("a", "b", F.coalesce("a_open", F.lit(False)).alias("a_open"))
        dealt = marked.repartitionByRange(-(-n // ONE_TASK), "b").sortWithinPartitions("b")
        told = save(dealt.mapInArrow(_settle, f"id {kind}, seed boolean"))
        gone = told.filter("not seed").select("id")
        claimed = gone if claimed is None else claimed.unionByName(gone)
        rest = open_.join(told.select(F.col("id").alias("b")), "b", "left_anti").join(gone.select(F.col("id").alias("a")), "a", "left_anti")
        open_ = save(rest.select("a", "b"))
    if claimed is None:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("seed"))
    from_seeds = edges.join(claimed.select(F.col("id").alias("a")), "a", "left_anti")
    stars = from_seeds.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("seed"))
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    return nodes.join(stars, "id", "left").select("id", F.coalesce("seed", "id").alias("seed"))
