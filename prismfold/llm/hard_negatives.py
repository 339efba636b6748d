"""Hard negatives for contrastive training: blocked matrix products of anchors and all rows, in two passes.

Blocks of anchors of a bounded size go to every task, which multiplies them with its own rows, block by block. The
products are of whole numbers, in float64, and exact: a block whose norms could lead to 2**53 is multiplied in Python's
integers instead. The first pass keeps each anchor's best rows of its own label, the second the best rows of other labels
whose score lies in the window of each positive. A task keeps k rows for each anchor (and positive), whatever it reads; the
tasks' lists are merged by a ranked window, which Spark limits before it shuffles. Where the anchors are more than one
block of ANCHOR_BYTES, the rows are read once more for each: the products outweigh the reading by far.

Rows with a null id, label or vector, or with a component that is null or not finite, take no part. Vectors of unlike
lengths are not compared; a vector of length 0 has the score 0 with its like. Repeated rows count as rows, but a row is
no positive of an anchor with its own id. Ties go to the smaller id. Other columns are left out of account, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismfold.llm.shared import materialize

#: Bytes of the anchors' components that go to the tasks at once.
ANCHOR_BYTES = 16 << 20

#: Rows of anchors and of candidates in one product.
ANCHOR_ROWS, CANDIDATE_ROWS = 512, 4096

#: Products of norms below this have exact sums in float64, in any order of addition.
_EXACT = 2.0**52

_LONG = np.iinfo(np.int64)
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"

Block = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, labels, whole components as float64


def _whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); what float64 cannot hold is made of Python's integers."""
    with np.errstate(over="ignore"):
        out = np.floor(vectors * scale)
    if np.isfinite(out).all():
        return out
    return np.array([[math.floor(x * scale) if abs(x) < 2.0**900 else int(x) * scale for x in row] for row in vectors.tolist()], dtype=object)


def _blocks(batch: pa.RecordBatch, scale: int) -> Iterator[Block]:
    """The valid rows of a batch (id, label, vector), by length of the vector."""
    vectors = batch.column("vector")
    size = np.asarray(vectors.value_lengths().fill_null(-1))
    valid = ~np.asarray(batch.column("id").is_null()) & ~np.asarray(batch.column("label").is_null()) & (size >= 0)
    starts = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])[:-1]
    flat = np.asarray(vectors.flatten().cast(pa.float64()).fill_null(math.nan))
    ids, labels = np.asarray(batch.column("id").fill_null(0)), np.asarray(batch.column("label").fill_null(0))
    for n in np.unique(size[valid]).tolist():
        at = np.flatnonzero(valid & (size == n))
        rows = flat[starts[at][:, None] + np.arange(n)]
        fine = np.isfinite(rows).all(axis=1)
        yield ids[at[fine]], labels[at[fine]], _whole(rows[fine], scale)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two blocks, as 64-bit integers."""
    if a.dtype != object and b.dtype != object and math.sqrt(np.square(a).sum(axis=1).max(initial=0)) * math.sqrt(np.square(b).sum(axis=1).max(initial=0)) < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    out = whole(a).astype(object) @ whole(b).astype(object).T
    if out.size and not _LONG.min <= out.min() <= out.max() <= _LONG.max:
        raise OverflowError("an inner product is beyond 64 bits")
    return out.astype(np.int64)


class _Best:
    """The k best (score, id) of each of n rows so far: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.row, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(n, _LONG.min)

    def offer(self, scores: np.ndarray, valid: np.ndarray, ids: np.ndarray) -> None:
        """Take what is among the best of a block; `scores` and `valid` have a row for each of n."""
        least = self.floor
        if scores.shape[1] > self.k:
            at = scores.shape[1] - self.k
            least = np.maximum(least, np.partition(np.where(valid, scores, _LONG.min), at, axis=1)[:, at])
        row, col = np.nonzero(valid & (scores >= least[:, None]))
        if not row.size:
            return
        row, score, key = np.concatenate([self.row, row]), np.concatenate([self.score, scores[row, col]]), np.concatenate([self.id, ids[col]])
        order = np.lexsort((key, ~score, row))  # ~x falls as x grows, and cannot overflow
        row = row[order]
        rank = np.arange(row.size) - np.searchsorted(row, row)
        keep = rank < self.k
        self.row, self.score, self.id = row[keep], score[order][keep], key[order][keep]
        full = rank[keep] == self.k - 1
        self.floor[self.row[full]] = self.score[full]


def _scan(blocks: Broadcast, scale: int, lists: Callable) -> Callable:
    """A task's pass over its rows: `lists` makes for a block of anchors its (valid, _Best) rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = [(first, block, lists(first, block)) for first, block in blocks.value]
        for batch in batches:
            for ids, labels, rows in _blocks(batch, scale):
                for at in range(0, len(ids), CANDIDATE_ROWS):
                    part = slice(at, at + CANDIDATE_ROWS)
                    for _, (a_ids, a_labels, a_rows), rules in anchors:
                        if a_rows.shape[1] == rows.shape[1]:
                            scores = _products(a_rows, rows[part])
                            same, other = a_labels[:, None] == labels[None, part], a_ids[:, None] != ids[None, part]
                            for valid, best, _ in rules:
                                best.offer(scores, valid(scores, same, other), ids[part])
        for first, (a_ids, _, _), rules in anchors:
            for _, best, rank in rules:
                yield pa.RecordBatch.from_pydict({"anchor": first + best.row, "anchor_id": a_ids[best.row], "positive": np.full(best.row.size, rank, np.int32), "other": best.id, "score": best.score})

    return run


def _first(df: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "other")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _ranges(anchors: DataFrame, row_bytes: int) -> list[tuple[int, int]]:
    """Ranges of anchor numbers that hold at most ANCHOR_BYTES; numbers are dense within each written part."""
    most, out, taken = max(1, ANCHOR_BYTES // row_bytes), [], 0
    for part in anchors.groupBy(F.shiftright("anchor", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        at, end = part.part << 33, (part.part << 33) + part.n
        while at < end:
            step = min(most - taken, end - at) if out else 0
            if step:
                out[-1] = (out[-1][0], at + step)
                at, taken = at + step, taken + step
            else:
                out, taken = [*out, (at, at)], 0
    return out


def _collected(rows: DataFrame, scale: int) -> list[tuple[int, Block]]:
    """The anchors of a range as blocks of ANCHOR_ROWS, each with the number of its first row."""
    out, first = [], 0
    for batch in rows.toArrow().to_batches():
        for ids, labels, whole in _blocks(batch, scale):
            for i in range(0, len(ids), ANCHOR_ROWS):
                part = slice(i, i + ANCHOR_ROWS)
                out.append((first, (ids[part], labels[part], whole[part])))
                first += len(ids[part])
    return out


def mine(
    df: DataFrame, anchors: Column, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each row for which `anchors` holds: its first `positives` rows of the same label, and for each of them the first
    `negatives` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"), anchors.alias("is_anchor"))
    chosen = materialize(rows.filter("is_anchor").select("id", "label", "vector", F.monotonically_increasing_id().alias("anchor")), "negatives-anchors")
    candidates = rows.select("id", "label", "vector")
    width = chosen.agg(F.max(F.size("vector"))).first()[0] or 0
    found = []
    for start, end in _ranges(chosen, 8 * max(1, width)):
        blocks = _collected(chosen.filter(F.col("anchor").between(start, end - 1)), scale)
        if not blocks:
            continue
        sent = spark.sparkContext.broadcast(blocks)

        def own_label(first: int, block: Block) -> list:
            return [(lambda scores, same, other: same & other, _Best(len(block[0]), positives), 0)]

        schema = "anchor long, anchor_id long, positive int, other long, score long"
        best = _first(candidates.mapInArrow(_scan(sent, scale, own_label), schema), positives, "anchor")
        best = materialize(best.select("anchor", F.col("rank").alias("positive"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
        # each anchor's few positives: bounded as the anchors are
        count = sum(len(ids) for _, (ids, _, _) in blocks)
        least, most = np.full((count, positives), 1), np.full((count, positives), 0)  # 1 > 0: no positive of that rank
        for r in best.toLocalIterator():
            bounds = -(-low * r.positive_score // 100), high * r.positive_score // 100
            least[r.anchor, r.positive - 1], most[r.anchor, r.positive - 1] = (min(max(x, _LONG.min), _LONG.max) for x in bounds)
        windows = spark.sparkContext.broadcast((least, most))

        def in_window(first: int, block: Block) -> list:
            rules, n = [], len(block[0])
            for j in range(positives):
                lo, hi = (x[first : first + n, j, None] for x in windows.value)
                if (lo <= hi).any():
                    rules.append((lambda scores, same, other, lo=lo, hi=hi: ~same & (scores >= lo) & (scores <= hi), _Best(n, negatives), j + 1))
            return rules

        hard = _first(candidates.mapInArrow(_scan(sent, scale, in_window), schema), negatives, "anchor", "positive")
        out = hard.join(best, ["anchor", "positive"]).select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        found.append(materialize(out, "negatives"))
        sent.unpersist()
        windows.unpersist()
    result = spark.createDataFrame([], _RESULT)
    for part in found:
        result = result.unionByName(part)
    return result
