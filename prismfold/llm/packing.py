"""Best-fit packing with conflicts.

Documents become pieces of at most `capacity` words. Pieces are dealt by a hash of their document to shards of a
bounded number of pieces, so a source or cluster with a third of all rows is spread like any other. In a shard,
pieces go from large to small into the tightest bin that has room and no conflict: bins are ordered by their
residual room, each carries a bitmap of its sources and one of its duplicate clusters, and the successor search
goes on from the least sufficient residual until a bin shares no bit with the piece. Where none does, a bin opens.

Defined cases: texts without words (null ones too) have no piece and a null bin; null source and null cluster
never conflict; ties go by id, then piece; repeated rows are of one cluster and so never share a bin; a text of any
length is cut into pieces; other columns of `docs`, of any name, are left out.

By default, equal texts are a cluster. Near copies are one if the caller passes their component as `cluster`, as a
pipeline does that has joined near copies before.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismfold.llm.shared import materialize

CAPACITY = 2048
SHARD_PIECES = 4000


def best_fit(pieces: list[tuple], capacity: int) -> list[int]:
    """The bin of each piece (size, source, cluster); pieces come largest first."""
    open_bins: list[tuple[int, int]] = []  # (residual, bin), in order
    sources: list[int] = []
    clusters: list[int] = []
    bits: dict = {}
    out = []
    for size, source, cluster in pieces:
        s = 0 if source is None else 1 << bits.setdefault((0, source), len(bits))
        c = 0 if cluster is None else 1 << bits.setdefault((1, cluster), len(bits))
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins):
            room, b = open_bins[at]
            if not (sources[b] & s or clusters[b] & c):
                del open_bins[at]
                break
            at += 1
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        if room > size:
            insort(open_bins, (room - size, b))
        out.append(b)
    return out


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster=None, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """id, piece, n_tokens, bin_id and source of every piece. `cluster` is a column expression of the duplicate
    cluster; by default, equal texts are a cluster."""
    cluster = F.md5(F.col(text_col)) if cluster is None else cluster
    words = F.size(F.filter(F.split(F.translate(F.col(text_col), "\t\n\x0b\x0c\r", " " * 5), " "), lambda w: w != ""))
    kind = docs.schema[id_col].dataType.simpleString()
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), cluster.cast("string").alias("cluster"), F.coalesce(F.when(F.col(text_col).isNotNull(), words), F.lit(0)).alias("words"))
    sized = materialize(sized, "pack-sizes")  # words are counted once: the texts are not read again
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("words") - 1) / capacity).cast("int")))))
    pieces = pieces.withColumn("size", F.least(F.lit(capacity), F.col("words") - F.col("piece") * capacity))
    count = sized.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("words") / capacity)))).first()[0] or 0
    shards = max(1, -(-int(count) // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)).cast("int")).repartition("shard")

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (-r[2], r[0] is None, r[0], r[1]))
        full = [r for r in rows if r[2]]
        bins = best_fit([(r[2], r[3], r[4]) for r in full], capacity) + [None] * (len(rows) - len(full))
        ids, piece, size, source, _, shard = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(piece, pa.int32()), pa.array(size, pa.int64()), pa.array([None if b is None else f"{s}-{b}" for s, b in zip(shard, bins)], pa.string()), pa.array(source, pa.string())],
            names=["id", "piece", "n_tokens", "bin_id", "source"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "piece", "size", "source", "cluster", "shard"))):
                if held and row[5] != held[-1][5]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    given = dealt.sortWithinPartitions("shard").select("id", "piece", "size", "source", "cluster", "shard")
    return given.mapInArrow(run, f"id {kind}, piece int, n_tokens long, bin_id string, source string").withColumnRenamed("id", id_col)
