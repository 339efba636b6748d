"""N-gram Jaccard join: rare-first prefix filter, then length, positional and suffix filters, one check a pair.

1. One scan gives each document its number of distinct shingles, a 128-bit digest of the set and a histogram of
   its shingles by hash (the signature), and adds up how many documents have a shingle in each of 2**20 hash
   buckets. This fixed-size table is the rarity that orders shingles; ties go by hash, so the order is total and
   the same everywhere, which is all that the prefix filter needs to lose nothing.
2. A second scan emits the prefix of each set, rarest first. A task sends one of several equal sets only; copies
   meet again by their digest and are never paired.
3. Only shingles in two or more different prefixes stay. Their lists are joined in rounds. A round joins each
   list to one pivot (the member in most lists), so it makes as many rows as the lists have; pairs that length and
   position rule out are never made, the others are taken once, and the suffix filter bounds their overlap by their
   signatures. What passes is compared exactly. Members that a round has brought into one component need no more
   comparison among themselves, so a large group of near copies costs rows in proportion to its size. When few
   pairs across components are left, or after `rounds`, the rest is joined in full: no link between components is lost.
4. Links and copies are closed to components by distributed union-find.

Texts are whole. A text with fewer words than a shingle is one shingle; without words the set is empty and links
with nothing. Rows with a null id come back with null component. Rows that share an id count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismfold.llm.components import connected_components
from prismfold.llm.hashing import gram_hashes, mix, word_hashes
from prismfold.llm.list_join import link_in_lists
from prismfold.llm.shared import broadcast_if_small, materialize, raw_texts, text_batches

BUCKET_BITS = 20
SIGNATURE = 256
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
#: Bytes of text in one vectorised step.
CHUNK = 1 << 20


def shingle_sets(values: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    np.seterr(over="ignore")
    at = 0
    while at < len(values):
        size, upto = 0, at
        while upto < len(values) and (size == 0 or size + len(values[upto]) <= CHUNK):
            size += len(values[upto]) + 1
            upto += 1
        group = values[at:upto]
        data = _LOWER[np.frombuffer(b"\n".join(group), np.uint8)] if size > 1 else np.empty(0, np.uint8)
        words, starts = word_hashes(data)
        grams = gram_hashes(words, n)
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(v) + 1 for v in group)]))
        for i, j in zip(bounds[:-1], bounds[1:]):
            if j - i >= n:
                yield np.unique(grams[i : j - n + 1])
            elif j > i:
                yield mix(gram_hashes(words[i:j], j - i) + np.uint64(j - i))
            else:
                yield np.empty(0, np.uint64)
        at = upto


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64).tolist())


def _signature(shingles: np.ndarray) -> bytes:
    """How many shingles have each value of their low hash byte; 255 stands for that many or more."""
    return np.minimum(np.bincount(shingles & np.uint64(SIGNATURE - 1), minlength=SIGNATURE), 255).astype(np.uint8).tobytes()


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """A row for each document (doc, n, d1, d2, signature), and rows with counts of documents by hash bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        empty = 0
        for batch in batches:
            rows = []
            for shingles in shingle_sets(raw_texts(batch, "text"), n):
                np.add.at(total, shingles >> np.uint64(64 - BUCKET_BITS), 1)
                rows.append((shingles.size, *_digest(shingles), _signature(shingles)))
            size, d1, d2, signature = zip(*rows) if rows else ((), (), (), ())
            yield _profile_batch(batch.column("doc"), size, d1, d2, signature, [None] * len(rows), [None] * len(rows))
            empty += len(rows)
        if empty:
            parts = total.astype(np.int64).reshape(64, -1)
            blank = [None] * 64
            yield _profile_batch(pa.array(blank, pa.int64()), blank, blank, blank, blank, list(range(64)), [p.astype(np.uint32).tobytes() for p in parts])

    return docs.mapInArrow(run, "doc long, n long, d1 long, d2 long, signature binary, part int, counts binary")


def _profile_batch(doc, n, d1, d2, signature, part, counts) -> pa.RecordBatch:
    columns = [doc, pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(signature, pa.binary()), pa.array(part, pa.int32()), pa.array(counts, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["doc", "n", "d1", "d2", "signature", "part", "counts"])


def _rarity(profile: DataFrame) -> np.ndarray:
    """Documents by hash bucket: a table of fixed size."""

    def add(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in pairs:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                given = np.frombuffer(counts, np.uint32).astype(np.int64)
                sums[part] = sums[part] + given if part in sums else given
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array(list(sums), pa.int32()), "counts": pa.array([np.minimum(s, 0xFFFFFFFF).astype(np.uint32).tobytes() for s in sums.values()], pa.binary())}
        )

    rows = profile.filter("part is not null").select("part", "counts").repartition("part").mapInArrow(add, "part int, counts binary").collect()
    out = np.zeros((64, (1 << BUCKET_BITS) // 64), np.uint32)
    for row in rows:
        out[row.part] = np.frombuffer(row.counts, np.uint32)
    return out.reshape(-1)


def _prefixes(docs: DataFrame, rarity, n: int, percent: int) -> DataFrame:
    """token, doc, d1, n, at for the prefix of each set; of equal sets in a task, only for the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rarity.value
        seen = set()
        for batch in batches:
            tokens, owners, digests, sizes, places = [], [], [], [], []
            for doc, shingles in zip(batch.column("doc").to_pylist(), shingle_sets(raw_texts(batch, "text"), n)):
                size = shingles.size
                if not size or (digest := _digest(shingles)) in seen:
                    continue
                seen.add(digest)
                length = size - -(-percent * size // 100) + 1
                rare = table[shingles >> np.uint64(64 - BUCKET_BITS)]
                first = shingles[np.lexsort((shingles, rare))[:length]]
                tokens.append(first)
                owners.append(np.full(length, doc, np.int64))
                digests.append(np.full(length, digest[0], np.int64))
                sizes.append(np.full(length, size, np.int32))
                places.append(np.arange(length, dtype=np.int32))
            if tokens:
                columns = [np.concatenate(c) for c in (tokens, owners, digests, sizes, places)]
                columns[0] = columns[0].view(np.int64)
                for i in range(0, columns[0].size, 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 18)]) for c in columns], names=["token", "doc", "d1", "n", "at"])

    return docs.mapInArrow(run, "token long, doc long, d1 long, n int, at int")


def _needed(percent: int, a, b):
    """The least overlap of linked sets with a and b members."""
    return F.ceil(percent * (a + b) / F.lit(100.0 + percent) - F.lit(1e-9))


def _overlap_bound(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures leave room for the overlap they need."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIGNATURE) for c in ("sig_a", "sig_b"))
        full = ((a == 255) & (b == 255)).any(1)
        bound = np.minimum(a, b).sum(1, dtype=np.int64)
        sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        keep = full | (bound * (100 + percent) >= percent * sizes)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))


def _verified(pairs: DataFrame, docs: DataFrame, profile: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    pairs = materialize(pairs, "jaccard-pairs")
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "jaccard-ends")
    told = profile.filter("part is null").join(broadcast_if_small(ends, 16), "doc", "left_semi")
    told = materialize(told.groupBy("doc").agg(F.max(F.struct("n", "signature")).alias("told")), "jaccard-told")
    both = pairs.join(told.select(F.col("doc").alias("a"), F.col("told.n").alias("n_a"), F.col("told.signature").alias("sig_a")), "a")
    both = both.join(told.select(F.col("doc").alias("b"), F.col("told.n").alias("n_b"), F.col("told.signature").alias("sig_b")), "b")
    near = materialize(both.mapInArrow(lambda it: _overlap_bound(it, percent), "a long, b long"), "jaccard-near")
    wanted = materialize(near.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "jaccard-wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.view(np.int64) for s in shingle_sets(raw_texts(batch, "text"), n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([s.tobytes() for s in found], pa.binary())], names=["doc", "shingles"])

    held = docs.join(broadcast_if_small(wanted, 16), "doc", "left_semi").select("doc", "text").mapInArrow(sets, "doc long, shingles binary")
    held = materialize(held.groupBy("doc").agg(F.min("shingles").alias("shingles")), "jaccard-sets")
    both = near.join(held.select(F.col("doc").alias("a"), F.col("shingles").alias("set_a")), "a")
    both = both.join(held.select(F.col("doc").alias("b"), F.col("shingles").alias("set_b")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                common = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * common >= percent * (x.size + y.size - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialize(both.mapInArrow(check, "a long, b long"), "jaccard-links")


def _candidates(left: DataFrame, right: DataFrame, percent: int, across) -> DataFrame:
    """Pairs (x, y) of entries of one list that length and position allow."""
    x = left.select("token", F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"), F.col("component").alias("cx"))
    y = right.select("token", F.col("doc").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"), F.col("component").alias("cy"))
    fits = (
        (x["token"] == y["token"])
        & across(F.col("cx"), F.col("cy"))
        & (F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent)
        # the first shingle that they share, and those behind it, must be enough
        & (F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay")) >= _needed(percent, F.col("nx"), F.col("ny")))
    )
    return x.join(y, fits).select("x", "y", F.lit(1).alias("need"))


def link_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, rounds: int = 2, rest_factor: int = 4) -> DataFrame:
    """id, n_shingles and component_id (the smallest id reachable by links) of every row of `docs`.

    Sets of distinct `shingle`-word shingles link when 100 * intersection >= `percent` * union. Pairs across
    components are joined in full once they are at most `rest_factor` times the list entries.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    given = docs.filter("doc is not null")
    spark = docs.sparkSession
    text_batches(spark)
    profile = materialize(_profile(docs, shingle), "jaccard-profile")
    rarity = spark.sparkContext.broadcast(_rarity(profile))

    # one row for each token and distinct set; then tokens of one set only go
    sent = _prefixes(given, rarity, shingle, percent).repartition("token")
    entries = sent.groupBy("token", "d1").agg(F.min("doc").alias("doc"), F.min("n").alias("n"), F.min("at").alias("at"))
    by_token = Window.partitionBy("token")
    lists = materialize(
        entries.withColumn("size", F.count("*").over(by_token)).filter("size > 1").select("token", "doc", "n", "at"),
        "jaccard-lists",
    )
    links = link_in_lists(
        lists, lambda left, right, across: _candidates(left, right, percent, across), lambda pairs: _verified(pairs, given, profile, shingle, percent), "jaccard", rounds, rest_factor
    )

    members = profile.filter("part is null").select("doc", "n", "d1", "d2")
    groups = members.filter("n > 0 and doc is not null").groupBy("d1", "d2").agg(F.min("doc").alias("first"))
    joined = members.join(groups, ["d1", "d2"], "left")
    if links is not None:
        # an end of a link stands for all copies of its set
        copies = materialize(joined.filter("first is not null and doc <> first").select(F.col("doc").alias("a"), F.col("first").alias("b")), "jaccard-copies")
        known = connected_components(links.unionByName(copies), "a", "b", "jaccard-components")
    else:
        known = connected_components(joined.filter("first is not null").select(F.col("doc").alias("a"), F.col("first").alias("b")), "a", "b", "jaccard-components")
    out = members.join(known, members["doc"] == known["id"], "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one document of each component: the one with the smallest id; rows with a null id stay.

    Of rows that share an id, one stays.
    """
    found = materialize(link_documents(docs, id_col=id_col, text_col=text_col, **options), "jaccard-found")
    gone = materialize(found.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "jaccard-gone")
    kept = docs.join(broadcast_if_small(gone, 16), id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    twice = materialize(found.filter(f"{id_col} is not null").groupBy(id_col).count().filter("count > 1").select(id_col), "jaccard-twice")
    if twice.isEmpty():
        return kept
    few = broadcast_if_small(twice, 16)
    return kept.join(few, id_col, "left_anti").select(*docs.columns).unionByName(kept.join(few, id_col, "left_semi").select(*docs.columns).dropDuplicates([id_col]))
