"""Benchmark decontamination: prefix-filtered set join with exact containment.

A window is `window` consecutive words of a benchmark item (the whole item if it is shorter). A window occurs in
a document only if all of its shingles do, so the necessary prefix of its shingles in order of rarity is one
shingle: the rarest over all documents. Documents are joined to windows on that shingle alone; length and
position bounds follow from its offset, and the words of the window are then compared one by one.

Defined cases: a null or wordless text has no words and is clean; a null or wordless item has no windows; an
item_id that is null is left out; items that share an id count once; repeated documents each give their row.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismfold.llm.shared import free_names, raw_texts, text_batches

#: Benchmark text that one pass over the documents holds on each executor; more text makes more passes.
BLOCK_BYTES = 4 << 20

_LOWER = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z."""
    return text.translate(_LOWER).split()


def grams(words: list[bytes], n: int):
    return zip(*(words[i:] for i in range(n)))


class _Items:
    """The words of a block of benchmark items; windows are places in them, so that no window's words are copied."""

    def __init__(self, rows, window: int):
        self.ids: list[str] = []
        self.words: list[list[bytes]] = []
        known: dict[bytes, bytes] = {}  # each word is held once
        for item_id, text in rows:
            words = words_of((text or "").encode("utf-8", "surrogatepass"))
            if words:
                self.ids.append(str(item_id))
                self.words.append([known.setdefault(w, w) for w in words])
        self.window = window

    def windows(self) -> Iterator[tuple[int, int, int]]:
        """Item, start and size of every window."""
        for item, words in enumerate(self.words):
            size = min(self.window, len(words))
            for start in range(len(words) - size + 1):
                yield item, start, size

    def shingles(self, shingle: int) -> set[tuple]:
        return {g for words in self.words for g in grams(words, min(shingle, self.window, len(words)))}


def _shingle_counts(docs: DataFrame, text_col: str, shingles: set[tuple]) -> dict[tuple, int]:
    """In how many documents each shingle of the block occurs, over all documents."""
    spark = docs.sparkSession
    order = sorted(shingles)
    by_size: dict[int, set] = defaultdict(set)
    for s in order:
        by_size[len(s)].add(s)
    sent = spark.sparkContext.broadcast((dict(by_size), {s: i for i, s in enumerate(order)}))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, number = sent.value
        total: Counter = Counter()
        for batch in batches:
            for text in raw_texts(batch, text_col):
                words = words_of(text)
                for n, some in sizes.items():
                    total.update(some.intersection(grams(words, n)))
        yield pa.RecordBatch.from_pydict(
            {"shingle": pa.array([number[s] for s in total], pa.int64()), "n": pa.array(list(total.values()), pa.int64())}
        )

    rows = docs.select(text_col).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {order[r.shingle]: r.n for r in rows.collect()}


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merge(runs: list[tuple[int, int]]) -> list[dict]:
    merged: list[list[int]] = []
    for start, end in sorted(runs):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [{"start": a, "end": b} for a, b in merged]


def _probe_block(docs: DataFrame, found: DataFrame, text_col: str, rows, window: int, shingle: int, names: list[str]) -> DataFrame:
    """`found` with the hit word runs and items of one benchmark block added to its columns `names` (words, runs, items)."""
    spark = docs.sparkSession
    block = _Items(rows, window)
    counts = _shingle_counts(docs, text_col, block.shingles(shingle))
    index: dict[tuple, list] = defaultdict(list)
    for item, start, size in block.windows():
        words, n = block.words[item], min(shingle, size)
        count, gram, at = min((counts.get(g, 0), g, at) for at, g in enumerate(grams(words[start : start + size], n)))
        if count:  # a window with a shingle that no document has occurs nowhere
            index[gram].append((at, item, start, size))
    by_size: dict[int, set] = defaultdict(set)
    for s in index:
        by_size[len(s)].add(s)
    sent = spark.sparkContext.broadcast((dict(by_size), dict(index), block.words, block.ids))
    n_words_col, runs_col, items_col = names

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, prefix, item_words, ids = sent.value
        for batch in batches:
            n_words, runs, items = [], [], []
            before = zip(batch.column(runs_col).to_pylist(), batch.column(items_col).to_pylist())
            for text, (old_runs, old_items) in zip(raw_texts(batch, text_col), before):
                words = words_of(text)
                hit = [(r["start"], r["end"]) for r in old_runs]
                hit_items = set(old_items)
                for n, some in sizes.items():
                    if some.isdisjoint(grams(words, n)):
                        continue
                    for i, g in enumerate(grams(words, n)):
                        for at, item, first, size in prefix.get(g, ()):
                            start, end = i - at, i - at + size
                            if start >= 0 and end <= len(words) and words[start:end] == item_words[item][first : first + size]:
                                hit.append((start, end))
                                hit_items.add(ids[item])
                n_words.append(len(words))
                runs.append(_merge(hit))
                items.append(sorted(hit_items))
            made = {n_words_col: pa.array(n_words, pa.int64()), runs_col: pa.array(runs, _RUNS), items_col: pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    return found.mapInArrow(probe, found.schema)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shingle: int = 3,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows and columns of `docs` and a struct `contamination`: n_words, n_hit, runs (hit word ranges), items
    (sorted item ids) and contaminated. A column of `docs` of that name is replaced.

    The benchmark is measured first; it is taken in blocks of about `block_bytes` of text, one pass each, so what
    an executor holds is bounded. No text is shuffled.
    """
    text_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    carried = [c for c in docs.columns if c != "contamination"]
    names = free_names(carried, "n_words", "runs", "items")
    n_words, runs, hit_items = names
    found = docs.select(
        *[F.col(f"`{c}`") for c in carried],
        F.coalesce(F.lit(None).cast("long"), F.lit(0)).cast("long").alias(n_words),
        F.coalesce(F.lit(None).cast("array<struct<start:long,end:long>>"), F.array().cast("array<struct<start:long,end:long>>")).alias(runs),
        F.coalesce(F.lit(None).cast("array<string>"), F.array().cast("array<string>")).alias(hit_items),
    )
    for b in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        found = _probe_block(docs, found, text_col, block.collect(), window, shingle, names)
    n_hit = F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    told = F.struct(F.col(n_words).alias("n_words"), n_hit.alias("n_hit"), F.col(runs).alias("runs"), F.col(hit_items).alias("items"), (F.size(runs) > 0).alias("contaminated"))
    return found.select(*[F.col(f"`{c}`") for c in carried], told.alias("contamination"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    told = F.col("contamination")
    return found.select(
        id_col,
        told["n_words"].alias("n_words"),
        told["n_hit"].alias("n_hit"),
        F.size(told["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(told["items"], ","), 256).alias("items_sha256"),
        told["contaminated"].alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`docs` without the documents in which a benchmark window occurs."""
    columns = docs.columns
    return find_contamination(docs, benchmark, **options).filter(~F.col("contamination.contaminated")).select(*[F.col(f"`{c}`") for c in columns])
