"""Phrase collocations by Apriori level-wise passes.

Level k counts runs of k words within pieces of text. A task emits a run only if both runs of k - 1 words in it are in
the broadcast of the level below, so that what is shuffled follows the frequent phrases and not all runs. The broadcast is
a bitmap of fixed size, with a bit for the hash of each frequent run: it never misses one, and a run that it lets through
by a clash of hashes is dropped by its own count, which is exact. Each task counts its runs before it sends them. The
levels are tables; cuts, scores, the containment rule and the ranks are joins and aggregations of them.

Texts that are null are empty; a null language is "und". Words are of whole texts, split at ASCII marks, line breaks and
blanks; A-Z are lower-cased, other letters are kept. Ties go to the smaller phrase in UTF-8 byte order. Repeated rows
count as rows. Other columns are left out of account, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismfold.llm.shared import drop_materialized, materialize, raw_texts, text_batches

#: Bits of a level's bitmap: 16 MB at the most, whatever the number of frequent runs.
BITS = 1 << 27

#: Bytes of text that a task takes at once, and words and counted runs that it holds before it sends them on.
BYTES, HELD = 1 << 20, 1 << 20

# Where a text is cut into pieces; A-Z in lower case; a tab is a blank.
_MARKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(10 if c in _MARKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK, _CUT = 0, 1

_SEED, _TURN = 42, 21  # the seed of Spark's xxhash64; bits by which a run's hash turns for each word

#: Word numbers below 2**21: three of them in a 64-bit code.
_NUMBER, _PACKED = 21, 3


def _key(lang: Column, phrase: Column, k: int) -> Column:
    """The bit of a run of k words: the hashes of its words, each rotated once more than the one behind it."""
    out = None
    for i in range(k):
        one = F.xxhash64(F.concat_ws("\0", lang, F.get(F.split(phrase, " "), F.lit(i))))
        out = one if out is None else (F.shiftleft(out, _TURN).bitwiseOR(F.shiftrightunsigned(out, 64 - _TURN))).bitwiseXOR(one)
    return F.pmod(out, F.lit(BITS))


def _bitmap(level: DataFrame, k: int) -> Broadcast:
    """The bits of a level's runs of k words, for all tasks."""
    at = level.select((_key(F.col("lang"), F.col("phrase"), k) + 1).alias("at"))
    parts = at.groupBy(F.call_function("bitmap_bucket_number", "at").alias("part")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("at"))).alias("bits"))
    size = 32768 // 8
    whole = np.zeros(BITS // 8, np.uint8)
    for r in parts.toLocalIterator():
        whole[(r.part - 1) * size : r.part * size] = np.frombuffer(r.bits, np.uint8)
    return level.sparkSession.sparkContext.broadcast(whole)


class _Ids(dict):
    """Numbers of words in order of their first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Task:
    """One language's words in a task: numbers, and the counts of runs held until they are sent.

    A run is one code or more, of three word numbers each: equal codes are equal runs.
    """

    def __init__(self, lang: bytes, k: int, bitmaps: list[np.ndarray]):
        self.lang, self.k, self.bitmaps = lang, k, bitmaps
        self.ids = _Ids({b"": _BLANK, b"\n": _CUT})
        self.hashes = np.zeros(0, np.uint64)
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def number(self, texts: list[bytes]) -> np.ndarray:
        """Word numbers of texts that follow each other, with a cut between; blanks are gone."""
        tokens = b"\n".join(texts).translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))
        if self.bitmaps and self.hashes.size < len(self.ids):
            head = self.lang + b"\0"
            fresh = (xxhash.xxh64_intdigest(head + w, _SEED) for w in islice(self.ids, self.hashes.size, None))
            self.hashes = np.concatenate([self.hashes, np.fromiter(fresh, np.uint64)])
        return ids[ids != _BLANK]

    def take(self, texts: list[bytes]) -> None:
        """Count the runs of k words of which every part is frequent."""
        ids = self.number(texts)
        if self.k == 1:
            n = np.bincount(ids, minlength=2)
            n[_CUT] = 0
            code = np.flatnonzero(n)
            return self._hold(code[:, None], n[code])
        # from frequent words to frequent runs: both the run that starts here and the one a word later
        hashes = self.hashes[ids]
        fine, run = _has(self.bitmaps[0], hashes) & (ids != _CUT), hashes
        for width in range(2, self.k + 1):
            fine = fine[:-1] & fine[1:]
            if width < self.k:
                run = (run[:-1] << np.uint64(_TURN) | run[:-1] >> np.uint64(64 - _TURN)) ^ hashes[width - 1 :]
                fine &= _has(self.bitmaps[width - 1], run)
        starts = np.flatnonzero(fine)
        codes = []
        for first in range(0, self.k, _PACKED):
            code = ids[starts + first]
            for i in range(first + 1, min(first + _PACKED, self.k)):
                code = code << _NUMBER | ids[starts + i]
            codes.append(code)
        if len(codes) == 1:
            code, n = np.unique(codes[0], return_counts=True)
            return self._hold(code[:, None], n)
        self._hold(*_summed(np.stack(codes, axis=1), np.ones(starts.size, np.int64)))

    def _hold(self, codes: np.ndarray, n: np.ndarray) -> None:
        self.codes.append(codes)
        self.counts.append(n)

    def held(self) -> int:
        return max(len(self.ids), sum(map(len, self.counts)))

    def flush(self) -> Iterator[pa.RecordBatch]:
        """What is held, equal runs summed."""
        if not self.codes:
            return
        codes, n = _summed(np.concatenate(self.codes), np.concatenate(self.counts))
        words = pa.array(list(self.ids), pa.binary())
        for at in range(0, len(n), 100_000):
            part, columns = codes[at : at + 100_000], []
            for first in range(0, self.k, _PACKED):
                width = min(_PACKED, self.k - first)
                columns += [words.take(pa.array(part[:, first // _PACKED] >> _NUMBER * (width - 1 - i) & (1 << _NUMBER) - 1)) for i in range(width)]
            phrases = (pc.binary_join_element_wise(*columns, b" ") if self.k > 1 else columns[0]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([self.lang.decode()] * len(part), pa.string()), phrases, pa.array(n[at : at + 100_000], pa.int64())], names=["lang", "phrase", "n"])


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * bitmap.size - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of codes and the sums of their counts."""
    order = np.lexsort(codes.T[::-1])
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]).any(axis=1)])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(n, first) if first.size else n


def _parts(texts: Iterable[bytes], most: int, k: int) -> Iterator[list[bytes]]:
    """Texts in lists of bounded length. A very long one is taken by its pieces, between which no run goes, and a very long
    piece by its words, with the next part's first k - 1 words, so that each run is in one part."""
    some, size, step = [], 0, most // 16
    for text in texts:
        for piece in [text] if len(text) <= most else text.translate(_FOLD).split(b"\n"):
            words = piece.translate(_FOLD).split() if len(piece) > most else []
            for part in (b" ".join(words[i : i + step + k - 1]) for i in range(0, len(words), step)) if words else (piece,):
                some.append(part)
                size += len(part) + 1
                if size > most:
                    yield some
                    some, size = [], 0
    yield some


def _runs(k: int, bitmaps: list[Broadcast], size: int, most: int) -> Callable:
    """A task's counts of runs of k words; more than `most` words and runs are sent on and forgotten."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks: dict[bytes, _Task] = {}
        maps = [b.value for b in bitmaps]
        for batch in batches:
            by_lang: dict[bytes, list[bytes]] = {}
            for lang, text in zip(raw_texts(batch, "lang"), raw_texts(batch, "text")):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for some in _parts(texts, size, k):
                    if lang not in tasks:
                        tasks[lang] = _Task(lang, k, maps)
                    tasks[lang].take(some)
                    if sum(t.held() for t in tasks.values()) > most:
                        for t in tasks.values():
                            yield from t.flush()
                        tasks.clear()
        for task in tasks.values():
            yield from task.flush()

    return run


def count_levels(docs: DataFrame, longest: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, list[DataFrame]]:
    """The words of each language (lang, n), and the tables (lang, phrase, f) of runs of 1 to `longest` words that occur
    `least` times."""
    text_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).alias("text")).filter("text is not null")
    levels, bitmaps = [], []
    for k in range(1, longest + 1):
        counted = texts.mapInArrow(_runs(k, bitmaps, BYTES, HELD), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if k == 1:
            words = counted = materialize(counted, "collocations-words")
            sizes = materialize(words.groupBy("lang").agg(F.sum("f").alias("n")), "collocations-sizes")
        levels.append(materialize(counted.filter(F.col("f") >= least), f"collocations-{k}"))
        if k == 1:
            drop_materialized(words)
        if k < longest:
            bitmaps.append(_bitmap(levels[-1], k))
    for b in bitmaps:
        b.unpersist()
    return sizes, levels


def _cut(level: DataFrame, longer: DataFrame | None, levels: list[DataFrame], k: int, contained: int, per: int) -> DataFrame:
    """The phrases of k words with the counts and the score of their lowest cut, without those that a longer one holds."""
    now = level.withColumnRenamed("f", "a")
    if longer is not None:
        # both ways to drop a word of a longer phrase; what lies in a still longer one lies in one of these, too
        ends = F.array_distinct(F.array(F.substring_index("phrase", " ", k), F.substring_index("phrase", " ", -k)))
        most = longer.select("lang", F.explode(ends).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
        now = now.join(most, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("most") < contained * F.col("a"), F.lit(True)))
    a, cuts = F.col("a").cast("decimal(18,0)"), []
    for cut in range(1, k):
        left = levels[cut - 1].select("lang", F.col("phrase").alias("left_"), F.col("f").alias(f"l{cut}"))
        right = levels[k - cut - 1].select("lang", F.col("phrase").alias("right_"), F.col("f").alias(f"r{cut}"))
        now = now.withColumns({"left_": F.substring_index("phrase", " ", cut), "right_": F.substring_index("phrase", " ", cut - k)})
        now = now.join(left, ["lang", "left_"]).join(right, ["lang", "right_"]).drop("left_", "right_")
        # decimals: both products are exact to 38 digits
        l, r = (F.col(f"{side}{cut}").cast("decimal(18,0)") for side in "lr")
        score = F.call_function("div", a * a * F.lit(per).cast("decimal(10,0)"), l * r)
        cuts.append(F.struct(score.alias("score"), F.lit(cut).alias("cut"), F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r")))
    best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    return now.select("lang", "phrase", "a", best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def rank(sizes: DataFrame, levels: list[DataFrame], contained: int = 50, top: int = 2000, per: int = 1_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first phrases of each language, from the level tables alone."""
    longer = [*levels[1:], None]
    scored = _cut(levels[1], longer[1], levels, 2, contained, per)
    for k in range(3, len(levels) + 1):
        scored = scored.unionByName(_cut(levels[k - 1], longer[k - 1], levels, k, contained, per))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of each shard hold the first of all, so that no task ranks a whole language
    shard = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    few = scored.withColumn("rank", F.row_number().over(shard)).filter(F.col("rank") <= top).drop("rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, *, longest: int = 3, least: int = 10, contained: int = 50, top: int = 2000, per: int = 1_000_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to `longest` words.

    a is the phrase's count (`least` at least), l and r those of the parts of its lowest cut, score
    floor(per * a * a / (l * r)), n the language's words. A phrase inside a longer one with at least `contained` hundredths
    of its count is left out.
    """
    return rank(*count_levels(docs, longest, least, text_col, lang_col), contained, top, per)
