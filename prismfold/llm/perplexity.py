"""Quality rules: n-gram perplexity under a modified Kneser-Ney model.

The model is over true characters, in any script, by language, of order 5. Spark counts every 5-gram of every text, and
the orders below, contexts and discounts are aggregations and joins of those counts, so the model grows with the
corpus and no task or driver holds it. Each n-gram that was counted gets its interpolated probability. Scoring looks a
text's n-grams up in sorted hash arrays: the `HEAD` most frequent n-grams (12 bytes each) go to every executor; what
is not among them is summed up by document and n-gram and joined to the other shards of the model by hash.

A text is rejected if the logarithm of its perplexity lies outside the band of its language: the median over all
documents, less `lower_width` and plus `upper_width` robust standard deviations (1.4826 times the median absolute
deviation, from exact counts of values rounded to 0.001).

Words as units were measured and left: 20,000 documents of the larger check table hold 10.5 million words, of which
916 thousand are distinct, and 6.0 million distinct word pairs, so a table of word n-grams is as large as the corpus.

Defined cases: null and empty texts have no words and fail the base rules; a null or odd `lang` counts as "und"; texts
of any length are taken in pieces of `CHUNK` code points; repeated rows each count and each give their row; columns of
`docs` may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from prismfold.llm.hashing import mix
from prismfold.llm.shared import broadcast_if_small, drop_materialized, free_names, materialize, text_batches, texts

ORDER = 5
#: N-grams that every executor holds, of all languages together.
HEAD = 1 << 19
#: Code points of one vectorised step.
CHUNK = 1 << 20
#: Bits of a character's rank within a step: a step with more distinct characters is halved.
BITS = 12
STEP = 0.001
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PAD = " " * (ORDER - 1)


def language(column: str):
    """A code of two or three letters, else "und"."""
    code = F.lower(F.trim(F.col(f"`{column}`")))
    return F.when(code.rlike("^[a-z]{2,3}$"), code).otherwise("und")


def _pieces(values: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of pieces of about CHUNK code points, each with the code points before it; whole texts in all."""
    rows, group, size = [], [], 0
    for row, text in enumerate(values):
        for at in range(0, len(text), CHUNK):
            piece = (_PAD if at == 0 else text[at - len(_PAD) : at]) + text[at : at + CHUNK]
            rows.append(row)
            group.append(piece)
            size += len(piece)
            if size >= CHUNK:
                yield rows, group
                rows, group, size = [], [], 0
    if rows:
        yield rows, group


def _steps(values: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each step: the row and packed key of every n-gram, and the characters that the key's ranks stand for."""
    for rows, group in _pieces(values):
        codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(p) for p in group])
        owner = np.repeat(np.array(rows), sizes)
        inside = np.arange(codes.size) < np.repeat(np.cumsum(sizes) - len(_PAD), sizes)
        halves = [(0, codes.size)]
        while halves:
            start, end = halves.pop()
            own = codes[start : end + len(_PAD)]
            letters = np.unique(own)
            if letters.size > 1 << BITS:
                middle = (start + end) // 2
                halves += [(start, middle), (middle, end)]
                continue
            ranks = np.searchsorted(letters, own).astype(np.uint64)
            n = min(end - start, max(0, own.size - len(_PAD)))
            key = np.zeros(n, np.uint64)
            for i in range(ORDER):
                key = (key << np.uint64(BITS)) | ranks[i : n + i]
            whole = inside[start : start + n]
            yield owner[start : start + n][whole], key[whole], letters


def _characters(keys: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The code points of packed keys, one row a key."""
    shifts = np.uint64(BITS) * np.arange(ORDER - 1, -1, -1, dtype=np.uint64)
    return letters[((keys[:, None] >> shifts) & np.uint64((1 << BITS) - 1)).astype(np.int64)]


def _hashed(characters: np.ndarray) -> np.ndarray:
    out = np.zeros(len(characters), np.uint64)
    for i in range(ORDER):
        out = out * _ODD + characters[:, i].astype(np.uint64)
    return mix(out)


def _grouped(batch: pa.RecordBatch, text_col: str, key_col: str) -> Iterator[tuple[str, np.ndarray, list[str]]]:
    values, keys = texts(batch, text_col), batch.column(key_col).to_pylist()
    for key in sorted(set(keys)):
        rows = [i for i, k in enumerate(keys) if k == key]
        yield key, np.array(rows), [values[i] for i in rows]


class _Counts:
    """N-grams of one language and their numbers, merged from time to time."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.merged = 0, 0

    def add(self, keys: np.ndarray, letters: np.ndarray):
        found, n = np.unique(keys, return_counts=True)
        characters = _characters(found, letters)
        self.held.append((_hashed(characters), characters, n))
        self.size += found.size
        if self.size > 2 * self.merged + 500_000:
            self.merge()

    def merge(self):
        hashes, characters, n = (np.concatenate(c) for c in zip(*self.held))
        found, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        self.held = [(found, characters[first], np.bincount(at, weights=n).astype(np.int64))]
        self.size = self.merged = found.size


def count_ngrams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, gram (a string of ORDER characters), n over all texts; each task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, _Counts] = {}
        for batch in batches:
            for lang, _, values in _grouped(batch, text_col, "lang"):
                held = counts.setdefault(lang, _Counts())
                for _, keys, letters in _steps(values):
                    held.add(keys, letters)
        for lang, held in counts.items():
            if held.held:
                held.merge()
                _, characters, n = held.held[0]
                for at in range(0, n.size, 1 << 17):
                    text = characters[at : at + (1 << 17)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                    grams = pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)], pa.string())
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": grams, "n": pa.array(n[at : at + (1 << 17)])})

    rows = docs.select(F.col(f"`{text_col}`"), language(lang_col).alias("lang")).mapInArrow(count, "lang string, gram string, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(level: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 of modified Kneser-Ney from the counts of counts: a row a language."""
    of = lambda k: F.greatest(F.lit(1), F.count(F.when(F.col("n") == k, 1))).cast("double")
    found = level.groupBy("lang").agg(*[of(k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    clipped = lambda x, low, high: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    return found.select(
        "lang",
        clipped(1 - 2 * y * F.col("n2") / F.col("n1"), 0.05, 0.95).alias("d1"),
        clipped(2 - 3 * y * F.col("n3") / F.col("n2"), 0.05, 1.9).alias("d2"),
        clipped(3 - 4 * y * F.col("n4") / F.col("n3"), 0.05, 2.85).alias("d3"),
    )


def fit(counts: DataFrame) -> DataFrame:
    """lang, gram, n and p of each n-gram of `counts` (lang, gram, n): interpolated modified Kneser-Ney."""
    levels = [counts]
    for order in range(ORDER - 1, 0, -1):  # below, the number of characters seen before each n-gram
        below = levels[-1].groupBy("lang", F.substring("gram", 2, order).alias("gram")).agg(F.count("*").alias("n"))
        levels.append(materialize(below, f"ngrams-{order}"))
    lower = levels[-1].groupBy("lang").agg((1 / F.count("*")).alias("p_lower")).withColumn("suffix", F.lit(""))
    for order, level in enumerate(reversed(levels), 1):
        # a row a language: codes have two or three letters, so there are at most 18,253
        told = level.join(F.broadcast(_discounts(level)), "lang")
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        told = told.select("lang", "gram", "n", d.alias("d"), F.substring("gram", 1, order - 1).alias("context"), F.substring("gram", 2, order - 1).alias("suffix"))
        contexts = told.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
        both = told.join(contexts, ["lang", "context"]).join(lower, ["lang", "suffix"])
        p = (F.col("n") - F.col("d") + F.col("left") * F.col("p_lower")) / F.col("total")
        made = materialize(both.select("lang", "gram", "n", p.alias("p")), f"model-{order}")
        lower = made.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("p_lower"))
    return made


def _by_hash(model: DataFrame) -> DataFrame:
    """lang, hash, n and log (the negative logarithm of p) of each n-gram of the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = "".join(batch.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass")
            hashes = _hashed(np.frombuffer(grams, np.uint32).reshape(-1, ORDER)).view(np.int64)
            logs = -np.log(np.maximum(batch.column("p").to_numpy(), 1e-12))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(hashes), batch.column("n"), pa.array(logs)], names=["lang", "hash", "n", "log"])

    return model.mapInArrow(run, "lang string, hash long, n long, log double")


class SortedHashes:
    """Values by n-gram: hashes in order, and the values beside them."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order].astype(np.float32)

    def get(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, 0 where there is none, and which hashes there are."""
        if not self.hashes.size:
            return np.zeros(hashes.size), np.zeros(hashes.size, bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.hashes.size - 1)
        there = self.hashes[at] == hashes
        return np.where(there, self.values[at], 0).astype(np.float64), there


def split_model(model: DataFrame, head: int) -> tuple[dict[str, SortedHashes], DataFrame]:
    """The most frequent n-grams, at most `head`, as sorted hash arrays by language, and the table of the others."""
    rank = F.floor(F.log2("n") * 8).cast("int")  # at most 512 ranks, whatever the corpus
    room, least = head, None
    for row in model.groupBy(rank.alias("rank")).agg(F.count("*").alias("entries")).orderBy(F.desc("rank")).collect():
        if row.entries > room:
            break
        room, least = room - row.entries, row["rank"]
    if least is None:
        return {}, model

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            hashes, logs = batch.column("hash").to_numpy(), batch.column("log").to_numpy().astype(np.float32)
            found = sorted(set(langs))
            parts = [(hashes[langs == x].tobytes(), logs[langs == x].tobytes()) for x in found]
            yield pa.RecordBatch.from_pydict({"lang": pa.array(found, pa.string()), "hashes": pa.array([h for h, _ in parts], pa.binary()), "logs": pa.array([v for _, v in parts], pa.binary())})

    # 12 bytes an n-gram come to the driver
    parts: dict[str, list] = {}
    for row in model.filter(rank >= least).select("lang", "hash", "log").mapInArrow(pack, "lang string, hashes binary, logs binary").collect():
        parts.setdefault(row.lang, []).append((row.hashes, row.logs))
    arrays = {lang: SortedHashes(np.frombuffer(b"".join(h for h, _ in p), np.uint64), np.frombuffer(b"".join(v for _, v in p), np.float32)) for lang, p in parts.items()}
    return arrays, model.filter(rank < least)


_NONE = SortedHashes(np.empty(0, np.uint64), np.empty(0))


def _look_up(values: list[str], model: SortedHashes) -> tuple[np.ndarray, np.ndarray, list[Counter]]:
    """For each text: the sum of the logs of the n-grams found, the number of n-grams, and those not found."""
    total, size = np.zeros(len(values)), np.zeros(len(values), np.int64)
    rest: list[Counter] = [Counter() for _ in values]
    for rows, keys, letters in _steps(values):
        grams, at = np.unique(keys, return_inverse=True)
        hashes = _hashed(_characters(grams, letters))
        logs, there = model.get(hashes)
        total += np.bincount(rows, weights=logs[at], minlength=len(values))
        size += np.bincount(rows, minlength=len(values))
        if not there.all():
            missed = ~there[at]
            for row, found in zip(rows[missed].tolist(), hashes[at[missed]].view(np.int64).tolist()):
                rest[row][found] += 1
    return total, size, rest


def _weighted_median(values: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(n[order])
    return float(values[order][np.searchsorted(upto, (upto[-1] + 1) // 2)])


def bands(scored: DataFrame, widths: tuple[float, float]) -> DataFrame:
    """lang, low and high of the log-perplexity, from all rows (lang, log) with one; a row a language."""
    steps = scored.filter("log is not null").groupBy("lang", F.round(F.col("log") / STEP).cast("long").alias("step")).agg(F.count("*").alias("n")).toPandas()
    out = []
    for lang, g in steps.groupby("lang"):
        middle = _weighted_median(g["step"].to_numpy(), g["n"].to_numpy())
        spread = max(_weighted_median(np.abs(g["step"].to_numpy() - middle), g["n"].to_numpy()) * 1.4826, 5.0)
        out.append((lang, float((middle - widths[0] * spread) * STEP), float((middle + widths[1] * spread) * STEP)))
    return scored.sparkSession.createDataFrame(out, "lang string, low double, high double")


_BLANK = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen, n_dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n_dup += bool(line.strip(_BLANK))
        else:
            seen.add(line)
    covered = 0
    triples = list(zip(words, words[1:], words[2:]))
    if len(set(triples)) < len(triples):
        times, upto = Counter(triples), 0
        for i, t in enumerate(triples):
            if times[t] > 1:
                covered += i + 3 - max(i, upto)
                upto = i + 3
    return len(words), len(text) - sum(map(text.count, _BLANK)), sum(map(text.count, _SYMBOLS)), n_dup, covered


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LOWER_WIDTH, UPPER_WIDTH = 5.0, 4.0


def judge(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", lower_width: float = LOWER_WIDTH, upper_width: float = UPPER_WIDTH, head: int = HEAD, keep_text: bool = True) -> DataFrame:
    """The rows and columns of `docs` (less the text unless `keep_text`) and a struct `quality`: the five base counts,
    base_failed, log_perplexity (null without symbols), band ("low", "high" or "in") and kept. A column of `docs` of
    that name is replaced.

    Two scans of the texts: counts, scores.
    """
    spark = docs.sparkSession
    text_batches(spark)
    counts = materialize(count_ngrams(docs, text_col, lang_col), "ngrams")
    fitted = fit(counts)
    drop_materialized(counts)
    model = materialize(_by_hash(fitted), "ngram-hashes")
    drop_materialized(fitted)
    arrays, others = split_model(model, head)
    sent = spark.sparkContext.broadcast(arrays)

    carried = [c for c in docs.columns if c != "quality"]
    lang, row, told, total, size, rest, more, low, high = free_names(carried, "lang", "row", "told", "total", "size", "rest", "more", "low", "high")
    kept = [c for c in carried if keep_text or c != text_col]
    given = docs.select(*[F.col(f"`{c}`") for c in carried], language(lang_col).alias(lang))
    base = StructType([*(StructField(c, LongType()) for c in _COUNTS), StructField("base_failed", BooleanType())])
    missing = ArrayType(StructType([StructField("hash", LongType()), StructField("n", LongType())]))
    schema = StructType([*(f for f in given.schema if f.name in kept or f.name == lang), StructField(told, base), StructField(total, DoubleType()), StructField(size, LongType()), StructField(rest, missing)])
    base_arrow = pa.struct([*((c, pa.int64()) for c in _COUNTS), ("base_failed", pa.bool_())])
    rest_arrow = pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, sizes, left = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for code, rows, values in _grouped(batch, text_col, lang):
                found, n, missed = _look_up(values, sent.value.get(code, _NONE))
                sums[rows], sizes[rows] = found, n
                for i, m in zip(rows, missed):
                    left[i] = [{"hash": h, "n": k} for h, k in m.items()] or None
            rules = []
            for text in texts(batch, text_col):
                counted = dict(zip(_COUNTS, base_counts(text)))
                rules.append(counted | {"base_failed": counted["n_words"] < 50 or 100 * counted["n_repeat_words"] > 50 * counted["n_words"]})
            columns = [batch.column(c) for c in (*kept, lang)]
            columns += [pa.array(rules, base_arrow), pa.array(sums), pa.array(sizes), pa.array(left, rest_arrow)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    scored = materialize(given.mapInArrow(score, schema).withColumn(row, F.monotonically_increasing_id()), "texts-scored")
    asked = scored.select(F.col(row).alias("row"), F.col(lang).alias("lang"), F.explode(rest).alias("m")).select("row", "lang", "m.hash", "m.n")
    sums = asked.join(others.select("lang", "hash", "log"), ["lang", "hash"]).groupBy("row").agg(F.sum(F.col("n") * F.col("log")).alias("more"))
    sums = materialize(sums.withColumnsRenamed({"row": row, "more": more}), "texts-rest")
    drop_materialized(model)
    log = F.when(F.col(size) > 0, F.round((F.col(total) + F.coalesce(F.col(more), F.lit(0.0))) / F.col(size), 9))
    few = broadcast_if_small(sums, 24)
    found = bands(scored.select(F.col(lang), row, total, size).join(few, row, "left").select(F.col(lang).alias("lang"), log.alias("log")), (lower_width, upper_width))
    limits = found.withColumnsRenamed({"lang": lang, "low": low, "high": high})
    joined = scored.join(few, row, "left").join(F.broadcast(limits), lang, "left")
    band = F.when(log < F.col(low), "low").when(log > F.col(high), "high").otherwise("in")
    passed = ~F.col(told)["base_failed"] & (band == "in")
    fields = [F.col(told)[c].alias(c) for c in (*_COUNTS, "base_failed")]
    quality = F.struct(*fields, log.alias("log_perplexity"), band.alias("band"), passed.alias("kept"))
    return joined.select(*[scored[f"`{c}`"] for c in kept], quality.alias("quality"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """`docs` without the documents that the rules reject."""
    columns = docs.columns
    return judge(docs, **options).filter("quality.kept").select(*[F.col(f"`{c}`") for c in columns])


def digest(judged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    told = F.col("quality")
    return judged.select(id_col, *[told[c].alias(c) for c in (*_COUNTS, "base_failed", "log_perplexity", "band", "kept")])
