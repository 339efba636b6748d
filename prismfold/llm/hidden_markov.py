"""A hidden Markov language model: counts of Baum-Welch from all tasks train latent states, the forward recursion scores.

Words are counted by Spark. The HEAD most frequent are symbols of their own, the others emit the symbol of their class (a
hash of their last three bytes, digits alike), times the word's share of the class, which does not depend on the state. So
the state's tables are bounded, while every word of the corpus has its own count: shares are joined by word, and a class
keeps the Witten-Bell share of words that training lacks. An end follows each text. The probabilities of all next words,
one unknown word a class included, add up to 1.

Training goes once over all texts, in SHARDS parts by hash. In each part tasks run the scaled forward-backward recursion
over whole texts and send expected counts, as whole numbers in fixed point so that their sums do not depend on their
order; the driver adds the part to a running average (stepwise expectation maximisation) and sends the new tables.
Recursions run over many texts at a time; very long ones are cut into time segments whose borders are kept, and give the
same sums. Scores are of the forward recursion in float64 over whole texts.

A null text is empty and has the end alone. Repeated rows count as rows; each has its own row in the result, and a null
id is kept. Other columns are left out of account, whatever their names; an empty table gives an empty result, and without
training texts all symbols are equally likely.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismfold.llm.shared import materialize, raw_texts, text_batches

#: Latent states, words with a symbol of their own (of at most HEAD_BYTES each), and classes of the others.
STATES, HEAD, HEAD_BYTES, CLASSES = 16, 1 << 17, 64, 1 << 12

#: Parts of the training texts, after each of which the tables are renewed; the weight of part t falls as (t+1)**-DECAY.
SHARDS, DECAY = 8, 0.7

#: Occurrences of each symbol that are added as if dealt to the states as all symbols are, and the share of the overall
#: distribution in each state's own.
PRIOR, BACKOFF = 2.0, 0.01

#: Tokens that a task sorts by length, and tokens whose recursions it holds at once.
POOL, HELD = 1 << 21, 1 << 18

_POINT = 1 << 20  # of fixed-point counts
_DIGITS = bytes(48 if 48 <= c <= 57 else c for c in range(256))


@dataclass
class Tables:
    """Start and transition probabilities, and emissions by symbol (symbols x states)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def as_type(self, kind) -> Tables:
        return Tables(self.start.astype(kind), self.move.astype(kind), self.emit.astype(kind))


@dataclass
class Model:
    """What training gives: counted words (word, c), the head's words and counts, class sums, totals and tables."""

    words: DataFrame
    head: list[bytes]
    head_counts: list[int]
    in_tail: Column
    classes: DataFrame
    ends: int
    tokens: int
    distinct: int
    tables: Tables


# words and symbols


def word_class(word: Column) -> Column:
    """The class of a word; `_Symbols` has the same rule."""
    return F.crc32(F.substring(F.translate(word, "123456789", "000000000").cast("binary"), -3, 3)) % CLASSES


class _Symbols(dict):
    """Symbols of words: the head's, then the end's, then the classes'."""

    def __init__(self, head: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(head))
        self.end = len(head)

    def __missing__(self, word: bytes) -> int:
        return self.end + 1 + zlib.crc32(word.translate(_DIGITS)[-3:]) % CLASSES


def _word_counts(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(counts)
            for at in range(0, len(words), 100_000):
                part = words[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in part], pa.int64())], names=["word", "n"])
            counts.clear()

        for batch in batches:
            for text in raw_texts(batch, "text"):
                counts.update(text.lower().split())
                if len(counts) > most:
                    yield from out()
        yield from out()

    return run


_ENCODED = "row long, id {id}, train boolean, shard int, n_tokens long, n_head long, head_score double, symbols binary, tail array<struct<word string, n long>>"


def _encode(head: list[bytes], scores: np.ndarray) -> Callable:
    """Symbols of each text, the base score of its head words and end, and its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = _Symbols(head)
        for batch in batches:
            packed, known, base, sizes, words, counts = [], [], [], [0], [], []
            for text in raw_texts(batch, "text"):
                tokens = text.lower().split()
                ids = np.fromiter(map(symbols.__getitem__, tokens), "<u4", len(tokens))
                ids = np.append(ids, np.uint32(symbols.end))
                own = ids <= symbols.end
                rest = Counter(tokens[i] for i in np.flatnonzero(~own).tolist())
                packed.append(ids.tobytes())
                known.append(int(own.sum()))
                base.append(float(scores[ids[own]].sum()))
                words += rest.keys()
                counts += rest.values()
                sizes.append(len(words))
            tail = pa.StructArray.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])
            columns = {name: batch.column(name) for name in ("row", "id", "train", "shard")}
            columns |= {"n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()), "n_head": pa.array(known, pa.int64()), "head_score": pa.array(base, pa.float64())}
            columns |= {"symbols": pa.array(packed, pa.binary()), "tail": pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), tail)}
            yield pa.RecordBatch.from_pydict(columns)

    return run


# recursions


class Sequences:
    """Sequences in time-major order: first tokens of all, then second tokens, and so on; the longest sequence first."""

    def __init__(self, sequences: list[np.ndarray], held: int):
        size = np.array([len(s) for s in sequences])
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        flat = np.concatenate([sequences[i] for i in self.order])
        self.steps = int(size[0])
        self.active = np.searchsorted(-size, -np.arange(self.steps), side="left")  # sequences longer than t
        self.start = np.concatenate([[0], np.cumsum(self.active)])
        time = np.arange(flat.size) - np.repeat(np.cumsum(size) - size, size)
        self.symbols = np.empty_like(flat)
        self.symbols[self.start[time] + np.repeat(np.arange(size.size), size)] = flat
        self.segments, at = [], 0
        while at < self.steps:
            end = max(at + 1, int(np.searchsorted(self.start, self.start[at] + held, side="right")) - 1)
            self.segments.append((at, min(end, self.steps)))
            at = self.segments[-1][1]

    def forward(self, segment: tuple[int, int], before: np.ndarray | None, tables: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled state probabilities, their scales and the emissions of a segment's tokens."""
        (begin, end), start = segment, self.start
        base = start[begin]
        emit = tables.emit[self.symbols[base : start[end]]]
        alpha, scale = np.empty_like(emit), np.empty(len(emit), emit.dtype)
        for t in range(begin, end):
            here = slice(start[t] - base, start[t + 1] - base)
            now = alpha[here]
            if before is None:
                now[:] = tables.start
            else:
                np.matmul(before[: len(now)], tables.move, out=now)
            now *= emit[here]
            now.sum(axis=1, out=scale[here])
            now /= scale[here, None]
            before = now
        return alpha, scale, emit

    def log_likelihood(self, tables: Tables) -> np.ndarray:
        """Natural logarithms, in the order in which the sequences were given."""
        out, before = np.zeros(len(self.order)), None
        for segment in self.segments:
            alpha, scale, _ = self.forward(segment, before, tables)
            before = alpha[self.start[segment[1] - 1] - self.start[segment[0]] :].copy()
            active = self.active[slice(*segment)]
            owner = np.arange(len(scale)) - np.repeat(np.cumsum(active) - active, active)
            out[: active[0]] += np.bincount(owner, np.log(scale), active[0])
        given = np.empty_like(out)
        given[self.order] = out
        return given

    def expected(self, tables: Tables, first: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> None:
        """Add the expected counts of starts, moves and emissions, by forward-backward over whole sequences."""
        borders: list[np.ndarray | None] = [None]
        for segment in self.segments[:-1]:
            alpha, _, _ = self.forward(segment, borders[-1], tables)
            borders.append(alpha[self.start[segment[1] - 1] - self.start[segment[0]] :].copy())
        after = None  # emission * beta / scale of the next step
        back = np.ascontiguousarray(tables.move.T)
        both = np.zeros_like(tables.move)
        for (begin, end), before in zip(reversed(self.segments), reversed(borders)):
            alpha, scale, emit = self.forward((begin, end), before, tables)
            base = self.start[begin]
            emit /= scale[:, None]
            for t in range(end - 1, begin - 1, -1):
                here = slice(self.start[t] - base, self.start[t + 1] - base)
                now = alpha[here]
                if after is None:
                    beta = np.ones_like(now)
                else:
                    beta = np.empty_like(now)
                    np.matmul(after, back, out=beta[: len(after)])
                    beta[len(after) :] = 1
                    both += now[: len(after)].T @ after
                after = emit[here]
                after *= beta
                now *= beta  # the states' probabilities given the whole sequence
            symbols = self.symbols[base : self.start[end]]
            for k in range(alpha.shape[1]):
                emits[:, k] += np.bincount(symbols, alpha[:, k], len(emits))
            if begin == 0:
                first += alpha[: self.active[0]].sum(axis=0)
        moves += both * tables.move


def _pools(batches: Iterator[pa.RecordBatch], pool: int, held: int) -> Iterator[tuple[pa.Table, Sequences, np.ndarray]]:
    """Rows whose sequences fill a pool, dealt by length into groups: (rows, sequences, their places in rows)."""

    def groups(kept: list[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Sequences, np.ndarray]]:
        table = pa.Table.from_batches(kept)
        found = [np.frombuffer(b, "<u4").astype(np.int64) for b in table.column("symbols").to_pylist()]
        order = np.argsort([-len(s) for s in found], kind="stable")
        begin, size = 0, 0
        for i, at in enumerate(order):
            size += len(found[at])
            if size >= held or i == len(order) - 1:
                part = order[begin : i + 1]
                yield table, Sequences([found[k] for k in part], held), part
                begin, size = i + 1, 0

    kept, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            kept.append(part)
            size += part.column("symbols").nbytes // 4
            if size >= pool:
                yield from groups(kept)
                kept, size = [], 0
    if kept:
        yield from groups(kept)


def _expected_counts(sent, pool: int, held: int) -> Callable:
    """A task's expected counts in fixed point: a row for each symbol it met, and for starts (-1) and moves (-2 - state)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value
        k = len(tables.start)
        first, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros(tables.emit.shape)
        for _, sequences, _ in _pools(batches, pool, held):
            sequences.expected(tables, first, moves, emits)
        met = np.flatnonzero(emits.any(axis=1))
        keys = np.concatenate([met, [-1], -2 - np.arange(k)])
        values = np.rint(np.concatenate([emits[met], first[None], moves]) * _POINT).astype(np.int64)
        for at in range(0, len(keys), 20_000):
            part = slice(at, at + 20_000)
            yield pa.RecordBatch.from_pydict({"symbol": pa.array(keys[part], pa.int64())} | {f"s{j}": pa.array(values[part, j]) for j in range(k)})

    return run


def _likelihoods(sent, pool: int, held: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, sequences, at in _pools(batches, pool, held):
            score = sequences.log_likelihood(sent.value) / math.log(10)
            out = table.select(["row", "id", "train", "n_tokens", "n_head", "head_score"]).take(pa.array(at)).append_column("path_score", pa.array(score))
            yield from out.combine_chunks().to_batches()

    return run


# training


def renewed(first: np.ndarray, moves: np.ndarray, emits: np.ndarray, overall: np.ndarray) -> Tables:
    """Tables from expected counts: starts and moves with one more of each; emissions from the overall ones and the states'
    shares of each symbol, to which PRIOR occurrences are added."""
    k, whole = len(first), emits.sum(axis=0) + 1
    usual = whole / whole.sum()
    own = overall[:, None] * (emits + PRIOR * usual) / (emits.sum(axis=1, keepdims=True) + PRIOR) / usual
    return Tables((first + 1) / (first.sum() + k), (moves + 1) / (moves.sum(axis=1, keepdims=True) + k), (1 - BACKOFF) * own / own.sum(axis=0) + BACKOFF * overall[:, None])


def first_tables(overall: np.ndarray, states: int, seed: int = 1) -> Tables:
    """Unlike states that tend to last: the overall emissions, disturbed by fixed random factors."""
    noise = np.random.default_rng(seed).lognormal(0, 1, (len(overall), states))
    emit = overall[:, None] * noise
    move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    return Tables(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def train(encoded: DataFrame, overall: np.ndarray, states: int, shards: int) -> Tables:
    """One pass of stepwise Baum-Welch over the shards of the training texts."""
    sc = encoded.sparkSession.sparkContext
    tables = first_tables(overall, states)
    schema = "symbol long, " + ", ".join(f"s{j} long" for j in range(states))
    mean = None
    for t in range(shards):
        sent = sc.broadcast(tables.as_type(np.float32))
        part = encoded.filter((F.col("shard") == t) & F.col("train")).select("symbols")
        sums = part.mapInArrow(_expected_counts(sent, POOL, HELD), schema).groupBy("symbol").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(states)])
        got = materialize(sums, f"markov-counts-{t}").toArrow()  # as many rows as the tables have, whatever the corpus
        sent.unpersist()
        keys = got.column("symbol").to_numpy()
        values = np.stack([got.column(f"s{j}").to_numpy() for j in range(states)], axis=1) / (_POINT / shards)
        now = np.zeros((len(overall) + 1 + states, states))
        now[np.where(keys >= 0, keys, len(overall) - 1 - keys)] = values
        weight = (t + 1.0) ** -DECAY
        mean = now if mean is None else (1 - weight) * mean + weight * now
        tables = renewed(mean[len(overall)], mean[len(overall) + 1 :], mean[: len(overall)], overall)
    return tables


def _least_count(words: DataFrame) -> int:
    """The least count from which on at most HEAD short words remain: counts are told by their first eight binary digits,
    so that a few thousand sums come to the driver and not the first words of every task."""
    unit = F.expr("shiftleft(1L, greatest(length(bin(c)) - 8, 0))")
    steps = words.filter(F.octet_length("word") <= HEAD_BYTES).groupBy((F.col("c") - F.col("c") % unit).alias("c")).agg(F.count("*").alias("n"))
    kept, least = 0, 1 << 62
    for r in steps.orderBy(F.col("c").desc()).collect():
        kept += r.n
        if kept > HEAD:
            break
        least = r.c
    return least


def _count(docs: DataFrame) -> Model:
    """Words of the training texts; `docs` has id, text and train."""
    texts = docs.filter("train")
    words = materialize(texts.select("text").mapInArrow(_word_counts(1 << 20), "word string, n long").groupBy("word").agg(F.sum("n").alias("c")), "markov-words")
    ends = texts.count()
    total = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    in_head = (F.octet_length("word") <= HEAD_BYTES) & (F.col("c") >= _least_count(words))
    head = words.filter(in_head).orderBy(F.col("c").desc(), "word").collect()
    classes = words.filter(~in_head).groupBy(word_class(F.col("word")).alias("class")).agg(F.sum("c").alias("class_tokens"), F.count("*").alias("class_words"))
    return Model(words, [r.word.encode() for r in head], [r.c for r in head], ~in_head, materialize(classes, "markov-classes"), ends, (total.n or 0) + ends, total.v + (ends > 0), Tables(*[np.zeros(0)] * 3))


def score_texts(docs: DataFrame, train_rows: Column, *, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, shards: int = SHARDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text.

    The rows for which `train_rows` holds train the model; null counts as not. Both scores are decimal logarithms:
    base_score of single words with 0.1 added to each count, score of the hidden Markov model.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train_rows, F.lit(False)).alias("train"))
    model = _count(rows)
    unit = model.tokens + 0.1 * (model.distinct + 1)
    base = np.log10((np.array([*model.head_counts, model.ends]) + 0.1) / unit)
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    encoded = numbered.mapInArrow(_encode(model.head, base), _ENCODED.format(id=rows.schema["id"].dataType.simpleString()))
    encoded = materialize(encoded, "markov-texts", ["shard"])
    overall = np.zeros(len(model.head) + 1 + CLASSES)
    overall[: len(model.head)], overall[len(model.head)] = model.head_counts, model.ends
    for r in model.classes.collect():
        overall[len(model.head) + 1 + r["class"]] = r.class_tokens
    overall = (overall + 0.5) / (overall.sum() + 0.5 * len(overall))
    tables = train(encoded, overall, states, shards)
    sent = spark.sparkContext.broadcast(tables)
    schema = encoded.select("row", "id", "train", "n_tokens", "n_head", "head_score").schema.add("path_score", "double")
    paths = encoded.drop("tail", "shard").mapInArrow(_likelihoods(sent, POOL, HELD), schema)
    counts = model.words.filter(model.in_tail).select("word", "c")
    tail = encoded.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n").join(counts, "word", "left")
    tail = tail.withColumn("class", word_class(F.col("word"))).join(F.broadcast(model.classes), "class", "left")
    # at most CLASSES rows are broadcast; a word that training lacks has the share of the class's distinct words
    share = F.coalesce(F.col("c").cast("double"), F.col("class_words").cast("double"), F.lit(1.0)) / F.coalesce(F.col("class_tokens") + F.col("class_words"), F.lit(1))
    tail = tail.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("tail_known"),
        F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(unit))).alias("tail_base"),
        F.sum(F.col("n") * F.log10(share)).alias("tail_score"),
    )
    out = paths.join(tail, "row", "left")
    more = lambda name, kind: F.coalesce(name, F.lit(0).cast(kind))
    known = F.col("n_head") - F.lit(int(model.ends == 0)) + more("tail_known", "long")
    return out.select(
        F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", known.alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("head_score") + more("tail_base", "double")).alias("base_score"), (F.col("path_score") + more("tail_score", "double")).alias("score"),
    )
