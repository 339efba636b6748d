"""The hidden Markov model against sums over all state paths, and its scores against plain Python."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismfold.llm import hidden_markov as hm
from prismfold.llm.hidden_markov import Sequences, Tables, first_tables, renewed, score_texts
from prismfold.llm.shared import read_table
from tests.llm.cases import documents, empty

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def random_tables(rng, symbols, states):
    part = lambda *shape: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(shape) + 0.01)
    return Tables(part(states), part(states, states), part(states, symbols).T.copy())


def all_paths(seq, tables):
    """Likelihood and expected counts from every state path."""
    k = len(tables.start)
    total, first, moves, emits = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros(tables.emit.shape)
    for path in itertools.product(range(k), repeat=len(seq)):
        p = tables.start[path[0]] * math.prod(tables.move[a, b] for a, b in zip(path, path[1:])) * math.prod(tables.emit[s, z] for s, z in zip(seq, path))
        total += p
        first[path[0]] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
        for s, z in zip(seq, path):
            emits[s, z] += p
    return total, first / total, moves / total, emits / total


@pytest.mark.parametrize("held", [1000, 5, 1])
def test_recursions_equal_all_paths(held):
    rng = np.random.default_rng(2)
    tables = random_tables(rng, 6, 3)
    given = [rng.integers(0, 6, n) for n in (3, 1, 7, 7, 2, 5)]
    want = [all_paths(s, tables) for s in given]
    sequences = Sequences(given, held)
    assert np.allclose(sequences.log_likelihood(tables), [math.log(w[0]) for w in want], rtol=1e-12)
    sums = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
    sequences.expected(tables, *sums)
    for got, i in zip(sums, (1, 2, 3)):
        assert np.allclose(got, sum(w[i] for w in want), rtol=1e-10)


def test_long_sequences_do_not_underflow():
    rng = np.random.default_rng(3)
    tables = random_tables(rng, 50, 4)
    seq = rng.integers(0, 50, 30_000)
    log, alpha = 0.0, None
    for s in seq:
        alpha = (tables.start if alpha is None else alpha @ tables.move) * tables.emit[s]
        log, alpha = log + math.log(alpha.sum()), alpha / alpha.sum()
    for held in (1 << 18, 1000):
        assert Sequences([seq, seq[:10]], held).log_likelihood(tables)[0] == pytest.approx(log, rel=1e-12)


def test_each_pass_of_baum_welch_raises_the_likelihood(monkeypatch):
    monkeypatch.setattr(hm, "PRIOR", 1e-9)
    monkeypatch.setattr(hm, "BACKOFF", 0.0)
    rng = np.random.default_rng(4)
    given = [np.concatenate([rng.integers(0, 10, n) + 10 * (i % 2) for i in range(rng.integers(1, 5))]) for n in rng.integers(3, 30, 60)]
    overall = np.bincount(np.concatenate(given), minlength=20) / sum(map(len, given))
    tables, before = first_tables(overall, 3), -math.inf
    for _ in range(12):
        sequences = Sequences(given, 100)
        now = sequences.log_likelihood(tables).sum()
        assert now > before - 0.5  # starts and moves are smoothed, so not quite monotone
        before, first_value = now, now if before == -math.inf else first_value
        sums = np.zeros(3), np.zeros((3, 3)), np.zeros((20, 3))
        sequences.expected(tables, *sums)
        tables = renewed(*sums, overall)
    assert before > first_value + 100


def test_tables_are_distributions():
    rng = np.random.default_rng(5)
    overall = rng.random(40)
    overall /= overall.sum()
    for tables in (first_tables(overall, 5), renewed(rng.random(5), rng.random((5, 5)), rng.random((40, 5)) * 100, overall), renewed(np.zeros(5), np.zeros((5, 5)), np.zeros((40, 5)), overall)):
        assert np.allclose(tables.start.sum(), 1) and np.allclose(tables.move.sum(axis=1), 1) and np.allclose(tables.emit.sum(axis=0), 1)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def plain(rows, in_training, head, tables=None):
    """The contract's figures, and with tables the model's score, word by word."""
    c, ends = Counter(), 0
    for key, text in rows:
        if in_training(key):
            c.update(words_of(text))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    short = [(w, x) for w, x in c.items() if len(w.encode()) <= hm.HEAD_BYTES]
    rough = lambda x: x - x % (1 << max(0, x.bit_length() - 8))
    fits = [t for t in {rough(x) for _, x in short} if sum(x >= t for _, x in short) <= head]
    own = {w: i for i, (w, x) in enumerate(sorted(((w, x) for w, x in short if fits and x >= min(fits)), key=lambda x: (-x[1], x[0].encode())))}
    tail_class = lambda w: zlib.crc32(re.sub(r"[0-9]", "0", w).encode()[-3:]) % hm.CLASSES
    members = Counter(tail_class(w) for w in c if w not in own)
    inside = Counter()
    for w, x in c.items():
        if w not in own:
            inside[tail_class(w)] += x
    out = []
    for key, text in rows:
        words = words_of(text)
        counts = [c[w] for w in words] + [ends]
        base = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in counts)
        score = 0.0
        if tables:
            symbols = [own[w] if w in own else len(own) + 1 + tail_class(w) for w in words] + [len(own)]
            alpha = None
            for s in symbols:
                alpha = (tables.start if alpha is None else alpha @ tables.move) * tables.emit[s]
                score, alpha = score + math.log10(alpha.sum()), alpha / alpha.sum()
            for w in words:
                if w not in own:
                    g = tail_class(w)
                    score += math.log10((c[w] or members[g] or 1) / (inside[g] + members[g] or 1))
        out.append((key is None, key or 0, not in_training(key), len(counts), sum(x > 0 for x in counts), n, round(base, 6), round(score, 6)))
    return sorted(out)


def result(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("head", [0, 10, 1 << 17])
def test_scores_equal_plain_python(spark, monkeypatch, head):
    """With given tables, on repeated rows, null ids, null, empty and very long texts, and words that training lacks."""
    monkeypatch.setattr(hm, "HEAD", head)
    made = []

    def fixed(encoded, overall, states, shards):
        assert overall.sum() == pytest.approx(1)
        made[:] = [random_tables(np.random.default_rng(6), len(overall), states)]
        return made[0]

    monkeypatch.setattr(hm, "train", fixed)
    df = documents(spark).unionByName(spark.createDataFrame([(91, "Delta x9 " + "q" * 5000 + " É\x0b7a 8A"), (97, "zzz999 zzz111 zzz111"), (98, "alpha zzz555")], "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    training = lambda key: (key or 0) % 3 != 1 if key is not None else False
    got = result(score_texts(df, F.col("doc_id") % 3 != 1, states=4))
    assert got == plain(rows, training, head, made[0])


def test_training_beats_single_words_on_held_out_texts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    tenth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    out = score_texts(docs, tenth != 0).cache()
    sums = out.filter("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).first()
    assert sums.score > sums.base + 0.1 * sums.n
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda key: zlib.crc32(str(key).encode()) % 10 != 0
    assert [g[:-1] for g in result(out)] == [w[:-1] for w in plain(rows, held, 0)]
    assert out.count() == docs.count()


def test_without_training_rows_and_without_rows(spark):
    df = documents(spark).select("doc_id", "text")
    got = result(score_texts(df, F.lit(None).cast("boolean"), states=2, shards=2))
    assert sorted(g[3] for g in got) == sorted(len(words_of(r.text)) + 1 for r in df.collect())
    assert all(g[4] == 0 and g[5] == 0 and abs(g[6]) < 1e-9 and g[7] < 0 for g in got)
    none = score_texts(empty(spark), F.lit(True), states=2, shards=2)
    assert none.count() == 0 and none.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
