"""Phrase collocations against counts of all runs in Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from prismfold.llm import collocations
from prismfold.llm.collocations import mine, rank
from tests.llm.cases import documents, empty

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=3, least=10, contained=50, top=2000):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        n, found = sum(v for p, v in c.items() if len(p) == 1), []
        for p, a in c.items():
            inside = any(len(q) > len(p) and v >= least and 100 * v >= contained * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, v in c.items()) if len(p) > 1 and a >= least else True
            if not inside:
                score, cut = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:cut]], c[p[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def result(df, **more):
    return sorted(tuple(r) for r in mine(df, **more).collect())


def corpus(seed, n=60):
    r = random.Random(seed)
    fixed = ["New York", "the United States of", "état  major", "a\tb", "über alles, Über alles", "same same same same", "x\x00y z"]
    words = [f"w{i}" for i in range(6)] + ["É", "zß", "a|b"]
    text = lambda: "".join(r.choice(fixed if r.random() < 0.2 else words) + r.choice([" ", " ", "  ", "\t", ". ", "\n", "\r\n", "\x0b", "\x0c", "; "]) for _ in range(r.randrange(80)))
    return [(r.choice(["en", "de", None, "und", "x y"]), text()) for _ in range(n)] + [("en", None), ("en", " ".join(r.choice(words) for _ in range(900))), ("fr", ""), (None, " \n"), ("en", "one")]


@pytest.mark.parametrize("bits, held, size", [(1 << 27, 1 << 21, 4 << 20), (1 << 15, 50, 200)])
def test_equals_counts_of_all_runs(spark, monkeypatch, bits, held, size):
    """Also where hashes clash, where tasks forget often, and where texts are taken by their pieces."""
    for name, value in (("BITS", bits), ("HELD", held), ("BYTES", size)):
        monkeypatch.setattr(collocations, name, value)
    rows = corpus(1, 400)
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "lang string, text string, phrase string, f int, n int").repartition(5)
    want = brute(rows)
    assert len(want) > 100 and any(len(w[2].split()) == 3 for w in want)
    assert result(df) == want


@pytest.mark.parametrize("longest", [2, 4])
def test_other_lengths(spark, longest):
    rows = corpus(2, 80)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert result(df, longest=longest, least=4, contained=70, top=40) == brute(rows, longest, 4, 70, 40)


def test_scores_are_exact_beyond_64_bits(spark):
    f = [("a", 10**15 + 7), ("b", 3 * 10**15 + 1), ("c", 10**15)]
    words = spark.createDataFrame([("en", *x) for x in f], "lang string, phrase string, f long")
    pairs = spark.createDataFrame([("en", "a b", 10**15 + 5), ("en", "b c", 999_999_999_999_989)], words.schema)
    triples = spark.createDataFrame([("en", "a b c", 10**14 + 9)], words.schema)
    got = {r.phrase: r.score for r in rank(words.groupBy("lang").agg(F.sum("f").alias("n")), [words, pairs, triples]).collect()}
    low = min(10**6 * (10**14 + 9) ** 2 // ((10**15 + 7) * 999_999_999_999_989), 10**6 * (10**14 + 9) ** 2 // ((10**15 + 5) * 10**15))
    assert got == {"a b": 10**6 * (10**15 + 5) ** 2 // ((10**15 + 7) * (3 * 10**15 + 1)), "b c": 10**6 * 999_999_999_999_989**2 // ((3 * 10**15 + 1) * 10**15), "a b c": low}


def test_awkward_rows_and_empty_tables(spark):
    df = documents(spark)
    assert result(df, top=50) == brute([(r.lang, r.text) for r in df.collect()], top=50)
    assert result(empty(spark)) == []
    assert result(df.limit(1).withColumn("text", F.lit("one two"))) == []
