"""Quality classifier: compression against dictionaries of good and of bad text.

Two zstandard dictionaries are trained in each of two views of a text: the text itself, and its shape (letters as
a and A, digits as 0). The normalised difference of the two compressed sizes in a view tells which class the
text resembles; a logistic model turns these differences, with the share of the size that is left without a
dictionary, into a probability that is calibrated to the labels' own class shares.

Fitting takes a bounded sample: at most `per_class` labelled documents of each class, those first by a hash of
their id, and of these only texts of at most `max_chars` code points. A half trains the dictionaries, the other
half the calibration. Scoring takes every text whole.

Defined cases: null and empty texts get the score that the model gives to empty text; labels that are null, or
contradict each other for one document, are left out; with labels of one class only, the score is that class's
smoothed share.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismfold.llm.shared import raw_texts, text_batches

PER_CLASS = 1200
MAX_CHARS = 20_000
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
FOLDS = 5

_SHAPE = bytes(0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x41 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))
_RUNS = re.compile(rb"(a|A|0)\1+")


def shape(text: bytes) -> bytes:
    """Runs of small letters, capitals and digits become one sign each."""
    return _RUNS.sub(rb"\1", text.translate(_SHAPE))


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: use it as it is
        return b"".join(samples)[-size:] or b" " * 8


@dataclass
class Classifier:
    """What scoring needs: dictionaries as (good, bad) by view, and the weights of the logistic model."""

    dictionaries: list[tuple[bytes, bytes]]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    share: float | None = None

    def compressors(self):
        plain = zstandard.ZstdCompressor(level=LEVEL)
        by_view = []
        for pair in self.dictionaries:
            made = []
            for data in pair:
                d = zstandard.ZstdCompressionDict(data)
                d.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d))
            by_view.append(made)
        return plain, by_view

    def score(self, values: list[bytes], made=None) -> np.ndarray:
        if self.share is not None:
            return np.full(len(values), self.share)
        x = features(values, made or self.compressors())
        return _sigmoid(_expanded((x - self.mean) / self.scale) @ self.weights)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def features(values: list[bytes], made) -> np.ndarray:
    plain, by_view = made
    out = np.zeros((len(values), 4))
    for i, text in enumerate(values):
        for v, view in enumerate((text, shape(text))):
            alone = len(plain.compress(view))
            good, bad = (len(c.compress(view)) for c in by_view[v])
            out[i, v] = (bad - good) / max(alone, 1)
            out[i, 2 + v] = np.log((alone + 16) / (len(view) + 16))
    return out


def _expanded(x: np.ndarray) -> np.ndarray:
    """A constant, the features, their squares and products."""
    pairs = [x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i, x.shape[1])]
    return np.clip(np.column_stack([np.ones(len(x)), x, *pairs]), -50, 50)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = _sigmoid(x @ beta)
        grad = x.T @ (w * (p - y)) + ridge * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Classifier:
    """Learn from the labelled rows whose crc32(id as text) mod 5 is not 0."""
    known = (
        labels.filter(F.col(label_col).isin(0, 1) & (F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS != 0))
        .groupBy(F.col(id_col).alias("id_"))
        .agg(F.min(label_col).alias("y"), F.max(label_col).alias("y_"))
        .filter("y = y_")
    )
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = (counts.get(1, 0) + 1) / (total + 2)
        return Classifier([], np.zeros(4), np.ones(4), np.zeros(15), share)
    # twice as many ids as needed, as texts may be too long; both classes bounded, so the join's small side is
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).select("id_", "y", F.xxhash64("id_").alias("h")).orderBy("h", "id_").limit(2 * per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = (
        docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
        .filter(F.length("text_") <= max_chars)
        .join(F.broadcast(chosen), "id_")
        .groupBy("id_")  # repeated rows count once
        .agg(F.min("text_").alias("text_"), F.first("y").alias("y"), F.first("h").alias("h"))
        .orderBy("h", "id_")
        .collect()
    )
    by_class = {y: [r.text_.encode("utf-8", "surrogatepass") for r in rows if r.y == y][:per_class] for y in (0, 1)}
    if min(map(len, by_class.values())) < 2:
        return Classifier([], np.zeros(4), np.ones(4), np.zeros(15), (counts[1] + 1) / (total + 2))
    dictionaries = []
    for view in (bytes, shape):
        dictionaries.append(tuple(_dictionary([view(t) for t in by_class[y][::2]], DICTIONARY_BYTES) for y in (1, 0)))
    made = Classifier(dictionaries, np.zeros(4), np.ones(4), np.zeros(15))
    rest = {y: by_class[y][1::2] for y in (0, 1)}
    x = features(rest[0] + rest[1], made.compressors())
    y = np.array([0.0] * len(rest[0]) + [1.0] * len(rest[1]))
    w = np.concatenate([np.full(len(rest[k]), counts[k] / total / len(rest[k])) for k in (0, 1)]) * len(y)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return Classifier(dictionaries, mean, scale, _logistic(_expanded((x - mean) / scale), y, w))


def score(docs: DataFrame, model: Classifier, *, text_col: str = "text") -> DataFrame:
    """The rows and columns of `docs` and the column quality_score; a column of that name is replaced."""
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    carried = [c for c in docs.columns if c != "quality_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = sent.value.compressors() if sent.value.dictionaries else None
        for batch in batches:
            found = sent.value.score(raw_texts(batch, text_col), made)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "quality_score"])

    given = docs.select(*[F.col(f"`{c}`") for c in carried])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    return given.mapInArrow(run, f"{schema}, quality_score double")
