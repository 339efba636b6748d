"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts earlier.

Routing. Of the k-byte strings inside every window of `length` bytes, one with the least hash is an anchor; two
equal windows have the same anchor at the same place. So every repeat shows up among the segments of equal anchors
(the windows that an anchor is the least of, which follow each other), and no group needs more text than those. Anchors go through
one shuffle as hashes; each task first sets aside the segments that it has seen already, so that a passage with
any number of copies reaches a task once per task. A segment that equals an earlier one is a repeat as a whole.

Intervals. Distinct segments around one anchor (where copies begin, end or differ) are fetched as bytes and laid
out in blocks. A block's suffixes are ordered to depth `length`, which gives its Burrows-Wheeler transform;
breadth-first backward extension then derives the intervals of suffixes with a common prefix of 1, 2, 3 ... bytes
from those of the level before, dropping intervals of one suffix, and stops at `length`. What shares an interval
there and is not its earliest start is a repeat. Anchors with more than `hot` distinct segments would outgrow a
block; their windows are dealt out by window hash and reduced to their first start with map-side combine.

Order is (id, start). Rows that share an id are told apart by their text; equal starts in rows with equal ids are
not earlier than each other. A null id sorts last. Null and empty texts have no bytes; texts below `length` bytes
keep all of theirs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismfold.llm.hashing import BYTES, _tables, mix, window_hashes
from prismfold.llm.shared import materialize, raw_texts, text_batches

ANCHOR = 32
CHUNK = 1 << 20
#: Anchors of a task that are compared with each other before they are sent.
HELD = 1 << 18
#: Bytes of segments in one Burrows-Wheeler transform.
BLOCK = 1 << 20
HOT = 8_000
LAST = (1 << 63) - 1


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of every `width` values, the leftmost of equal ones, by doubling."""
    value, place, size = x, np.arange(x.size, dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        count = value.size - step
        right = value[step:] < value[:count]
        value, place = np.where(right, value[step:], value[:count]), np.where(right, place[step:], place[:count])
        size += step
    return place


def anchors(data: np.ndarray, ends: np.ndarray, length: int, k: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """For texts that lie end to end: anchor hash, place in the first window, first window and number of windows.

    Every window within a text belongs to one anchor; the windows of an anchor follow each other.
    """
    np.seterr(over="ignore")
    if data.size < length:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    h = window_hashes(data, k)
    owner = _least(h, length - k + 1)
    across = np.zeros(owner.size, bool)
    for end in ends[:-1]:
        across[max(0, end - length + 1) : end] = True
    owner[across] = -1
    heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    count = np.diff(np.append(heads, owner.size))
    real = owner[heads] >= 0
    heads, count = heads[real], count[real]
    at = owner[heads].astype(np.int64)
    return h[at], at - heads, heads, count


def _segments(values: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """For all anchors of some texts: text number, anchor hash, segment hash and packed place.

    A segment is the bytes of the windows of an anchor. Its place is packed as start << 16 | windows << 8 | offset
    of the anchor.
    """
    sizes = np.array([len(v) for v in values], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(values), np.uint8)
    hashes, offset, start, count = anchors(data, ends, length)
    row = np.searchsorted(ends, start, "right")
    power, inverse = _tables(data.size + 1)
    upto = np.zeros(data.size + 1, np.uint64)
    np.cumsum(BYTES[data] * power[: data.size], out=upto[1:], dtype=np.uint64)
    shape = (count << 8) | offset
    segment = mix((upto[start + count - 1 + length] - upto[start]) * inverse[start] + shape.astype(np.uint64))
    return row, hashes, segment, ((start - ends[row] + sizes[row]) << 16) | shape


def _merged(keys: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Intervals of equal keys that touch, made one."""
    if not start.size:
        return keys, start, end
    order = np.lexsort((start, *keys[::-1]))
    keys, start, end = [k[order] for k in keys], start[order], end[order]
    new = np.ones(start.size, bool)
    same = np.ones(start.size - 1, bool)
    for k in keys:
        same &= k[1:] == k[:-1]
    group = np.concatenate([[0], np.cumsum(~same)])
    reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)
    new[1:] = ~same | (start[1:] > reach[:-1])
    heads = np.flatnonzero(new)
    return [k[heads] for k in keys], start[heads], reach[np.append(heads[1:], start.size) - 1]


_ROWS = "anchor long, segment long, doc long, tie int, place long"


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """A row for each anchor and distinct segment that a task holds.

    Repeats within the task are known already; they go as intervals under a number of their own, with the place
    -1 - start and the end as segment.
    """

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, segment, doc, tie, place = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((place, doc, segment, anchor))
        anchor, segment, doc, tie, place = (c[order] for c in (anchor, segment, doc, tie, place))
        head = np.ones(anchor.size, bool)
        head[1:] = (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1])
        first = np.maximum.accumulate(np.where(head, np.arange(anchor.size), 0))
        later = (doc > doc[first]) | ((doc == doc[first]) & (place > place[first]))
        start = place[later] >> 16
        (d, t), a, b = _merged([doc[later], tie[later]], start, start + ((place[later] >> 8) & 255) - 1 + length)
        sent = ~later
        number = mix(d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + a.astype(np.uint64)).view(np.int64)
        columns = [
            np.concatenate([anchor[sent].view(np.int64), number]),
            np.concatenate([segment[sent].view(np.int64), b]),
            np.concatenate([doc[sent], d]),
            np.concatenate([tie[sent], t]),
            np.concatenate([place[sent], -1 - a]),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "segment", "doc", "tie", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            values, ids = raw_texts(batch, "text"), batch.column("doc").to_numpy(zero_copy_only=False)
            at = 0
            while at < len(values):
                n, upto = 0, at
                while upto < len(values) and (n == 0 or n + len(values[upto]) <= CHUNK):
                    n += len(values[upto])
                    upto += 1
                group = values[at:upto]
                row, anchor, segment, place = _segments(group, length)
                tie = np.array([zlib.crc32(v) & 0x7FFFFFFF for v in group], np.int32)
                held.append((anchor, segment, ids[at:upto][row].astype(np.int64), tie[row], place))
                size += row.size
                at = upto
                if size >= HELD:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return docs.select("doc", "text").mapInArrow(run, _ROWS)


_SYMBOLS = 7  # symbols of 9 bits in the first key


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of an array of symbols (0 ends a segment) in the order of their first `depth` symbols at least."""
    n = text.size
    key = np.zeros(n, np.int64)
    for i in range(_SYMBOLS):
        key <<= 9
        key[: n - i] |= text[i:]
    done = _SYMBOLS
    while True:
        order = np.argsort(key)
        if done >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
        key = rank << 32
        key[: n - done] |= rank[done:]
        done *= 2


def common_prefixes(text: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of `length` symbols that occur twice or more, and their classes.

    `text` holds segments, each with `counts` windows and a 0 behind it. Breadth-first backward extension: level 1
    has an interval for each symbol that ends a window; the intervals of level l + 1 are those of level l with a
    symbol put before, found through the transform's mapping from a suffix to the one a symbol longer. Intervals of
    one suffix are dropped.
    """
    order = suffix_order(text, length)
    place = np.empty(order.size, np.int32)
    place[order] = np.arange(order.size, dtype=np.int32)
    longer = place[order - 1]
    head = text[order].astype(np.int16)
    last = np.repeat(starts + length - 1 - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    marked, after = np.zeros(order.size, bool), np.empty(order.size, np.int32)
    rows, group = place[last], np.zeros(last.size, np.int32)
    for level in range(length):
        if level:
            rows = longer[rows]
        marked[rows] = True
        after[rows] = group
        rows = np.flatnonzero(marked).astype(np.int32)
        marked[rows] = False
        a, h = after[rows], head[rows]
        new = np.ones(rows.size + 1, bool)
        new[1:-1] = (a[1:] != a[:-1]) | (h[1:] != h[:-1])
        shared = ~(new[1:] & new[:-1])
        group = np.cumsum(new[:-1], dtype=np.int32)[shared]
        rows = rows[shared]
        if not rows.size:
            break
    return order[rows], group


_INTERVAL = "doc long, tie int, start int, stop int"
_SEGMENT_ROWS = "anchor long, doc long, tie int, start int, bytes binary"


def _interval_batch(keys: list[np.ndarray], start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    (doc, tie), a, b = _merged(keys, start.astype(np.int64), stop.astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(tie.astype(np.int32)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["doc", "tie", "start", "stop"])


def _block_intervals(segments: list[tuple], length: int) -> pa.RecordBatch:
    """Repeats among the segments of whole anchors."""
    data = b"".join(s[4] for s in segments)
    sizes = np.array([len(s[4]) for s in segments], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(len(data) + sizes.size, np.int16)
    text[np.arange(len(data)) + np.repeat(np.arange(sizes.size), sizes)] = np.frombuffer(data, np.uint8).astype(np.int16) + 1
    at, group = common_prefixes(text, starts, sizes - length + 1, length)
    number = np.searchsorted(starts, at, "right") - 1
    doc, tie, first = (np.array([s[i] for s in segments], np.int64) for i in (1, 2, 3))
    doc, tie, start = doc[number], tie[number], first[number] + at - starts[number]
    order = np.lexsort((start, doc, group))
    doc, tie, start, group = doc[order], tie[order], start[order], group[order]
    head = np.ones(group.size, bool)
    head[1:] = group[1:] != group[:-1]
    lead = np.maximum.accumulate(np.where(head, np.arange(group.size), 0))
    later = (doc > doc[lead]) | (start > start[lead]) & (doc == doc[lead])
    return _interval_batch([doc[later], tie[later]], start[later], start[later] + length)


def _expand(segments: DataFrame, length: int) -> DataFrame:
    """Repeats among segments that are dealt and sorted by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "tie", "start", "bytes"))):
                if size >= BLOCK and row[0] != held[-1][0]:
                    yield _block_intervals(held, length)
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) + 1
        if held:
            yield _block_intervals(held, length)

    return segments.mapInArrow(run, _INTERVAL)


def _windows(segments: DataFrame, length: int) -> DataFrame:
    """window hash, doc, tie, start of every window of the segments of hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            out = []
            for doc, tie, start, data in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "start", "bytes"))):
                h = window_hashes(np.frombuffer(data, np.uint8), length)
                out.append((h.view(np.int64), np.full(h.size, doc), np.full(h.size, tie, np.int32), (start + np.arange(h.size)).astype(np.int32)))
            if out:
                columns = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["window", "doc", "tie", "start"])

    return segments.mapInArrow(run, "window long, doc long, tie int, start int")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.col(text_col).alias("text"))


def _tie():
    return F.crc32(F.coalesce("text", F.lit("")).cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def find_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, hot: int = HOT) -> DataFrame:
    """doc, tie (crc32 of the text, 31 bits) and runs: the merged byte ranges of a text that repeat an earlier start."""
    text_batches(docs.sparkSession)
    given = _keyed(docs, id_col, text_col)
    rows = _anchor_rows(given, length).repartition("anchor")
    start = F.shiftright("place", 16)
    count = F.shiftright("place", 8).bitwiseAND(F.lit(255))
    same = Window.partitionBy("anchor", "segment").orderBy("doc", start)
    around = Window.partitionBy("anchor")
    ranked = rows.withColumn("rank", F.rank().over(same)).withColumn("segments", F.sum((F.col("rank") == 1).cast("long")).over(around))
    found = materialize(
        ranked.filter("place < 0 or rank > 1 or segments > 1").select(
            "anchor",
            "doc",
            "tie",
            F.expr("if(place < 0, -1 - place, shiftright(place, 16))").cast("int").alias("start"),
            F.when(F.col("place") < 0, F.col("segment")).otherwise(start + count + (length - 1)).cast("int").alias("stop"),
            F.expr("if(place < 0 or rank > 1, null, segments)").alias("segments"),
        ),
        "repeats-found",
    )
    asked = found.filter("segments is not null").groupBy("doc", "tie").agg(F.collect_list(F.struct("anchor", "start", "stop", "segments")).alias("asked"))
    keyed = given.withColumn("tie", _tie())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, tie, text, wanted in zip(batch.column("doc").to_pylist(), batch.column("tie").to_pylist(), raw_texts(batch, "text"), batch.column("asked").to_pylist()):
                out += [(w["anchor"], doc, tie, w["start"], text[w["start"] : w["stop"]], w["segments"]) for w in wanted]
            columns = list(zip(*out)) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["anchor", "doc", "tie", "start", "bytes", "segments"])

    segments = keyed.join(asked, ["doc", "tie"]).select("doc", "tie", "text", "asked").mapInArrow(cut, f"{_SEGMENT_ROWS}, segments long")
    segments = materialize(segments, "repeats-segments")
    blocks = segments.filter(F.col("segments") <= hot).repartition("anchor").sortWithinPartitions("anchor").drop("segments")
    intervals = found.filter("segments is null").select("doc", "tie", "start", "stop").unionByName(_expand(blocks, length))
    hot_segments = segments.filter(F.col("segments") > hot)
    if not hot_segments.isEmpty():
        windows = materialize(_windows(hot_segments, length), "repeats-windows")
        first = windows.groupBy("window").agg(F.min(F.struct("doc", "start")).alias("first"))
        later = windows.join(first, "window").filter(F.struct("doc", "start") > F.col("first"))
        intervals = intervals.unionByName(later.select("doc", "tie", "start", (F.col("start") + length).alias("stop")))

    return intervals.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, hot: int = HOT) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept (the bytes that are left) of every row of `docs`."""
    runs = find_repeats(docs, id_col=id_col, text_col=text_col, length=length, hot=hot)
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text")).withColumns({"doc": F.coalesce(F.col("id_").cast("long"), F.lit(LAST)), "tie": _tie()})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, kept = [], [], [], []
            for text, found in zip(raw_texts(batch, "text"), batch.column("runs").to_pylist()):
                pieces, upto, count, gone = [], 0, 0, 0
                stop = -1
                for r in sorted((r["start"], r["stop"]) for r in found or ()):
                    if r[0] > stop:
                        count += 1
                        pieces.append(text[upto : r[0]])
                    else:
                        r = (stop, max(stop, r[1]))
                    gone += r[1] - r[0]
                    stop = upto = r[1]
                pieces.append(text[upto:])
                n.append(len(text))
                removed.append(gone)
                spans.append(count)
                kept.append(b"".join(pieces))
            columns = [batch.column("id_"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id_", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = given.join(runs, ["doc", "tie"], "left").select("id_", "text", "runs")
    out = joined.mapInArrow(cut, f"id_ {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id_", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
