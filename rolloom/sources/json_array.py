"""JSON arrays read by many tasks.

A file that holds one JSON array has no line ends to cut it at. Two passes over its byte
ranges do: the first counts, per range, its quotes and what its brackets add to the depth,
once as if the range began outside a string and once as if inside. Running sums of these
small rows tell how every range begins. In the second pass each task finds the borders of
top-level elements in its range, and returns the elements that begin there as text; the last
one is read on past the range's end, in pieces that start small. Neighbouring ranges share a
task, so that small ranges make no more tasks than their bytes ask for. JSON is parsed by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rolloom.session import checkpointed
from rolloom.sources.store import open_store

#: Bytes whose borders one task finds, and bytes it holds at once.
RANGE_BYTES, CHUNK_BYTES = 32 << 20, 4 << 20
#: Tasks among which ranges are dealt one by one; beyond them a task has ``RANGE_BYTES`` of ranges.
LEAST_TASKS, MOST_TASKS = 64, 10_000
#: First piece that is read past the end of a range; each next one is twice as long.
BEYOND_BYTES = 4096

_QUOTE, _ESCAPE = ord('"'), ord("\\")
_STEP = np.zeros(256, np.int8)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1


def _escapes_before(stream, at: int) -> int:
    """Backslashes that stand directly before a byte."""
    n = 0
    while at > 0:
        size = min(4096, at)
        stream.seek(at - size)
        part = stream.read(size)
        bare = part.rstrip(b"\\")
        n += len(part) - len(bare)
        if bare:
            break
        at -= size
    return n


def _quotes(data: np.ndarray, escapes: int) -> tuple[np.ndarray, int]:
    """Which bytes are quotes that open or close a string, and the backslashes at the end."""
    place = np.arange(len(data))
    other = np.where(data != _ESCAPE, place, -1)
    last = np.maximum.accumulate(other)
    run = np.concatenate([[escapes], np.where(last >= 0, place - last, place + 1 + escapes)])
    return (data == _QUOTE) & (run[:-1] % 2 == 0), int(run[-1])


def _chunks(stream, start: int, stop: int, chunk: int, border: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Place, bytes and quotes of a range, piece by piece; no piece crosses ``border``, and those behind it grow from a small one."""
    escapes = _escapes_before(stream, start)
    border, beyond = stop if border is None else border, BEYOND_BYTES
    while start < stop:
        wanted = border - start
        if wanted <= 0:
            wanted, beyond = beyond, 2 * beyond
        stream.seek(start)
        data = np.frombuffer(stream.read(min(chunk, wanted, stop - start)), np.uint8)
        if not len(data):
            return
        marks, escapes = _quotes(data, escapes)
        yield start, data, marks
        start += len(data)


def _counted(stream, start: int, stop: int, chunk: int) -> tuple[int, int, int]:
    """Quotes of a range, and its change of depth if it begins outside or inside a string."""
    quotes, outside, inside = 0, 0, 0
    for _, data, marks in _chunks(stream, start, stop, chunk):
        within = (quotes + np.cumsum(marks)) % 2 == 1
        steps = _STEP[data].astype(np.int64)
        outside += int(steps[~within].sum())
        inside += int(steps[within].sum())
        quotes += int(marks.sum())
    return quotes, outside, inside


def _elements(stream, start: int, stop: int, size: int, quotes: int, depth: int, chunk: int) -> Iterator[bytes]:
    """Texts of the elements whose left border is in a range that begins in a known state."""
    parts: list[bytes] | None = None
    for at, data, marks in _chunks(stream, start, size, chunk, stop):
        within = (quotes + np.cumsum(marks)) % 2 == 1
        steps = np.where(within, 0, _STEP[data])
        after = depth + np.cumsum(steps)
        comma = (data == ord(",")) & ~within & (after == 1)
        opens = (steps == 1) & (after == 1) & (data == ord("["))
        closes = (steps == -1) & (after == 0)
        raw = data.tobytes()
        left = 0
        for place in np.flatnonzero(comma | opens | closes):
            if parts is not None:
                yield b"".join([*parts, raw[left:place]])
                parts = None
            if at + place >= stop:
                return
            if not closes[place]:
                parts, left = [], int(place) + 1
        if parts is None and at + len(data) >= stop:
            return
        if parts is not None:
            parts.append(raw[left:])
        quotes, depth = quotes + int(marks.sum()), int(after[-1])
    if parts is not None:
        raise ValueError("a JSON array ends inside an element")


def _opened(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of ranges, each behind the open file that its ``path`` names; neighbours share it."""
    for name, rows in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=itemgetter(0)):
        store, inner = open_store(name)
        with store.open_input_file(inner) as stream:
            for row in rows:
                yield stream, *row


def array_elements(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Elements of the JSON arrays in files: ``path``, ``start`` (of the range an element begins in), ``place`` in it, and ``text``.

    An empty array has none. Files are UTF-8. Brackets must be balanced; a file that ends
    inside an element is an error.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = files.select("path", "size", cuts.alias("start"))
    ranges = ranges.withColumn("stop", F.least(F.col("start") + range_bytes, "size"))
    held = ranges.agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("size")).first()
    tasks = max(1, min(held["n"], max(LEAST_TASKS, -(-(held["size"] or 0) // RANGE_BYTES)), MOST_TASKS))

    def dealt(df: DataFrame) -> DataFrame:
        """Neighbouring ranges in one task, equally many in each."""
        return df.repartitionByRange(tasks, "path", "start").sortWithinPartitions("path", "start")

    def count(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for stream, name, size, start, stop in _opened(batch):
                rows.append((name, size, start, stop, *_counted(stream, start, stop, chunk_bytes)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "size", "start", "stop", "quotes", "outside", "inside"])

    counted = checkpointed(dealt(ranges).mapInArrow(count, "path string, size long, start long, stop long, quotes long, outside long, inside long"), "json-ranges")
    # one small row per range
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    state = counted.withColumn("q", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    change = F.when(F.col("q") == 0, F.col("outside")).otherwise(F.col("inside"))
    state = state.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    known = checkpointed(state.select("path", "size", "start", "stop", "q", "depth"), "json-states")

    def read(batches: Iterator[pa.RecordBatch]):
        names = ["path", "start", "place", "text"]
        for batch in batches:
            rows, held = [], 0
            for stream, name, size, start, stop, quotes, depth in _opened(batch):
                for place, raw in enumerate(_elements(stream, start, stop, size, quotes, depth, chunk_bytes)):
                    if raw.strip():
                        rows.append((name, start, place, raw.decode("utf-8", "replace")))
                        held += len(raw)
                    if held > chunk_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    return dealt(known).mapInArrow(read, "path string, start long, place long, text string")
