"""Text columns of Arrow batches as numpy arrays: slices, words and word hashes.

A word is ``[^\\x20\\x09-\\x0D]+``; those separators are single bytes in UTF-8, so words are
found and hashed on bytes without making one Python object per word. Hashes have 64 bits:
two of ten million different words meet with a chance near 3e-6.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: Bytes of text handled at once; a longer single text makes a slice of its own.
SLICE_BYTES = 3 << 20
#: Bytes hashed at once inside a slice.
BLOCK_BYTES = 1 << 20

#: Characters with the property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash base, at least."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers), 256), _BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices of at most ``most`` bytes of text or one row."""
    if not batch.num_rows:
        return
    _, at = utf8(batch.column(column))
    row, n = 0, batch.num_rows
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        yield batch.slice(row, stop - row)
        row = stop


@dataclass
class Words:
    """Words of a text column, in order: byte spans, rows and hashes."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def bounds(self) -> np.ndarray:
        """Of each row, the number of words before it; one more at the end."""
        return np.searchsorted(self.start, self.offsets)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.bounds))


def span_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of each byte span; spans must be non-empty, in order, and not overlap."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(start, start[at] + BLOCK_BYTES)))
        lens = length[at:stop]
        first = np.cumsum(lens) - lens
        inside = np.arange(int(lens.sum())) - np.repeat(first, lens)
        index = inside + np.repeat(start[at:stop], lens)
        values = _BYTE[data[index]] * powers(int(lens.max()))[inside]
        out[at:stop] = np.add.reduceat(values, first)
        at = stop
    return mix(out)


def words(column: pa.Array, lower_ascii: bool = False, hashed: bool = True) -> Words:
    """All words of a string column; not ``hashed``, their hashes are left empty."""
    data, offsets = utf8(column)
    if lower_ascii:
        data = LOWER_ASCII[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(0, np.uint64))
    inner = ~IS_SPACE[data]
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    starts_row = offsets[:-1][np.diff(offsets) > 0]
    first[starts_row] = inner[starts_row]
    last = inner.copy()
    last[:-1] &= ~inner[1:]
    ends_row = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends_row] = inner[ends_row]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, offsets, start, end, span_hashes(data, start, end - start) if hashed and len(start) else np.zeros(0, np.uint64))


def gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The spans of ``data``, one after the other."""
    first = np.cumsum(length) - length
    return data[np.arange(int(length.sum())) + np.repeat(start - first, length)]


def lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted value in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the parts of ``values`` between bounds; empty parts give 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def letter_classes() -> np.ndarray:
    """Class of every code point: 1 letter, 2 number, 3 white space, 0 other."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN":
            table[cp] = 1 if kind == "L" else 2
    table[WHITE_SPACE] = 3
    return table


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points of valid UTF-8 bytes."""
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)


def map_text(
    df: DataFrame,
    text: str,
    keep: list[str],
    added: dict[str, str],
    start: Callable[[], Callable[[pa.Array], list]],
    most: int = SLICE_BYTES,
) -> DataFrame:
    """Columns ``keep`` of every row with columns computed from its text.

    ``start`` runs once per task and returns a function from a text column to one array
    or list per added column. Slices of at most ``most`` bytes of text bound the memory.
    """
    fields = [df.schema[c] for c in keep]
    extra = StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in added.items()))
    names = [f"k{i}" for i in range(len(keep))]
    inner = StructType([StructField(n, f.dataType, True) for n, f in zip(names, fields, strict=True)] + [StructField(f"a{i}", f.dataType, True) for i, f in enumerate(extra.fields)])
    types = [to_arrow_type(f.dataType) for f in extra.fields]

    def run(batches):
        each = start()
        for batch in batches:
            for part in slices(batch, "t", most):
                made = [a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(each(part.column(len(names))), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *made], inner.names)

    out = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).alias("t")).mapInArrow(run, inner)
    return out.toDF(*keep, *added)
