"""Benchmark decontamination by template windows with slot checks.

A text becomes a sequence of template tokens: words are stripped of outer punctuation and
folded to lower case; numbers (digits and number words), units after a number, and
capitalised words inside a sentence become the placeholders NUM, UNIT and NAME, and what
they stood for is kept as a slot. Names in a row are one NAME, number words behind a number
one NUM: "Anna Maria" may stand for "Alice", "twenty five" for "12". A name's slot is its last word. Capitals are those of
ASCII and Latin-1; number words and units are English, in other languages only digits and
names are slots. Windows of ``WINDOW`` tokens (whole items where they are
shorter, from ``LEAST`` tokens) of which at least half are fixed words are hash-joined
between documents and benchmark items. A bitmap of fixed size, built from the benchmark,
is broadcast and drops all other document windows before the shuffle.

A window that opens with a capitalised word is joined with that word both as it is and as
NAME. Items without a half fixed window (lists of numbers or names) have windows of their
exact words. Items of fewer than ``GAPPED`` tokens, which one changed word can leave without
enough windows, also have windows of ``WINDOW`` tokens around one that may differ.

A document leaks an item when the slots are consistent on an alignment and the windows it
shares cover at least ``coverage`` of the item's windows, or ``RUN`` tokens in a row, or
``TOKENS`` of an item's tokens with one changed word. Slots are consistent when a name or
unit of the item always stands against one of the document; equal numbers may become
different ones. Equal slots throughout make the leak ``verbatim``, other consistent slots
and a changed word ``reparameterised``.

Null and empty texts, and items of fewer than ``LEAST`` tokens, match nothing. Repeated
rows count once. A null key is carried like any other value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.llm.arrow_text import LOWER_ASCII, gathered, lookup, map_text, mix, span_hashes, words
from rolloom.session import checkpointed

WINDOW, LEAST, COVERAGE = 8, 4, 0.5
#: Tokens in a row that are a leak; items with gapped windows have fewer tokens than GAPPED, of which TOKENS must be shared.
RUN, GAPPED, TOKENS = 14, 23, 2 / 3
#: Places of the gap in windows of WINDOW + 1 tokens, and the mark of windows of exact words.
GAPS, EXACT = (2, 4, 6), 8
#: Bits of the broadcast bitmap: 8 MB.
BITS = 1 << 26
#: Number words and units of measure.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces "
    "pound pounds ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week "
    "weeks month months year years mph kph volt volts watt watts kw kwh hz khz mhz ghz byte bytes kb mb gb tb "
    "degree degrees percent dollar dollars cent cents euro euros"
).split()
_NUM, _UNIT, _NAME = (np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x510E527FADE682D1))
_P, _PAIR = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _flags(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_DIGIT, _UPPER, _LOWER = _flags(b"0123456789"), _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))
_PUNCTUATION = _flags(bytes(b for b in range(33, 127) if not chr(b).isalnum()))
_IN_NUMBER, _ENDS = _flags(b"0123456789.,:/%+-$"), _flags(b".!?:;")
_CLOSES = _flags(b"\"')]}.!?:;")


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8 bytes."""
    out = LOWER_ASCII[data]
    if len(data) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][latin] += 32
    return out


#: Bits of a byte: a digit, no part of a number, a line end.
_CLASS = _DIGIT * np.uint8(1) + ~_IN_NUMBER * np.uint8(2) + _flags(b"\n") * np.uint8(4)


def _spans(marks: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bits of the bytes of each span, and of those between it and the next one."""
    edges = np.empty(2 * len(start), np.int64)
    edges[::2], edges[1::2] = start, end
    edges = np.append(edges, len(marks))
    out = np.bitwise_or.reduceat(np.append(marks, np.uint8(0)), edges)
    # an empty stretch gives the byte at its begin
    out[:-1][edges[:-1] == edges[1:]] = 0
    return out[:-1:2], out[1:-1:2]


def _small(data: np.ndarray, lower: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a lower-case letter, or one that has no case here, begins at a byte."""
    after = np.minimum(at + 1, len(data) - 1)
    return _LOWER[data[at]] | (data[at] > 0xC3) | ((data[at] == 0xC3) & (at + 1 < len(data)) & (lower[after] == data[after]))


def _known(listed: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(listed).encode(), np.uint8)
    length = np.array([len(x) for x in listed])
    return np.sort(span_hashes(data, np.cumsum(length) - length, length))


@dataclass
class Template:
    """Template tokens of a text column: row, symbol, slot value (0 for fixed words), the tokens before each row, word, and which open a sentence like a name.

    The low bits of a slot value are 1 for numbers and 3 for units and names.
    """

    row: np.ndarray
    symbol: np.ndarray
    slot: np.ndarray
    bounds: np.ndarray
    value: np.ndarray
    may: np.ndarray

    def __post_init__(self):
        self.of_symbols, self.of_values = Rolling(self.symbol), Rolling(self.value)


def template(column: pa.Array, numbers: np.ndarray, units: np.ndarray) -> Template:
    """Template tokens of a text column."""
    w = words(column, hashed=False)
    data, row = w.data, w.row
    n_rows = len(w.offsets) - 1
    if not len(w.start):
        return Template(row, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))
    lower = folded(data)
    start, end = w.start.copy(), w.end.copy()
    # a sentence ends with a mark, also before closing quotes, or with a line
    last = end - 1
    mark = _ENDS[data[last]] | (_CLOSES[data[last]] & _ENDS[data[np.maximum(last - 1, start)]])
    marks = _CLASS[data]
    _, between = _spans(marks, start, end)
    opens = np.ones(len(start), bool)
    opens[1:] = mark[:-1] | (between[:-1] & 4 > 0) | (row[1:] != row[:-1])
    going = np.arange(len(start))
    while len(going):
        going = going[(start[going] < end[going]) & _PUNCTUATION[data[np.minimum(start[going], len(data) - 1)]]]
        start[going] += 1
    going = np.arange(len(start))
    while len(going):
        going = going[(start[going] < end[going]) & _PUNCTUATION[data[end[going] - 1]]]
        end[going] -= 1
    kept = start < end
    # a mark of its own still ends the sentence before the next word
    opens = opens | np.concatenate([[False], (~kept & mark)[:-1]])
    start, end, row, opens, whole_start, whole_end = start[kept], end[kept], row[kept], opens[kept], w.start[kept], w.end[kept]
    if not len(start):
        return Template(row, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))
    length = end - start
    value = span_hashes(lower, start, length)
    holds, _ = _spans(marks, start, end)
    worded = lookup(numbers, value) >= 0
    number = ((holds & 1 > 0) & ((holds & 2 == 0) | _DIGIT[data[start]])) | worded
    after_number = np.zeros(len(start), bool)
    after_number[1:] = number[:-1] & (row[1:] == row[:-1])
    unit = after_number & (lookup(units, value) >= 0) & ~number
    # the next letter must be lower case, else the word is in capitals
    ascii_name, latin_name = np.zeros(len(start), bool), np.zeros(len(start), bool)
    at = np.flatnonzero(_UPPER[data[start]] & (length > 1))
    ascii_name[at] = _small(data, lower, start[at] + 1)
    at = np.flatnonzero((data[start] == 0xC3) & (length > 2))
    at = at[lower[start[at] + 1] != data[start[at] + 1]]
    latin_name[at] = _small(data, lower, start[at] + 2)
    name = (ascii_name | latin_name) & ~opens & ~number
    may = (ascii_name | latin_name) & opens & ~number & ~unit
    # names in a row with nothing between them are one name, number words behind a number one number
    tight = np.zeros(len(start), bool)
    tight[1:] = (row[1:] == row[:-1]) & (end[:-1] == whole_end[:-1]) & (start[1:] == whole_start[1:]) & ~opens[1:]
    joins = np.zeros(len(start), bool)
    joins[1:] = tight[1:] & ((name[1:] & name[:-1]) | (worded[1:] & number[:-1]))
    lead = np.flatnonzero(~joins)
    size = np.diff(np.append(lead, len(start)))
    # a name is told by its last word: the first one may open a sentence, where it is no name yet
    run, told = value[lead].copy(), value[lead + size - 1]
    for k in range(1, int(size.max())):
        more = np.flatnonzero(size > k)
        run[more] = mix(run[more] * _PAIR + value[lead[more] + k])
    row, number, unit, name, may = row[lead], number[lead], unit[lead], name[lead], may[lead]
    symbol = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, run)))
    slot = np.where(number, run & ~np.uint64(3) | np.uint64(1), np.where(unit, run | np.uint64(3), np.where(name, told | np.uint64(3), np.uint64(0))))
    return Template(row, symbol, slot, np.searchsorted(row, np.arange(n_rows + 1)), run, may)


class Rolling:
    """Polynomial hashes of every stretch of a sequence, from its running sums; two operations each."""

    _up, _down = np.ones(1, np.uint64), np.ones(1, np.uint64)
    _inverse = np.uint64(pow(int(_P), -1, 1 << 64))

    def __init__(self, values: np.ndarray):
        n = len(values) + 64
        if len(Rolling._up) < n:
            steps = np.full(2 * n, _P, np.uint64)
            steps[0] = 1
            Rolling._up = np.cumprod(steps)
            steps[1:] = Rolling._inverse
            Rolling._down = np.cumprod(steps)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self._down[: len(values)])])

    def of(self, first: int, length: int, n: int) -> np.ndarray:
        """Hashes of the stretches of ``length`` that begin at ``first`` and the ``n - 1`` places behind it."""
        if not length:
            return np.zeros(n, np.uint64)
        parts = self.sums[first + length : first + length + n] - self.sums[first : first + n]
        return parts * self._up[first + length - 1 : first + length - 1 + n]


def windows(t: Template, length: int, gap: int = 0, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, hash, and whether the first word is folded to NAME, of each window of ``length`` tokens with at least half fixed words.

    With ``gap`` that token of the window is left out. With ``exact`` the windows are the others, and of words.
    """
    n = len(t.symbol) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    own = t.of_values if exact else t.of_symbols
    if gap:
        h = own.of(0, gap, n) * Rolling._up[length - 1 - gap] + own.of(gap + 1, length - 1 - gap, n)
    else:
        h = own.of(0, length, n)
    h = h + np.uint64((length + 16 * gap + 256 * exact) * int(_PAIR) % (1 << 64))
    top = Rolling._up[length - 1 - bool(gap)]
    fixed = np.concatenate([[0], np.cumsum(t.slot == 0)])
    count, size = fixed[length:] - fixed[:n], length
    if gap:
        count, size = count - (t.slot[gap : n + gap] == 0), length - 1
    inside = t.row[:n] == t.row[length - 1 :]
    if exact:
        at = np.flatnonzero(inside & (2 * count < size))
        return at, mix(h[at]), np.zeros(len(at), bool)
    whole, opened = np.flatnonzero(inside & (2 * count >= size)), np.flatnonzero(inside & t.may[:n] & (2 * (count - 1) >= size))
    other = h[opened] + (_NAME - t.symbol[opened]) * top
    return np.concatenate([whole, opened]), mix(np.concatenate([h[whole], other])), np.repeat([False, True], [len(whole), len(opened)])


def _windowed(docs: DataFrame, text: str, keep: list[str], lengths: list[int] | None, bitmap) -> DataFrame:
    """Windows of every text: ``pos``, ``window``, ``slots``, ``shape`` (0, place of the gap, or EXACT) and ``tokens`` of the text.

    With ``lengths`` None each text uses its own length where it is shorter than a window.
    """
    numbers, units = _known(NUMBER_WORDS), _known(UNITS)
    shape = "array<struct<pos:int,window:bigint,slots:array<bigint>,shape:int,tokens:int>>"

    def start():
        bits = bitmap.value if bitmap is not None else None

        def each(column):
            t = template(column, numbers, units)
            n_rows = len(t.bounds) - 1
            sizes = np.diff(t.bounds)
            parts = []
            plain = list(range(LEAST, WINDOW + 1)) if lengths is None else lengths
            for length, kind in [*((x, 0) for x in plain), *((WINDOW + 1, g) for g in GAPS), *((x, EXACT) for x in plain)]:
                at, h, folds = windows(t, length, kind % EXACT, kind == EXACT)
                if lengths is None and length != WINDOW:
                    own = sizes[t.row[at]] < GAPPED if length > WINDOW else sizes[t.row[at]] == length
                    at, h, folds = at[own], h[own], folds[own]
                if bits is not None:
                    p = (h % np.uint64(BITS)).astype(np.int64)
                    hit = (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
                    at, h, folds = at[hit], h[hit], folds[hit]
                parts.append((at, h, folds, np.full(len(at), length), np.full(len(at), kind, np.int32)))
            at, h, folds, length, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(at, kind="stable")
            at, h, folds, length, kind = at[order], h[order], folds[order], length[order], kind[order]
            slots = gathered(t.slot, at, length) if len(at) else np.zeros(0, np.uint64)
            first = np.cumsum(length) - length
            slots[first[folds]] = t.value[at[folds]] | np.uint64(3)
            gapped = (kind > 0) & (kind < EXACT)
            slots[(first + kind)[gapped]] = 0
            # equal words have equal slots
            slots[np.repeat(kind == EXACT, length)] = 0
            owner = np.repeat(np.arange(len(at)), length)[slots != 0]
            bounds = np.searchsorted(owner, np.arange(len(at) + 1)).astype(np.int32)
            slot_lists = pa.ListArray.from_arrays(bounds, pa.array(slots[slots != 0].view(np.int64)))
            structs = pa.StructArray.from_arrays(
                [pa.array((at - t.bounds[t.row[at]]).astype(np.int32)), pa.array(h.view(np.int64)), slot_lists, pa.array(kind), pa.array(sizes[t.row[at]].astype(np.int32))],
                ["pos", "window", "slots", "shape", "tokens"],
            )
            per_row = np.searchsorted(t.row[at], np.arange(n_rows + 1)).astype(np.int32)
            return [pa.ListArray.from_arrays(per_row, structs)]

        return each

    return map_text(docs, text, keep, {"found": shape}, start)


_ITEM = ["id", "h", "item", "total", "tokens"]


def _consistent(met: DataFrame) -> DataFrame:
    """Shared windows on alignments with consistent slots: ``_ITEM``, ``shift``, ``ipos``, ``shape``, and ``other`` where slots differ."""
    keys = [*_ITEM, "shift"]
    pairs = met.select(*keys, F.inline(F.arrays_zip(F.col("islots").alias("theirs"), F.col("slots").alias("ours"))))
    mapped = pairs.groupBy(*keys, "theirs").agg(F.min("ours").alias("least"), F.max("ours").alias("most"))
    named = F.col("theirs").bitwiseAND(F.lit(2)) != 0
    aligned = mapped.groupBy(*keys).agg(
        F.max(named & (F.col("least") != F.col("most"))).alias("clash"), F.max((F.col("least") != F.col("theirs")) | (F.col("most") != F.col("theirs"))).alias("other")
    )
    left, right = met.select(*keys, "ipos", "shape").distinct(), aligned.select(*[F.col(k).alias(f"_{k}") for k in keys], "clash", "other")
    same = left["id"].eqNullSafe(right["_id"]) & left["item"].eqNullSafe(right["_item"])
    for k in ("h", "total", "tokens", "shift"):
        same = same & (left[k] == right[f"_{k}"])
    good = left.join(right, same, "left").where(~F.coalesce("clash", F.lit(False)))
    return good.select(*keys, "ipos", "shape", F.coalesce("other", F.lit(False)).alias("other"))


def _by_alignment(good: DataFrame) -> DataFrame:
    """Per alignment: ``n`` windows without a gap, ``shared`` tokens, the longest ``run`` of them, whether there is a ``hole`` between them, and ``other``. Lists are as long as an item at most."""
    gap = (F.col("shape") > 0) & (F.col("shape") < EXACT)
    last = F.col("ipos") + F.when(gap, WINDOW).otherwise(F.least(F.lit(WINDOW), "tokens") - 1)
    held = F.filter(F.sequence("ipos", last), lambda p: ~gap | (p != F.col("ipos") + F.col("shape")))
    sets = good.withColumn("held", held).groupBy(*_ITEM, "shift").agg(
        F.count_distinct(F.when(~gap, F.col("ipos"))).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("held")))).alias("p"), F.max("other").alias("other")
    )
    longest = F.expr(
        "aggregate(p, named_struct('at', -2, 'run', 0, 'best', 0), (a, x) -> named_struct('at', x, 'run', if(x = a.at + 1, a.run + 1, 1), 'best', greatest(a.best, if(x = a.at + 1, a.run + 1, 1))), a -> a.best)"
    )
    return sets.select(*_ITEM, "n", F.size("p").alias("shared"), longest.alias("run"), (F.element_at("p", -1) - F.element_at("p", 1) >= F.size("p")).alias("hole"), "other")


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", coverage: float = COVERAGE
) -> DataFrame:
    """One row per document and leaked item: the key, ``h`` (hash of the text), the item, ``coverage`` and ``kind``."""
    spark = docs.sparkSession
    own = _windowed(benchmark, item_text, [item], None, None).where(F.size("found") > 0).select(F.col(item).alias("item"), "found")

    def places(shape: int):
        return F.size(F.array_distinct(F.transform(F.filter("found", lambda x: x["shape"] == shape), lambda x: x["pos"])))

    own = own.select("item", places(0).alias("fixed"), places(EXACT).alias("words"), F.inline("found"))
    own = own.where(F.when(F.col("fixed") > 0, F.col("shape") != EXACT).otherwise(F.col("shape") == EXACT))
    # a repeated item id with other texts counts as one item per text
    own = checkpointed(own.withColumn("total", F.when(F.col("fixed") > 0, F.col("fixed")).otherwise(F.col("words"))).drop("fixed", "words").distinct(), "items")
    # BITS is a power of two, so the remainder is the same for signed hashes; bitmap positions count from 1
    p = F.pmod(F.col("window"), F.lit(BITS)) + 1
    blocks = own.select(p.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    bits = np.zeros(BITS // 8, np.uint8)
    for b in blocks:
        bits[(b["b"] - 1) * 4096 : b["b"] * 4096] = np.frombuffer(b["m"], np.uint8)
    bitmap = spark.sparkContext.broadcast(bits)
    lengths = list(range(LEAST, WINDOW + 1))

    tagged = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).withColumn("h", F.xxhash64(F.coalesce("t", F.lit(""))))
    seen = _windowed(tagged, "t", ["id", "h"], lengths, bitmap).where(F.size("found") > 0).select("id", "h", F.inline("found")).drop("shape", "tokens")
    items = own.select("item", "total", "tokens", "shape", F.col("pos").alias("ipos"), "window", F.col("slots").alias("islots"))
    met = checkpointed(seen.join(items, "window").select(*_ITEM, "ipos", "shape", (F.col("pos") - F.col("ipos")).alias("shift"), "slots", "islots").distinct(), "met")

    good = checkpointed(_consistent(met.where(F.col("shape").isin(0, EXACT))), "good")
    out = good.groupBy(*_ITEM).agg(F.countDistinct("ipos").alias("n"), F.max("other").alias("other")).where(F.col("n") / F.col("total") >= coverage)
    runs = _by_alignment(good).where(F.col("run") >= RUN)
    # an alignment with a gapped window, and the gap differs: one word is changed
    gaps = met.where(~F.col("shape").isin(0, EXACT)).select(*[F.col(k).alias(f"_{k}") for k in [*_ITEM, "shift"]]).distinct()
    there = met["id"].eqNullSafe(gaps["_id"]) & met["item"].eqNullSafe(gaps["_item"])
    for k in ("h", "total", "tokens", "shift"):
        there = there & (met[k] == gaps[f"_{k}"])
    changed = _by_alignment(_consistent(met.join(gaps, there, "left_semi"))).where(F.col("hole") & (F.col("shared") >= TOKENS * F.col("tokens"))).withColumn("other", F.lit(True))
    columns = ["id", "h", "item", "total", "n", "other"]
    out = out.select(columns).union(runs.select(columns)).union(changed.select(columns)).withColumn("coverage", F.col("n") / F.col("total"))
    kind = F.when(F.col("other"), "reparameterised").otherwise("verbatim").alias("kind")
    best = out.groupBy("id", "h", "item").agg(F.max_by(F.struct("coverage", "other"), F.struct("coverage", ~F.col("other"))).alias("b"))
    return best.select(F.col("id").alias(key), "h", F.col("item").alias(item), "b.coverage", "b.other").select(key, "h", item, "coverage", kind)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that leak no item, with all their columns."""
    found = leaks(docs, benchmark, key, text).select(F.col(key).alias("_id"), F.col("h").alias("_h")).distinct()
    hashed = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    return docs.join(found, docs[key].eqNullSafe(found["_id"]) & (hashed == found["_h"]), "left_anti")
