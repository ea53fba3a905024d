"""Alignment of two tokenizers over the same texts.

Tokenizer A is a byte-level BPE of the ``tokenizers`` library, B a ``sentencepiece`` BPE with
byte fallback; both read a space and the text. Their vocabulary files are read on the driver
and broadcast (their size is fixed). Byte spans of both are matched per batch by two
``merge_asof`` calls keyed by document: each token start finds the other side's covering
token. The union of both directions is every overlap; overlaps with equal ends cut the text
into groups, the smallest spans that both sides tile exactly.

Texts are tokenized by units: a run of spaces with what follows up to the next space after
other text. No pretoken of A and no piece of B goes past such a border (checked when the files
are loaded), so distinct units are encoded once per task, long texts are aligned in blocks of
whole units, and memory is bounded by ``BLOCK_TOKENS`` or the longest unit.

Null and empty texts, and texts that one side does not give back byte by byte (a literal
U+2581, invalid UTF-8), have no tokens. Repeated rows are documents of their own.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rolloom.llm import bpe
from rolloom.llm.arrow_text import gathered, row_sums, slices
from rolloom.llm.skew import join_counted
from rolloom.session import checkpointed

#: Tokens of both sides aligned at once; a longer unit makes a block of its own.
BLOCK_TOKENS = 1 << 18
#: Id pairs expanded at once.
BLOCK_PAIRS = 1 << 21
#: Distinct units kept per task between slices, and bytes of them.
CACHE_UNITS = 1 << 18
CACHE_BYTES = 1 << 25
#: Bytes of text handled at once.
SLICE_BYTES = 1 << 20
#: Pairs whose counts are broadcast: at most as many, of 24 bytes each.
HOT_PAIRS = 1 << 17

_BORDER = re.compile(r"(?<=\S)(?=\x20)")
_GAP = re.compile(r"\s\x20")
_SPACE = "▁"
_BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")


def default_paths() -> tuple[str, str]:
    """The vocabulary files of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _piece_bytes(piece: str) -> bytes:
    byte = _BYTE_PIECE.fullmatch(piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace(_SPACE, " ").encode()


class _Index(dict):
    """Numbers of units; one that is met first gets the next number and is noted as new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = at = len(self)
        self.new.append(unit)
        return at


@dataclass
class Units:
    """Token ids of distinct units of text, grown as units are met."""

    a_file: bytes
    b_file: bytes
    a_bytes: list[bytes]

    def __post_init__(self):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        self.a = Tokenizer.from_buffer(self.a_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_proto=self.b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(y == _SPACE != x for p in pieces for x, y in zip(p, p[1:], strict=False)):
            raise ValueError("pieces that go on past a space after other text are not supported")
        self.a_flat, self.b_flat = _flat(self.a_bytes), _flat([_piece_bytes(p) for p in pieces])
        self.a_len, self.b_len = self.a_flat[2], self.b_flat[2]
        if max(len(self.a_len), len(self.b_len)) > 1 << 20:
            raise ValueError("vocabularies of over a million tokens are not supported")
        lone = self.b.encode("a")
        self.space = self.b.encode("a ")[len(lone) :]
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.index = _Index()
        self.size = 0
        self.a_ids, self.b_ids = none, none
        self.a_at, self.a_n, self.b_at, self.b_n = none, none, none, none
        self.good = np.zeros(0, bool)

    def add(self, new: list[str]) -> None:
        """Encode new units, each given without the one space in front of it."""
        raw = [(" " + u).encode() for u in new]
        want, size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        a = [e.ids for e in self.a.encode_batch([" " + u for u in new], add_special_tokens=False)]
        b = [ids if u else self.space for u, ids in zip(new, self.b.encode(new, num_threads=1), strict=True)]
        good = np.ones(len(new), bool)
        self.size += len(want)
        for side, ids, flat in (("a", a, self.a_flat), ("b", b, self.b_flat)):
            n = np.array([len(x) for x in ids], np.int64)
            at = len(getattr(self, f"{side}_ids")) + np.cumsum(n) - n
            own = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
            good &= _same(own, n, flat, want, size)
            for name, more in (("ids", own), ("at", at), ("n", n)):
                setattr(self, f"{side}_{name}", np.concatenate([getattr(self, f"{side}_{name}"), more]))
        self.good = np.concatenate([self.good, good])

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """Units of each text, by index; an empty text has none."""
        number = self.index.__getitem__
        found = [np.fromiter(map(number, own), np.int64, len(own)) for own in (_units(t) if t else [] for t in texts)]
        if self.index.new:
            self.add(self.index.new)
            self.index.new = []
        return found


def _same(ids: np.ndarray, n: np.ndarray, flat: tuple[np.ndarray, np.ndarray, np.ndarray], want: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each unit, given as ``n`` ids and ``size`` bytes, whether its tokens' bytes are those bytes."""
    data, at, length = flat
    made = row_sums(length[ids], np.concatenate([[0], np.cumsum(n)]))
    good = made == size
    chosen = ids[np.repeat(good, n)]
    equal = gathered(data, at[chosen], length[chosen]) == want[np.repeat(good, size)]
    if not equal.all():
        own = np.repeat(np.flatnonzero(good), size[good])
        good[own[~equal]] = False
    return good


def _units(text: str) -> list[str]:
    """Units of space + text, each without the one space in front of it."""
    if _GAP.search(" " + text):
        return [u[1:] for u in _BORDER.split(" " + text)]
    return text.split(" ")


@dataclass
class Side:
    """Tokens of one tokenizer in a block: ids, documents, byte spans and groups."""

    ids: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    group: np.ndarray | None = None

    def frame(self, name: str) -> pd.DataFrame:
        return pd.DataFrame({"doc": self.doc, "start": self.start, name: np.arange(len(self.ids)), f"{name}_end": self.end})


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings as one array, with start and length of each."""
    length = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(length) - length, length


@dataclass
class Block:
    """Aligned tokens of whole units: both sides, all overlaps, and the group ends."""

    a: Side
    b: Side
    overlaps: tuple[pd.DataFrame, pd.DataFrame]
    cuts: np.ndarray


def aligned(units: Units, unit: np.ndarray, doc: np.ndarray) -> Block:
    """Match the tokens of units, given with the document of each; positions run through the block."""

    def side(ids, at, n, length):
        own = gathered(ids, at[unit], n[unit])
        size = length[own]
        end = np.cumsum(size)
        return Side(own, np.repeat(doc, n[unit]), end - size, end)

    a, b = side(units.a_ids, units.a_at, units.a_n, units.a_len), side(units.b_ids, units.b_at, units.b_n, units.b_len)
    left, right = a.frame("a"), b.frame("b")
    ways = (pd.merge_asof(left, right, on="start", by="doc"), pd.merge_asof(right, left, on="start", by="doc"))
    # overlaps with equal ends, from both directions
    is_cut = np.zeros(len(a.ids), bool)
    for way in ways:
        is_cut[way["a"].to_numpy()[way["a_end"].to_numpy() == way["b_end"].to_numpy()]] = True
    cuts = a.end[is_cut]
    a.group, b.group = (np.searchsorted(cuts, s.start, side="right") for s in (a, b))
    return Block(a, b, ways, cuts)


def blocks(units: Units, texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Units of texts and their text's number, in blocks of at most ``BLOCK_TOKENS`` tokens."""
    unit = np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    after = np.cumsum(units.a_n[unit] + units.b_n[unit])
    at, before = 0, 0
    while at < len(unit):
        stop = max(at + 1, int(np.searchsorted(after, before + BLOCK_TOKENS, side="right")))
        yield unit[at:stop], doc[at:stop]
        at, before = stop, after[stop - 1]


def listed(block: Block, digits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Text of the groups, ``a1,a2|b1;``, as bytes, and the text position after each group."""
    flat, at, length = digits
    a, b, n = block.a, block.b, len(block.cuts)
    n_a, n_b = np.bincount(a.group, minlength=n), np.bincount(b.group, minlength=n)
    total_a, total_b = np.cumsum(n_a), np.cumsum(n_b)
    place_a = np.arange(len(a.ids)) + (total_b - n_b)[a.group]
    place_b = np.arange(len(b.ids)) + total_a[b.group]
    ids = np.empty(len(a.ids) + len(b.ids), np.int64)
    ids[place_a], ids[place_b] = a.ids, b.ids
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[total_a + total_b - n_b - 1] = ord("|")
    mark[total_a + total_b - 1] = ord(";")
    out = gathered(flat, at[ids], length[ids])
    ends = np.cumsum(length[ids])
    out[ends - 1] = mark
    return out, ends[total_a + total_b - 1]


def pair_counts(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents, packed id pairs (``a << 32 | b``) and their links, summed within each part.

    Within a group only distinct ids are paired, with their number of occurrences.
    """

    n = len(block.cuts)
    n_a, n_b = np.bincount(block.a.group, minlength=n), np.bincount(block.b.group, minlength=n)
    doc = np.empty(n, np.int64)
    doc[block.a.group] = block.a.doc
    plain = (n_a == 1) & (n_b == 1)
    own_a, own_b = plain[block.a.group], plain[block.b.group]
    yield summed(doc[plain], block.a.ids[own_a] << 32 | block.b.ids[own_b], np.ones(int(plain.sum()), np.int64))

    def distinct(side, own):
        key, many = np.unique(side.group[~own] << 32 | side.ids[~own], return_counts=True)
        return key >> 32, key & 0xFFFFFFFF, many

    (ga, ia, na), (gb, ib, nb) = distinct(block.a, own_a), distinct(block.b, own_b)
    first = np.searchsorted(gb, ga)
    many = np.searchsorted(gb, ga, side="right") - first
    after = np.cumsum(many)
    at, before = 0, 0
    while at < len(ga):
        stop = max(at + 1, int(np.searchsorted(after, before + BLOCK_PAIRS, side="right")))
        m = many[at:stop]
        each = np.repeat(np.arange(at, stop), m)
        other = np.arange(len(each)) + np.repeat(first[at:stop] - (np.cumsum(m) - m), m)
        yield summed(doc[ga[each]], ia[each] << 32 | ib[other], na[each] * nb[other])
        at, before = stop, after[stop - 1]


def summed(doc: np.ndarray, pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``n`` by document and pair, in that order."""
    # one sort key where it fits: 23 bits for the document and 20 for each id
    packed = doc.max(initial=0) < 1 << 23
    order = np.argsort(doc << 40 | (pair >> 32) << 20 | (pair & 0xFFFFFFFF)) if packed else np.lexsort((pair, doc))
    doc, pair, n = doc[order], pair[order], n[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(first)
    return doc[at], pair[at], np.add.reduceat(n, at) if len(at) else n


def _digits(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decimal ids, each with one byte more for a separator."""
    return _flat([b"%d," % i for i in range(size)])


def _loader(spark: SparkSession, a_path: str, b_path: str):
    """Both vocabulary files as a broadcast, and how a task gets its units."""
    vocabulary = bpe.Vocabulary(a_path)
    ends = vocabulary.token_start + vocabulary.token_len
    raw = vocabulary.token_bytes.tobytes()
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        files = spark.sparkContext.broadcast((a.read(), b.read(), [raw[s:e] for s, e in zip(vocabulary.token_start, ends, strict=True)]))
    return lambda: Units(*files.value)


def _read(units: Units, column: pa.Array) -> list[np.ndarray]:
    """Units of each text; none for texts that are empty or not given back byte by byte."""
    if len(units.index) > CACHE_UNITS or units.size > CACHE_BYTES:
        units.clear()
    texts = []
    for raw in column.cast(pa.binary()).to_pylist():
        text = raw.decode("utf-8", "replace") if raw else ""
        texts.append(text if text.encode() == raw else "")
    return [own if units.good[own].all() else own[:0] for own in units.of(texts)]


def groups(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per group: the key, ``place`` from 0, ``a_ids`` and ``b_ids``, byte ``start`` and ``stop`` in space + text."""
    load = _loader(docs.sparkSession, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]):
        units = load()
        for batch in batches:
            for part in slices(batch, "t", SLICE_BYTES):
                texts = _read(units, part.column(1))
                places, bytes_ = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for unit, doc in blocks(units, texts):
                    block = aligned(units, unit, doc)
                    n = len(block.cuts)
                    own = np.empty(n, np.int64)
                    own[block.a.group] = block.a.doc
                    begin = np.concatenate([[0], block.cuts[:-1]])
                    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    size = np.diff(np.append(first, n))
                    place = np.arange(n) - np.repeat(first, size) + places[own]
                    shift = np.repeat(bytes_[own[first]] - begin[first], size)
                    lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(s.group, np.arange(n + 1)), pa.int32()), pa.array(s.ids, pa.int32())) for s in (block.a, block.b)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array(place), *lists, pa.array(begin + shift), pa.array(block.cuts + shift)], ["k", "place", "a", "b", "start", "stop"])
                    last = own[-1]
                    places[last] = place[-1] + 1
                    bytes_[last] = block.cuts[-1] + shift[-1]

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"k {kind}, place long, a array<int>, b array<int>, start long, stop long").toDF(key, "place", "a_ids", "b_ids", "start", "stop")


def aligned_documents(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` and its id pairs.

    ``pairs`` holds each linked id pair once, packed as ``a << 32 | b``, and ``links`` how many
    token pairs have it. A further column ``row`` is unique.
    """
    load = _loader(docs.sparkSession, a_path, b_path)
    schema = StructType.fromDDL("row long, k int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>")
    schema["k"].dataType = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]):
        units = load()
        digits = _digits(max(len(units.a_len), len(units.b_len)))
        for batch in batches:
            for part in slices(batch, "t", SLICE_BYTES):
                texts = _read(units, part.column(2))
                counts = np.zeros((4, len(texts)), np.int64)
                hashes: list = [None] * len(texts)
                found = []
                for unit, doc in blocks(units, texts):
                    block = aligned(units, unit, doc)
                    n = len(block.cuts)
                    n_a, n_b = np.bincount(block.a.group, minlength=n), np.bincount(block.b.group, minlength=n)
                    own = np.empty(n, np.int64)
                    own[block.a.group] = block.a.doc
                    bounds = np.searchsorted(own, np.arange(len(texts) + 1))
                    for i, each in enumerate((n_a, n_b, np.ones(n, np.int64), n_a * n_b)):
                        counts[i] += row_sums(each, bounds)
                    line, ends = listed(block, digits)
                    ends = np.concatenate([[0], ends])
                    for d in np.unique(own):
                        piece = line[ends[bounds[d]] : ends[bounds[d + 1]] - 1].tobytes()
                        if hashes[d] is None:
                            hashes[d] = hashlib.sha256(piece)
                        else:
                            hashes[d].update(b";" + piece)
                    found.extend(pair_counts(block))
                    if sum(len(f[1]) for f in found) > 4 * BLOCK_PAIRS:
                        found = [summed(*map(np.concatenate, zip(*found, strict=True)))]
                doc, pair, links = summed(*map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 3
                at = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
                digest = pa.array([h.hexdigest() if h else "" for h in hashes], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *map(pa.array, counts), digest, pa.ListArray.from_arrays(at, pa.array(pair)), pa.ListArray.from_arrays(at, pa.array(links))],
                    schema.names,
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def pair_table(documents: DataFrame) -> DataFrame:
    """Every linked id pair: ``pair``, ``a_id``, ``b_id``, ``n_docs``, and whether it is its A id's highest count (``best``)."""
    counts = documents.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    counts = counts.withColumn("a_id", F.shiftright("pair", 32)).withColumn("b_id", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    counts = checkpointed(counts, "pairs")
    highest = counts.groupBy("a_id").agg(F.max("n_docs").alias("top"))
    return counts.join(highest, "a_id").select("pair", "a_id", "b_id", "n_docs", (F.col("n_docs") == F.col("top")).alias("best"))


def report(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the key, its token, group and link numbers, ``n_best``, ``count_sum`` and ``groups_sha256``."""
    documents = checkpointed(aligned_documents(docs, a_path, b_path, key, text), "alignment")
    table = pair_table(documents).select("pair", "n_docs", "best")
    rows = documents.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    held = join_counted(rows, table, "pair", "n_docs", HOT_PAIRS)
    sums = held.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n_docs")).alias("count_sum"))
    told = documents.drop("pairs", "links").join(sums, "row", "left").drop("row")
    return told.select(key, "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
