"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A text is its lower-cased words; five consecutive words are a shingle (a text with fewer
words is one shingle). Every different shingle's exponential arrivals, with its weight as
rate, fall on random registers; a register keeps the shingle that arrives first, and a
shingle stops when its next arrival is later than every register (early termination).
Equal registers estimate the probability Jaccard similarity of the weights. A shingle's weight
grows with the logarithm of its count from 1 to ``HEAVIEST``. Links are defined by the plain
Jaccard similarity of the sets; with weights in that range a pair at ``s`` has a probability
Jaccard similarity of at least ``s / (s + (1 - s) * HEAVIEST)``, 0.762 for 0.8, however often
lines are repeated, and bands and bits are set for that.

Texts with the same words are one node. Nodes that agree in all registers of a band share
a bucket; they are the candidates. Links are found without writing all pairs of a bucket:

1. shingles that only one candidate has bound how similar it can be to any other; nodes
   that cannot reach the threshold leave;
2. every node is compared with the hub of each of its buckets, the node with the smallest
   share of such shingles;
3. inside buckets that still span several components, nodes outside the hub's component
   are compared with the nodes of other components.

A pair not compared is in one component already, or below the threshold: the bound of (1)
is applied to each pair, as is a bit per register (a pair at 0.8 fails that one with a
chance below 10^-6, below 3x10^-5 with the least favourable weights). The rest are verified:
a link needs a Jaccard similarity of the exact shingle sets of at least ``threshold``. With 25
bands of 5 rows a pair at 0.8 is missed with a chance of 5e-5 (6e-4 with the least favourable
weights). Buckets with very many nodes meet their hub by a broadcast of bounded size. Classes are the connected components of the links. Nodes are 64-bit
hashes of word sequences: among 10^9 different texts one wrong meeting has a chance of 3
in 100.

Null and empty texts are one node without words; they form a class of their own. Repeated
rows and equal texts share a class. A null ``doc_id`` takes part like any other and comes
last when the document that stands for a class is chosen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.llm.arrow_text import Words, map_text, mix, words
from rolloom.llm.components import components
from rolloom.llm.skew import join_counted
from rolloom.session import checkpointed

SHINGLE, BANDS, ROWS, THRESHOLD = 5, 25, 5, 0.8
REGISTERS = BANDS * ROWS
#: Largest weight of a shingle, and by how much a count e times as large raises it.
HEAVIEST, GROWTH = 1.25, 0.1
#: Registers whose bits must agree; a pair at similarity 0.8 agrees in 112.5 on average, with a deviation of 3.4.
LEAST_BITS = 95
_P = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle of the texts, repeated ones included."""
    bounds, row = w.bounds, w.row
    counts = np.diff(bounds)
    n = len(w.hash)
    if n >= SHINGLE:
        h = w.hash[: n - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            h = h * _P + w.hash[k : n - SHINGLE + 1 + k]
        inside = row[: len(h)] == row[SHINGLE - 1 :]
        rows, hashes = row[: len(h)][inside], mix(h[inside])
    else:
        rows, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(few):
        own = np.empty(len(few), np.uint64)
        for i, r in enumerate(few):
            h = int(counts[r])
            for x in w.hash[bounds[r] : bounds[r + 1]]:
                h = (h * int(_P) + int(x)) & 0xFFFFFFFFFFFFFFFF
            own[i] = h
        rows, hashes = np.concatenate([rows, few]), np.concatenate([hashes, mix(own)])
    return rows, hashes


def weighted(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles per row, ordered by row and hash, with their weights."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    if not len(rows):
        return rows, hashes, np.zeros(0)
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])]))
    counts = np.diff(np.append(first, len(rows)))
    return rows[first], hashes[first], np.minimum(1.0 + GROWTH * np.log(counts), HEAVIEST)


def registers(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_rows: int) -> np.ndarray:
    """The shingle in each register of each row; rows without shingles have zeros."""
    earliest = np.full(n_rows * REGISTERS, np.inf)
    kept = np.zeros(n_rows * REGISTERS, np.uint64)
    time, seed = np.zeros(len(rows)), hashes
    while len(rows):
        seed = mix(seed + _STEP)
        time = time - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weights
        at = rows * REGISTERS + (mix(seed ^ _P) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(earliest, at, time)
        won = earliest[at] == time
        kept[at[won]] = hashes[won]
        alive = time < earliest.reshape(n_rows, REGISTERS).max(1)[rows]
        rows, hashes, weights, time, seed = rows[alive], hashes[alive], weights[alive], time[alive], seed[alive]
    return kept.reshape(n_rows, REGISTERS)


def _sketcher():
    def each(column: pa.Array):
        w = words(pc.utf8_lower(column))
        bounds = w.bounds
        n = len(bounds) - 1
        kept = registers(*weighted(*shingles(w)), n)
        # the word sequence: a polynomial in the word hashes, by row
        position = np.arange(len(w.hash)) - np.repeat(bounds[:-1], np.diff(bounds))
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(position.max(initial=0)) + 1, _STEP, np.uint64)]))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * powers[position])])
        node = mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64))
        band = kept.reshape(n, BANDS, ROWS)
        h = np.zeros((n, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(ROWS):
            h = mix(h * _P + band[:, :, k])
        bits = np.packbits(np.pad((mix(kept) & np.uint64(1)).astype(np.uint8), ((0, 0), (0, 128 - REGISTERS))), axis=1).view(np.int64)
        lists = pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), pa.array(h.view(np.int64).ravel()))
        return [node.view(np.int64), np.diff(bounds), lists, bits[:, 0].copy(), bits[:, 1].copy()]

    return each


def sketch(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, a hash of the text, ``node``, ``n_words``, ``bands`` and the registers' bits."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.col(text).alias("t"))
    added = {"node": "bigint", "n_words": "bigint", "bands": "array<bigint>", "bits0": "bigint", "bits1": "bigint"}
    return map_text(rows, "t", ["id", "h"], added, _sketcher)


def _shingle_sets():
    def each(column: pa.Array):
        w = words(pc.utf8_lower(column))
        rows, hashes, _ = weighted(*shingles(w))
        cuts = np.searchsorted(rows, np.arange(len(w.offsets))).astype(np.int32)
        return [pa.ListArray.from_arrays(cuts, pa.array(hashes.view(np.int64)))]

    return each


def _may_link(threshold: float) -> Column:
    """Whether nodes ``a`` and ``b`` can be near: by their registers' bits, and by the shingles that no other candidate has.

    Of ``n`` shingles, the ``u`` that no other candidate has are outside the other text.
    """
    differ = F.bit_count(F.col("a.bits0").bitwiseXOR(F.col("b.bits0"))) + F.bit_count(F.col("a.bits1").bitwiseXOR(F.col("b.bits1")))
    shared = F.least(F.col("a.n") - F.col("a.u"), F.col("b.n") - F.col("b.u"))
    union = F.greatest(F.col("a.n") + F.col("b.u"), F.col("b.n") + F.col("a.u"))
    return (differ <= REGISTERS - LEAST_BITS) & (shared >= threshold * union)


def _near(a: str, b: str, threshold: float) -> Column:
    """Whether two shingle sets have a Jaccard similarity of at least the threshold."""
    both = F.size(F.array_intersect(a, b))
    return both >= threshold * (F.size(a) + F.size(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a``, ``b`` whose shingle sets have a Jaccard similarity of at least the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    return pairs.join(left, "a").join(right, "b").where(_near("sa", "sb", threshold)).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: the key, ``h``, ``node``, ``class_id`` (the class's least key), ``class_rows``, ``n_keep``, ``keep_node``.

    ``h`` is a hash of the text; ``n_keep`` rows of the input have the class's least key and the node ``keep_node``.
    """
    rows = checkpointed(sketch(docs, key, text), "sketch")
    per_key = rows.groupBy("node", "id").agg(F.count("*").alias("n"), F.first("h").alias("h"), F.first("bits0").alias("bits0"), F.first("bits1").alias("bits1"))
    lead = F.struct(F.col("id").isNull().alias("missing"), "id", "n", "h", "bits0", "bits1")
    nodes = checkpointed(per_key.groupBy("node").agg(F.min(lead).alias("lead"), F.sum("n").alias("rows")).select("node", "lead.*", "rows"), "nodes")

    members = rows.where("n_words > 0").select("node", F.explode("bands").alias("band")).distinct()
    shared = members.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band")
    crowded = checkpointed(members.join(shared, "band"), "buckets")
    sets = _sets(docs, key, text, crowded, nodes)
    own = sets.select("node", F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("u"))
    facts = sets.select("node", F.size("s").cast("bigint").alias("n")).join(own, "node", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    facts = facts.where(F.col("n") - F.col("u") >= threshold * F.col("n")).join(nodes.select("node", "bits0", "bits1"), "node")
    crowd = checkpointed(crowded.join(facts, "node").select("band", F.struct((F.col("u") / F.col("n")).alias("alone"), "node", "n", "u", "bits0", "bits1").alias("a")), "crowd")

    hubs = checkpointed(crowd.groupBy("band").agg(F.min("a").alias("b"), F.count("*").alias("size")).where("size > 1").select("band", "b", "size"), "hubs")
    star = join_counted(crowd, hubs, "band", "size").where((F.col("a.node") != F.col("b.node")) & _may_link(threshold)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    links = checkpointed(_verified(star, sets, threshold), "links")
    roots = components(links)

    placed = crowd.join(roots.select(F.col("node").alias("_n"), "root"), F.col("a.node") == F.col("_n"), "left").select("band", "a", F.coalesce("root", "a.node").alias("root"))
    of_hub = hubs.join(roots.select(F.col("node").alias("_n"), "root"), F.col("b.node") == F.col("_n"), "left").select("band", "size", F.col("b.node").alias("hub"), F.coalesce("root", "b.node").alias("hub_root"))
    placed = checkpointed(join_counted(placed, of_hub, "band", "size").drop("size"), "placed")
    odd = placed.where("root <> hub_root").select("band", "a", F.col("root").alias("ra"))
    other = placed.where(F.col("a.node") != F.col("hub")).join(odd.select("band").distinct(), "band", "left_semi").select(F.col("band").alias("_band"), F.col("a").alias("b"), F.col("root").alias("rb"))
    odd = odd.join(sets.select(F.col("node").alias("_na"), F.col("s").alias("sa")), F.col("a.node") == F.col("_na"))
    other = other.join(sets.select(F.col("node").alias("_nb"), F.col("s").alias("sb")), F.col("b.node") == F.col("_nb"))
    # the exact test is part of the join, so that only links leave it
    cross = (F.col("band") == F.col("_band")) & (F.col("ra") != F.col("rb")) & _may_link(threshold) & _near("sa", "sb", threshold)
    more = odd.join(other, cross).select(F.greatest("a.node", "b.node").alias("a"), F.least("a.node", "b.node").alias("b")).distinct()
    roots = components(links.union(checkpointed(more, "more")))

    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = placed.groupBy("root").agg(F.min(F.struct("missing", "id", "n", "node")).alias("least"), F.sum("rows").alias("class_rows"))
    by_node = placed.select("node", "root").join(classes, "root").select("node", F.col("least.id").alias("class_id"), "class_rows", F.col("least.n").alias("n_keep"), F.col("least.node").alias("keep_node"))
    out = rows.select("id", "h", "node").join(by_node, "node")
    return out.select(F.col("id").alias(key), "h", "node", "class_id", "class_rows", "n_keep", "keep_node")


def _sets(docs: DataFrame, key: str, text: str, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` and its shingles ``s``, read from the row that stands for each node."""
    wanted = members.select("node").distinct().join(nodes.select("node", "id", "h"), "node")
    texts = docs.select(F.col(key).alias("doc"), F.col(text).alias("t")).withColumn("th", F.xxhash64(F.coalesce("t", F.lit(""))))
    found = texts.join(wanted, texts["doc"].eqNullSafe(wanted["id"]) & (texts["th"] == wanted["h"])).select("node", "t")
    return checkpointed(map_text(found, "t", ["node"], {"s": "array<bigint>"}, _shingle_sets).dropDuplicates(["node"]), "sets")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each class, all columns as they are.

    The row with the least key stays; of repeated rows with that key one stays. Texts
    without words are equal to each other only.
    """
    found = near_duplicates(docs, key, text, threshold)
    same = F.col(key).eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("keep_node"))
    kept = checkpointed(found.where(same).select(F.col(key).alias("_id"), F.col("h").alias("_h"), "node", "n_keep").distinct(), "kept")
    # whole rows travel in one column, so that no column of theirs can clash
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(key).alias("id"), hashed.alias("h"))

    def rows(which: DataFrame) -> DataFrame:
        return packed.join(which, packed["id"].eqNullSafe(which["_id"]) & (packed["h"] == which["_h"]))

    single = rows(kept.where("n_keep = 1")).select("row.*")
    repeated = rows(kept.where("n_keep > 1")).dropDuplicates(["node"]).select("row.*")
    return single.union(repeated)
