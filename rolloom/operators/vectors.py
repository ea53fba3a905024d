"""Vector corpus: normalisation, embedding, coarse cells and top-k search.

Scores are inner products in double precision rounded to six places before they are
ranked, so the order does not depend on how a sum was split; ties go to the lowest id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from rolloom.session import checkpointed

# Defaults of index building and serving.
NLIST = 16_384
TRAINING_SAMPLES = 4_000_000
NPROBE_SERVE = 256
NPROBE_CHECK = 32
MIN_SELF_SCORE = 0.99
MIN_RECALL = 0.9
DEFAULT_TOPK = 3
OVERFETCH_FACTOR, OVERFETCH_MIN = 2, 6
E5_PREFIXES = {True: "query: ", False: "passage: "}
BGE_INSTRUCTION = "Represent this sentence for searching relevant passages: "

SCORE_DIGITS, CELL_DIGITS, CENTROID_DIGITS = 6, 12, 9
#: Rows per side of one block, and of one tile of scores inside it.
BLOCK_ROWS = 20_000
TILE_QUERIES, TILE_VECTORS = 1_024, 4_096
#: Queries of a tile whose k-th scores are found at once.
STRIP_QUERIES = 64
#: Bytes of text an encoder is given at once.
ENCODE_BYTES = 4 << 20


def l2_normalize(vec: Column) -> Column:
    """Unit-length vector as doubles; a zero vector stays zero."""
    from rolloom.functions.jsonv import let

    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return let(F.greatest(norm, F.lit(1e-12)), lambda n: F.transform(vec, lambda x: x.cast("double") / n))


def encoder_text(text: Column, model: str, is_query: bool) -> Column:
    """Text as the encoder expects it, by model name."""
    name = model.lower()
    if "e5" in name:
        return F.concat(F.lit(E5_PREFIXES[is_query]), text)
    if "bge" in name and "bge-m3" not in name and is_query:
        return F.concat(F.lit(BGE_INSTRUCTION), text)
    return text


def is_normalized_model(model: str, encoder_class: str = "") -> bool:
    """Whether embeddings of this model are brought to unit length."""
    return "dpr" not in model.lower() and "T5" not in encoder_class


def pool(method: str, tokens: Column, mask: Column, pooled: Column | None = None) -> Column:
    """One vector from token vectors: masked ``mean``, first token (``cls``) or the given ``pooler`` vector."""
    if method == "cls":
        return F.get(tokens, F.lit(0)).cast("array<double>")
    if method == "pooler":
        return pooled.cast("array<double>")
    if method != "mean":
        raise NotImplementedError("Pooling method not implemented!")

    kept = F.aggregate(mask, F.lit(0.0), lambda a, m: a + m.cast("double"))
    zero = F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0))
    weighted = F.zip_with(tokens, mask, lambda t, m: F.transform(t, lambda x: x.cast("double") * m.cast("double")))
    total = F.aggregate(weighted, zero, lambda a, t: F.zip_with(a, t, lambda x, y: x + y))
    return F.transform(total, lambda x: x / kept)


def _slices(part: pa.RecordBatch, text: str, rows: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of at most so many rows and ``ENCODE_BYTES`` of text, or of one longer text."""
    begin = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(part.column(text)), 0).to_pylist()):
        if i > begin and (i - begin >= rows or held + n > ENCODE_BYTES):
            yield part.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < part.num_rows:
        yield part.slice(begin)


def embed(df: DataFrame, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]], text: str, out: str = "embedding", batch: int = 2048) -> DataFrame:
    """Add embeddings from a caller-supplied encoder, created once per task and fed in batches.

    Other columns stay in Arrow; only the texts of one call are Python objects, ``batch`` and ``ENCODE_BYTES`` of them at most.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for whole in batches:
            for part in _slices(whole, text, batch):
                found = np.asarray(encode(part.column(text).to_pylist()), dtype=np.float64)
                ends = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
                vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], [*part.schema.names, out])

    return df.mapInArrow(run, schema)


# --- coarse cells -----------------------------------------------------------


def sample_hash(key: Column, seed: int) -> Column:
    """The seeded order of the training sample."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(seed)))


def training_sample(passages: DataFrame, n: int | None = None, seed: int = 0, key: str = "id", largest_bin: int = 10_000) -> DataFrame:
    """Exactly ``min(n, rows)`` passages, the first in the order of a seeded hash; all of them without ``n``.

    Counts of hash prefixes (65,536 at a time) tell the prefix at which the sample ends; it is
    made longer until the bin it names is small. Tasks then filter by it, and only the bin
    itself is ordered. ``TRAINING_SAMPLES`` is the size that the index builder documents.
    """
    if n is None:
        return passages
    h = sample_hash(F.col(key), seed)
    cut, left = "", n
    while True:
        digits = F.substr(h, F.lit(len(cut) + 1), F.lit(4))
        bins = sorted(passages.where(h.startswith(cut)).groupBy(digits.alias("d")).count().collect())
        if sum(c for _, c in bins) <= left:
            return passages.where((h < cut) | h.startswith(cut))
        for d, c in bins:
            if c > left:
                break
            left -= c
        cut += d
        if c <= largest_bin or len(cut) == 32:
            break
    hashed = passages.withColumn("_h", h)
    border = hashed.where(F.col("_h").startswith(cut)).orderBy("_h", key).limit(left)
    return hashed.where(F.col("_h") < cut).unionByName(border).drop("_h")


def train_cells(sample: DataFrame, nlist: int = NLIST, seed: int = 0, vec: str = "embedding") -> DataFrame:
    """Centroids ``cell, centroid`` by distributed k-means under cosine distance.

    Seeds are drawn at random: the default seeding ends in a step on the driver that takes
    hours for many thousand cells.
    """
    feats = sample.select(array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=nlist, seed=seed, distanceMeasure="cosine", initMode="random").fit(feats)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return sample.sparkSession.createDataFrame(rows, "cell int, centroid array<double>")


def refine_cells(vectors: DataFrame, centroids: DataFrame, steps: int = 1, vec: str = "embedding", key: str = "id") -> DataFrame:
    """Centroids moved to the direction of their vectors' mean, ``steps`` times; a cell without vectors stays.

    Starts from given centroids, so the same input gives the same cells under any partitioning:
    entries are rounded to nine places, far above what the order of a sum can change.
    """
    for _ in range(steps):
        nearest = vectors.join(nearest_cells(vectors, centroids, 1, vec, key), key)
        as_vector = array_to_vector(F.transform(vec, lambda x: x.cast("double")))
        means = nearest.groupBy("cell").agg(Summarizer.mean(as_vector).alias("m"))
        moved = means.select("cell", F.transform(l2_normalize(vector_to_array("m")), lambda x: F.round(x, CENTROID_DIGITS)).alias("moved"))
        centroids = checkpointed(centroids.join(moved, "cell", "left").select("cell", F.coalesce("moved", "centroid").alias("centroid")), "cells")
    return centroids


def ranked_cells(df: DataFrame, centroids: DataFrame, n: int, vec: str = "embedding", key: str = "id") -> DataFrame:
    """``key``, ``cell``, ``score`` and ``place``: the ``n`` best cells of each row; ties go to the lowest cell.

    Cells are searched like passages, block by block, so neither side must fit anywhere;
    vectors are not repeated per cell.
    """
    asked = df.select(F.col(key).alias("qid"), F.col(vec).alias("qvec"))
    cells = centroids.select(F.col("cell").cast("bigint").alias("id"), F.col("centroid").alias("vec"))
    found = topk_exact(asked, cells, n, digits=CELL_DIGITS)
    return found.select(F.col("qid").alias(key), F.col("id").cast("int").alias("cell"), "score", F.col("rank").alias("place"))


def nearest_cells(df: DataFrame, centroids: DataFrame, n: int, vec: str = "embedding", key: str = "id") -> DataFrame:
    """``key`` and ``cell`` of the ``n`` best cells of each row."""
    return ranked_cells(df, centroids, n, vec, key).select(key, "cell")


def assign_cells(passages: DataFrame, centroids: DataFrame, vec: str = "embedding", key: str = "id", copies: int = 1, factor: float = 1.0) -> DataFrame:
    """Passages with their best cell, and copies in other cells that are almost as near; ``key`` is unique.

    A copy goes to each of the ``copies`` best cells whose distance (1 - score, for unit
    vectors) is at most ``factor`` times the best cell's: passages at a border are found from
    either side. There are at most ``copies`` rows of a passage.
    """
    ranked = ranked_cells(passages, centroids, copies, vec, key)
    best = F.max("score").over(W.partitionBy(key))
    near = (1 - F.col("score")) <= factor * F.greatest(1 - F.col("best"), F.lit(0.0))
    held = ranked.withColumn("best", best).where((F.col("place") == 1) | near).select(key, "cell")
    # keys and cells only: the search for cells runs once, however often the result is read
    return passages.join(checkpointed(held, "assignment"), key)


def cell_costs(vectors: DataFrame, centroids: DataFrame, vec: str = "embedding", key: str = "id") -> DataFrame:
    """``cell``, ``n`` and ``cost``: vectors per cell and the sum of their distances (1 - score); empty cells have none."""
    near = ranked_cells(vectors, centroids, 1, vec, key)
    costs = near.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.round(1 - F.col("score"), 9).cast("decimal(20,9)")).cast("double").alias("cost"))
    return centroids.select("cell").join(costs, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cost", F.lit(0.0)).alias("cost"))


# --- top-k ------------------------------------------------------------------


def _best(rows, scores, ids, k):
    """Keep the ``k`` best (score, id) per query row of a flat candidate list."""
    order = np.lexsort((ids, -scores, rows))
    rows, scores, ids = rows[order], scores[order], ids[order]
    starts = np.r_[0, np.flatnonzero(np.diff(rows)) + 1] if len(rows) else np.array([], dtype=int)
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    keep = rank < k
    return rows[keep], scores[keep], ids[keep]


def _candidates(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, digits: int):
    """Rows, scores and ids of each query's ``k`` best vectors, tile by tile.

    One tile of scores is all that is ever held, in memory taken once; the k-th scores are found
    in strips of it, as that takes a copy. After each tile a query keeps its k best.
    """
    found, tile = [], np.empty(min(TILE_QUERIES, len(q)) * min(TILE_VECTORS, len(v)))
    for i in range(0, len(q), TILE_QUERIES):
        rows, scores, best = np.zeros(0, np.int64), np.zeros(0), ids[:0]
        for j in range(0, len(v), TILE_VECTORS):
            left, right = q[i : i + TILE_QUERIES], v[j : j + TILE_VECTORS]
            s = np.matmul(left, right.T, out=tile[: len(left) * len(right)].reshape(len(left), len(right)))
            np.round(s, digits, out=s)
            if s.shape[1] > k:
                at = s.shape[1] - k
                kth = np.concatenate([np.partition(s[x : x + STRIP_QUERIES], at, axis=1)[:, at] for x in range(0, len(s), STRIP_QUERIES)])
                r, c = np.nonzero(s >= kth[:, None])
            else:
                r, c = np.nonzero(np.ones_like(s, dtype=bool))
            rows, scores, best = _best(np.concatenate([rows, r]), np.concatenate([scores, s[r, c]]), np.concatenate([best, ids[j + c]]), k)
        found.append((rows + i, scores, best))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _blocks(n: str) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.col(n).cast("bigint") - 1)


def topk_in_cells(queries: DataFrame, passages: DataFrame, k: int, block_rows: int = BLOCK_ROWS, digits: int = SCORE_DIGITS, copies: bool = False) -> DataFrame:
    """Best ``k`` passages per query among shared cells: ``qid, id, score, rank``.

    With ``copies`` a passage may be in several cells; it counts once.

    ``queries(qid, qvec, cell)``, ``passages(id, vec, cell)``. Both sides of each cell are
    split into blocks of bounded size, at every size of the input: a cell with a third of
    all passages becomes many blocks, each pair of blocks is one group, and it returns at
    most k rows per query.
    """
    queries, passages = queries.select("qid", "qvec", "cell"), passages.select("id", "vec", "cell")
    n_q = queries.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n_qb"))
    n_p = passages.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n_pb"))
    # one row per cell
    grid = checkpointed(n_q.join(n_p, "cell"), "grid")
    q = queries.join(grid, "cell").withColumn("_qb", F.pmod(F.xxhash64("qid"), F.col("n_qb")))
    q = q.select("qid", "qvec", "cell", "_qb", F.explode(_blocks("n_pb")).alias("_pb"))
    p = passages.join(grid, "cell").withColumn("_pb", F.pmod(F.xxhash64("id"), F.col("n_pb")))
    p = p.select("id", "vec", "cell", "_pb", F.explode(_blocks("n_qb")).alias("_qb"))
    schema = T.StructType(
        [T.StructField("qid", queries.schema["qid"].dataType), T.StructField("id", passages.schema["id"].dataType), T.StructField("score", T.DoubleType())]
    )

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"qid": [], "id": [], "score": []})
        ids = right["id"].to_numpy()
        ids = ids.astype(str) if ids.dtype == object else ids
        rows, s, i = _candidates(np.stack(left["qvec"]).astype(np.float64), np.stack(right["vec"]).astype(np.float64), ids, k, digits)
        return pd.DataFrame({"qid": left["qid"].to_numpy()[rows], "id": i, "score": s})

    keys = ["cell", "_qb", "_pb"]
    hits = q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(pair, schema)
    w = W.partitionBy("qid").orderBy(F.desc("score"), "id")
    if copies:
        # copies have equal scores and stand next to each other
        fresh = F.coalesce(F.lag("id").over(w) != F.col("id"), F.lit(True))
        hits = hits.withColumn("_fresh", fresh).where("_fresh").drop("_fresh")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk_exact(queries: DataFrame, passages: DataFrame, k: int, **bounds) -> DataFrame:
    """Exact top-k by inner product: ``queries(qid, qvec)``, ``passages(id, vec)``."""
    # one cell for all, as a value the optimizer does not see through: the joins stay equi-joins
    one = lambda c: F.pmod(F.xxhash64(c), F.lit(1)).cast("int")
    return topk_in_cells(queries.withColumn("cell", one("qid")), passages.withColumn("cell", one("id")), k, **bounds)


def topk_ivf(queries: DataFrame, assigned: DataFrame, centroids: DataFrame, k: int, nprobe: int = NPROBE_SERVE, **bounds) -> DataFrame:
    """Top-k over the ``nprobe`` best cells of each query.

    ``assigned`` is usually read from a table partitioned by cell: the probed cells,
    at most ``nlist`` of them, become a filter that prunes its folders.
    """
    probes = checkpointed(nearest_cells(queries, centroids, nprobe, "qvec", "qid"), "probes")
    probed = [r[0] for r in probes.select("cell").distinct().collect()]  # at most nlist values
    return topk_in_cells(probes.join(queries, "qid"), assigned.where(F.col("cell").isin(probed)), k, copies=True, **bounds)


def cells_read(queries: DataFrame, assigned: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """``qid`` and ``n_read``: stored rows, copies included, of the cells a query probes."""
    sizes = assigned.groupBy("cell").agg(F.count("*").alias("n"))
    return nearest_cells(queries, centroids, nprobe, "qvec", "qid").join(sizes, "cell").groupBy("qid").agg(F.sum("n").alias("n_read"))


def check_index(
    sample: DataFrame, passages: DataFrame, assigned: DataFrame, centroids: DataFrame, nprobe: int = NPROBE_CHECK, k: int = 5, min_recall: float = MIN_RECALL
) -> DataFrame:
    """Report on an index: what share of the exact ``k`` best it finds, and whether vectors find themselves.

    ``sample(id, vec)`` are the queries, ``passages(id, vec)`` all vectors. ``good`` is false
    when the index loses more than its share, though every vector may still find itself.
    """
    asked = sample.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    near = checkpointed(topk_ivf(asked, assigned, centroids, k, nprobe), "near")
    exact = topk_exact(asked, passages, k).select("qid", "id")
    found = exact.join(near.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left").agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found")).first()
    first = near.where("rank = 1").agg(F.count("*").alias("n_checked"), F.count_if(F.col("qid") == F.col("id")).alias("self_hits"), F.min("score").alias("min_top1"))
    recall = F.lit(found["n_found"] / found["n_exact"] if found["n_exact"] else None).cast("double")
    return first.select(
        "n_checked", "self_hits", "min_top1", (F.col("min_top1") >= MIN_SELF_SCORE).alias("normalized"),
        F.round(recall, 4).alias("recall"), (recall >= min_recall).alias("good"),
    )
