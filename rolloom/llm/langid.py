"""Language identification by a string kernel with Nyström landmarks and ridge regression.

The kernel of two texts is the number of different 1- to 3-grams both contain, divided by
the geometric mean of their numbers (blended spectrum, presence). Letters are folded to
lower case and to 127 symbols; everything else separates words. Landmark texts span a
subspace of the kernel's feature space; one-versus-rest ridge regression on the kernel
values to the landmarks gives a score per language. As that score is linear in the
presence vector, a batch of texts is scored by one matrix product.

Every language that a labelled row names is learned. Training reads bounded samples of the
labelled rows of each (parameters below), drawn by a hash of the text, so that repeated
rows count once. Whole texts are read.
Texts that are null or have no letter get ``und`` and score 0. With no labelled row at all
every text gets ``und``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rolloom.llm.arrow_text import code_points, letter_classes, map_text, slices, utf8
from rolloom.session import checkpointed

#: Texts per language that the regression is fitted on, and landmarks over all languages (with many languages four each).
TRAIN_ROWS, LANDMARKS = 900, 192
RIDGE = 1e-3
_SYMBOLS = 128
#: Where the codes of 1-, 2- and 3-grams begin.
_BEGIN = (0, _SYMBOLS, _SYMBOLS + _SYMBOLS**2)
_CODES = _SYMBOLS + _SYMBOLS**2 + _SYMBOLS**3
_ROWS = 256
#: Bytes of text handled at once: n-gram arrays take about a hundred times as much.
_SLICE = 1 << 20
UNKNOWN = "und"


def symbols() -> np.ndarray:
    """Symbol of every lower-case code point: 1-26 for a-z, up to 127 for other letters, 0 for the rest."""
    letters = np.flatnonzero(letter_classes() == 1)
    table = np.zeros(0x110000, np.uint8)
    table[letters] = 27 + (letters.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(_SYMBOLS - 27)
    table[97:123] = np.arange(1, 27)
    return table


def grams(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and codes of the n-grams of a text column, and which rows have a letter."""
    data, at = utf8(pc.utf8_lower(column))
    n_rows = len(at) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n_rows, bool)
    symbol = table[code_points(data)].astype(np.int64)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
    row = np.repeat(np.arange(n_rows), np.diff(first))
    has_letter = np.bincount(row, symbol > 0, n_rows) > 0
    rows, codes = [], []
    code = symbol
    for n in (1, 2, 3):
        if n > 1:
            code = code[:-1] * _SYMBOLS + symbol[n - 1 :]
        whole = (row[: len(code)] == row[n - 1 :]) & (code > 0)
        rows.append(row[: len(code)][whole])
        codes.append(code[whole] + _BEGIN[n - 1])
    return np.concatenate(rows), np.concatenate(codes), has_letter


#: Languages whose sizes are broadcast; those of more are joined by a shuffle.
MOST_BROADCAST = 100_000


@dataclass
class Model:
    """Languages, the position of each n-gram code among the landmarks' n-grams, and weights by position and language."""

    languages: list[str]
    position: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    heat: float


def _presence(column: pa.Array, table: np.ndarray, position: np.ndarray, width: int):
    """Presence matrices of blocks of rows over the landmarks' n-grams, and the rows with letters."""
    row, code, has_letter = grams(column, table)
    at = position[code]
    row, at = row[at >= 0], at[at >= 0]
    for begin in range(0, len(has_letter), _ROWS):
        rows = min(_ROWS, len(has_letter) - begin)
        own = (row >= begin) & (row < begin + rows)
        x = np.zeros((rows, width), np.float32)
        x[row[own] - begin, at[own]] = 1
        yield x, has_letter[begin : begin + rows]


def sample(labelled: DataFrame, per_language: int, text: str = "text", label: str = "lang") -> DataFrame:
    """About ``per_language`` different texts of each language: ``label``, ``text``, ``h``.

    A hash threshold per language thins the rows before anything is shuffled; the exact
    limit then holds by rank.
    """
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    # one row per language
    sizes = rows.groupBy("label").agg((F.least(F.lit(1.0), F.lit(1.5 * per_language) / F.count("*")) * (1 << 30)).alias("below"))
    h = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30))
    sizes = checkpointed(sizes, "languages")
    side = F.broadcast(sizes) if sizes.count() <= MOST_BROADCAST else sizes
    thin = rows.withColumn("h", h).join(side, "label").where(F.col("h") < F.col("below")).select("label", "text", "h").dropDuplicates(["label", "text"])
    ranked = thin.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy("h", "text")))
    return ranked.where(F.col("rank") <= per_language).select("label", "text", "h")


def _summed(drawn: DataFrame, number: dict[str, int], start: Callable[[], Callable[[pa.Array, np.ndarray], np.ndarray]], size: int) -> np.ndarray:
    """Sum over the sample of arrays of ``size`` numbers that ``start``'s function makes of texts and their language numbers.

    Tasks add up their own rows; the driver holds one task's sum at a time.
    """
    shared = drawn.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]):
        each, total = start(), np.zeros(size)
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                total += each(part.column("text"), np.array([shared.value[x] for x in part.column("label").to_pylist()], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    parts = checkpointed(drawn.select("label", "text").mapInArrow(run, "sum binary"), "sums")
    total = np.zeros(size)
    for r in parts.toLocalIterator():
        total += np.frombuffer(r[0])
    return total


def train(labelled: DataFrame, text: str = "text", label: str = "lang", rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit the model on at most ``rows`` texts of each language.

    The landmarks' n-gram codes (bounded by the number of codes) come to the driver. The
    kernel values of the sample stay in the tasks, which sum their products: the driver's
    share grows with the square of the landmarks, not with the texts.
    """
    table = symbols()
    spark = labelled.sparkSession
    drawn = checkpointed(sample(labelled, rows, text, label), "sample")

    def codes_of():
        def each(column):
            row, code, has = grams(column, table)
            pairs = np.unique(row * _CODES + code)
            lists = np.split((pairs % _CODES).astype(np.int32), np.searchsorted(pairs // _CODES, np.arange(1, len(has))))
            return [pa.array([p.tolist() for p in lists], pa.list_(pa.int32()))]

        return each

    sizes = {r[0]: r[1] for r in drawn.groupBy("label").agg(F.count("*").alias("n")).collect()}
    found = sorted(sizes)
    if not found:
        return Model([], np.full(_CODES, -1, np.int32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32), 1.0)
    # as many landmarks for any number of languages; with more languages than landmarks some have none of their own
    each_n = max(1, landmarks // len(found))
    first = drawn.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy("h", "text"))).where(F.col("rank") <= each_n)
    first = first.orderBy("rank", F.xxhash64("label", F.lit("landmarks")), "label").limit(landmarks)
    marks = [np.array(r[1], np.int64) for r in map_text(first, "text", ["label", "h"], {"codes": "array<int>"}, codes_of, _SLICE).select("label", "codes", "h").orderBy("label", "h").collect() if r[1]]
    used = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.int64)
    position = np.full(_CODES, -1, np.int32)
    position[used] = np.arange(len(used))
    basis = np.zeros((len(marks), len(used)), np.float32)
    for i, m in enumerate(marks):
        basis[i, position[m]] = 1
    basis /= np.sqrt(np.maximum(basis.sum(1, keepdims=True), 1))
    shared = spark.sparkContext.broadcast((position, basis))
    number = {x: i for i, x in enumerate(found)}
    weight = 1.0 / np.array([sizes[x] for x in found])
    n, k = len(found), len(marks)

    def products():
        where, marks_ = shared.value

        def each(column, y):
            sums, gram, at = np.zeros((n, k)), np.zeros((k, k)), 0
            for x, _ in _presence(column, table, where, marks_.shape[1]):
                values = ((x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))) @ marks_.T).astype(np.float64)
                own = y[at : at + len(x)]
                np.add.at(sums, own, values)
                gram += values.T @ (values * weight[own][:, None])
                at += len(x)
            return np.concatenate([sums.ravel(), gram.ravel()])

        return each

    total = _summed(drawn, number, products, n * k + k * k)
    # Nyström features: kernel values times the inverse root of the landmarks' own kernel
    values, vectors = np.linalg.eigh((basis @ basis.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    # every language weighs 1 in all: the means of the languages, and the products about the mean
    centres = (total[: n * k].reshape(n, k) * weight[:, None]) @ root
    mean, target_mean = centres.mean(0), np.full(n, 2.0 / n - 1.0)
    gram = root.T @ total[n * k :].reshape(k, k) @ root - n * np.outer(mean, mean) + ridge * n * np.eye(root.shape[1])
    coef = np.linalg.solve(gram, (centres - mean).T @ (np.where(np.eye(n) > 0, 1.0, -1.0) - target_mean))
    bias = target_mean - mean @ coef
    heats = (1.0, 2.0, 4.0, 8.0, 16.0)
    model = Model(found, position, (basis.T.astype(np.float64) @ (root @ coef)).astype(np.float32), bias.astype(np.float32), 1.0)
    fitted = spark.sparkContext.broadcast((model.position, model.weights, model.bias))

    def likelihoods():
        where, weights_, bias_ = fitted.value

        def each(column, y):
            out, at = np.zeros(len(heats)), 0
            for x, _ in _presence(column, table, where, len(weights_)):
                own = y[at : at + len(x)]
                z = ((x @ weights_) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) + bias_).astype(np.float64)
                for i, t in enumerate(heats):
                    out[i] += (weight[own] * np.log(np.maximum(_softmax(z * t)[np.arange(len(own)), own], 1e-12))).sum()
                at += len(x)
            return out

        return each

    model.heat = heats[int(_summed(drawn, number, likelihoods, len(heats)).argmax())]
    return model


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Columns ``keep`` of every row with its predicted language and the probability given to it."""
    table = symbols()
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.position, model.weights, model.bias, model.heat))

    def start():
        languages, position, weights, bias, heat = shared.value

        def each(column):
            if not languages:
                return [[UNKNOWN] * len(column), np.zeros(len(column))]
            names, scores = [], []
            for x, has in _presence(column, table, position, len(weights)):
                z = (x @ weights) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) + bias
                p = _softmax(z.astype(np.float64) * heat)
                best = p.argmax(1)
                names += [languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
                # matrix products round by their position in a batch; equal texts get equal scores
                scores.append(np.where(has, np.round(p[np.arange(len(p)), best], 9), 0.0))
            return [names, np.concatenate(scores)]

        return each

    return map_text(docs, text, keep, {lang_pred: "string", score: "double"}, start, _SLICE)


def remainder(key: str, n: int) -> Column:
    """crc32 of a key's text, modulo ``n``; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))
