"""Toxicity scores by a counterfactually regularised logistic regression.

Features are the words of a text, in lower case and without outer punctuation, and their
first 4, 5 and 6 letters (invented or inflected insults share stems); a text has a feature
or has it not. The most telling ones are chosen by their label counts. Fitting minimises
log loss, a ridge term, and the squared change of a text's logit when its identity terms
are swapped for other groups' terms or for a neutral word, so that naming a group does not
raise a score.

Fitting reads a bounded sample of labelled rows, ``POSITIVES`` and ``NEGATIVES`` at most,
thinned by a hash of the key; it is broadcast to find its texts, whose whole length is
used. Null and empty texts have no features and get the base score. Repeated rows get equal
scores; a null key or label is never learned from. Without labels of both kinds every
score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.llm.arrow_text import lookup, map_text, mix, row_sums, span_hashes, words
from rolloom.session import checkpointed

POSITIVES, NEGATIVES, FEATURES, LEAST_TEXTS = 6_000, 9_000, 4_000, 3
RIDGE, SWAP_WEIGHT, STEPS, PRIOR = 1e-4, 1.0, 400, 0.25
PREFIXES = (4, 5, 6)
#: Terms for groups of people; terms of one line stand for each other.
IDENTITY = (
    "women men woman man girls boys girl boy female male",
    "muslim christian jewish hindu buddhist atheist catholic protestant sikh",
    "muslims christians jews hindus buddhists atheists catholics protestants sikhs",
    "black white asian latino hispanic african arab native",
    "gay straight lesbian bisexual transgender queer heterosexual homosexual",
    "american mexican chinese indian russian german french british polish turkish",
    "immigrants refugees foreigners citizens migrants natives",
    "disabled blind deaf autistic elderly young old",
)
_SALT = np.array([0x452821E638D01377, 0xBE5466CF34E90C6C, 0xC0AC29B7C97C50DD, 0x3F84D5B5B5470917], np.uint64)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and hash of every feature of the texts, repeated ones included; and the number of rows."""
    w = words(pc.utf8_lower(column))
    n = len(w.offsets) - 1
    start, end, row = w.start.copy(), w.end.copy(), w.row
    for ends in (False, True):
        going = np.arange(len(start))
        while len(going):
            going = going[(start[going] < end[going]) & _PUNCTUATION[w.data[end[going] - 1 if ends else np.minimum(start[going], len(w.data) - 1)]]]
            if ends:
                end[going] -= 1
            else:
                start[going] += 1
    kept = start < end
    start, end, row = start[kept], end[kept], row[kept]
    if not len(start):
        return row, np.zeros(0, np.uint64), n
    rows, hashes = [row], [span_hashes(w.data, start, end - start) ^ _SALT[0]]
    # prefixes are cut at characters: a cut inside one takes the whole of it
    lead = np.append((w.data & 0xC0) != 0x80, True)
    for k, salt in zip(PREFIXES, _SALT[1:], strict=True):
        cut = start + k
        long_ = cut < end
        s, c, e = start[long_], cut[long_], end[long_]
        for _ in range(3):
            c = np.where((c < e) & ~lead[c], c + 1, c)
        if len(s):
            rows.append(row[long_])
            hashes.append(span_hashes(w.data, s, c - s) ^ salt)
    return np.concatenate(rows), np.concatenate(hashes), n


def _of_term(term: str) -> set[int]:
    return set(features(pa.array([term]))[1].tolist())


@dataclass
class Model:
    """Sorted feature hashes with their weights, and the bias; no features and no bias for score 0."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float | None


def _sampled(labels: DataFrame, key: str, label: str, positives: int, negatives: int) -> DataFrame:
    """At most about as many labelled keys of each kind: ``_key``, ``y``."""
    given = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("_key"), (F.col(label) > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in given.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, min(1.0, positives / max(sizes.get(1, 0), 1))).otherwise(min(1.0, negatives / max(sizes.get(0, 0), 1)))
    h = F.pmod(F.xxhash64("_key", F.lit("toxic")), F.lit(1 << 30))
    return given.where(h < share * (1 << 30)).dropDuplicates(["_key", "y"])


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, positives: int, negatives: int) -> DataFrame:
    """``id, y, t``: at most ``positives`` and ``negatives`` labelled texts, whatever the keys hold.

    Equal texts of a key count once, and of the texts that drawn keys have, those first in the
    order of a hash are taken: a key that repeats a million times adds no more than the bound.
    """
    drawn = F.broadcast(checkpointed(_sampled(labels, key, label, positives, negatives), "labels"))
    whole = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    held = checkpointed(whole.select("id", "h").join(drawn, F.col("id") == F.col("_key")).select("id", "y", "h").distinct(), "labelled-keys")
    order = (F.xxhash64("id", "h", F.lit("toxic")), F.col("id"), F.col("h"))
    kept = held.where("y = 1").orderBy(*order).limit(positives).union(held.where("y = 0").orderBy(*order).limit(negatives))
    found = whole.join(F.broadcast(checkpointed(kept, "labelled-kept")), ["id", "h"])
    return found.dropDuplicates(["id", "y", "h"]).select("id", "y", "t")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", positives: int = POSITIVES, negatives: int = NEGATIVES, n_features: int = FEATURES) -> Model:
    """Fit the classifier on at most ``positives + negatives`` labelled texts."""
    texts = checkpointed(labelled(docs, labels, key, text, label, positives, negatives), "labelled")
    total = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), None)

    def counting():
        def each(column):
            row, h, n = features(column)
            _, first = np.unique(mix(h + mix(row.astype(np.uint64))), return_index=True)
            own = row[first]
            order = np.argsort(own, kind="stable")
            return [pa.ListArray.from_arrays(np.searchsorted(own[order], np.arange(n + 1)).astype(np.int32), pa.array(h[first][order].view(np.int64)))]

        return each

    counts = map_text(texts, "t", ["y"], {"f": "array<bigint>"}, counting).select("y", F.explode("f").alias("f"))
    counts = counts.groupBy("f").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")).where(F.col("p") + F.col("q") >= LEAST_TEXTS)
    odds = F.log((F.col("p") + 0.5) / (total[1] + 1)) - F.log((F.col("q") + 0.5) / (total[0] + 1))
    weight = F.abs(odds) / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("q") + 0.5))
    chosen = {r["f"] % (1 << 64) for r in counts.orderBy(F.desc(weight), "f").limit(n_features).collect()}
    groups = [[_of_term(t) for t in line.split()] for line in IDENTITY]
    feature = np.array(sorted(chosen.union(*[f for g in groups for f in g])), np.uint64)
    terms = [(g, i, np.array(sorted(f), np.uint64)) for g, line in enumerate(groups) for i, f in enumerate(line)]

    def present():
        def each(column):
            row, h, n = features(column)
            at = lookup(feature, h)
            pairs = np.unique(row[at >= 0] * len(feature) + at[at >= 0])
            return [pa.ListArray.from_arrays(np.searchsorted(pairs // len(feature), np.arange(n + 1)).astype(np.int32), pa.array((pairs % len(feature)).astype(np.int32)))]

        return each

    got = map_text(texts, "t", ["id", "y"], {"x": "array<int>"}, present).orderBy("id", "y").toPandas()
    y = got["y"].to_numpy(float)
    sizes = got["x"].map(len).to_numpy()
    x = np.concatenate([np.asarray(v, np.int64) for v in got["x"]]) if sizes.sum() else np.zeros(0, np.int64)
    swaps = _swaps(got["x"], terms, feature)
    weight, bias = _fit(x, np.concatenate([[0], np.cumsum(sizes)]), y, swaps, len(feature))
    return Model(feature, weight, bias)


def _swaps(rows, terms: list, feature: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text with identity terms: the features its swapped versions gain, and those they lose."""
    place = [(g, i, np.searchsorted(feature, f)) for g, i, f in terms]
    lines: dict[int, list[np.ndarray]] = {}
    for g, _, at in place:
        lines.setdefault(g, []).append(at)
    whole = {int(np.searchsorted(feature, np.uint64(w))): (g, i) for g, i, w in terms_of_words()}
    out = []
    for n, x in enumerate(rows):
        have = set(np.asarray(x).tolist())
        hit = sorted(have & whole.keys())
        if not hit:
            continue
        gain, lose = set(), set()
        for f in hit:
            g, i = whole[f]
            other = lines[g][(i + 1 + n % (len(lines[g]) - 1)) % len(lines[g])]
            lose |= set(lines[g][i].tolist())
            gain |= set(other.tolist())
        out.append((np.array(sorted(gain - have)), np.array(sorted((lose & have) - gain))))
        # and with a neutral word, which no feature stands for
        out.append((np.zeros(0, np.int64), np.array(sorted(lose & have))))
    return out


def terms_of_words() -> list[tuple[int, int, int]]:
    """Line, place and whole-word feature of every identity term."""
    return [(g, i, int(features(pa.array([t]))[1][0])) for g, line in enumerate(IDENTITY) for i, t in enumerate(line.split())]


def _fit(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, swaps: list, n: int) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on log loss, ridge and squared swap changes; positive texts have the weight ``PRIOR``."""
    row = np.repeat(np.arange(len(y)), np.diff(bounds))
    share = np.where(y == 1, PRIOR / max(y.sum(), 1), (1 - PRIOR) / max((1 - y).sum(), 1))
    if swaps:
        s_at = np.concatenate([np.concatenate([a, b]) for a, b in swaps]).astype(np.int64)
        s_sign = np.concatenate([np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in swaps])
        s_row = np.repeat(np.arange(len(swaps)), [len(a) + len(b) for a, b in swaps])
    w, b = np.zeros(n), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        z = row_sums(w[x], bounds) + b
        d = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(x, d[row], n) + 2 * RIDGE * w
        if swaps:
            change = np.bincount(s_row, w[s_at] * s_sign, len(swaps))
            grad += 2 * SWAP_WEIGHT / len(swaps) * np.bincount(s_at, change[s_row] * s_sign, n)
        g = np.append(grad, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row with ``score`` (0 to 1) and ``predicted`` (1 from 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.feature, model.weight, model.bias))

    def start():
        feature, weight, bias = shared.value

        def each(column):
            if bias is None:
                return [np.zeros(len(column)), np.zeros(len(column), np.int32)]
            row, h, n = features(column)
            at = lookup(feature, h)
            pairs = np.unique(row[at >= 0] * len(feature) + at[at >= 0])
            z = bias + np.bincount(pairs // len(feature), weight[pairs % len(feature)], n)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return [p, (p >= 0.5).astype(np.int32)]

        return each

    return map_text(docs, text, keep, {"score": "double", "predicted": "int"}, start)
