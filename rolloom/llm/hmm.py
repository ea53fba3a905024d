"""Language-model scores of texts by a hidden Markov model over words.

Tokens are a text's words with ASCII letters in lower case, then one end token. Counts of
all training words are aggregated across partitions; the ``BASE_HEAD`` most frequent words
(a bound, cut at a count so that no sort of the vocabulary is needed) are broadcast, and
counts of all other words reach their texts by a join, so no count is dropped.

The model has ``STATES`` latent states. A state emits one of the ``HEAD`` most frequent
words, the end, or a rare word. Which rare word it is depends on the training counts, and
for unseen words, with the share that words seen once have, on a model of spellings:
trigrams of 64 byte classes, and bytes by class; so every text has a probability.

Baum-Welch runs over all training texts: each task sums expected counts of its pieces of
``PIECE`` tokens, the sums are added up by a shuffle on the word, and the bounded totals
(``HEAD`` times ``STATES`` numbers) give the next parameters on the driver. The first round
takes its states from each piece's most frequent corpus word. Scores use whole texts: the
scaled forward recursion gives the exact likelihood.

Null and empty texts have the end token alone. Repeated rows count and are scored each. A
row with a null key trains the model and is carried. Without training texts every count is
zero and the states stay alike. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.llm.arrow_text import gathered, lookup, map_text, row_sums, words
from rolloom.session import checkpointed

STATES, HEAD, BASE_HEAD, PIECE, ROUNDS = 8, 1 << 16, 1 << 18, 64, 2
#: Weight of the overall word distribution in a state's emissions, in tokens.
PRIOR = 500.0
_CLASSES = 64
#: Class of each byte: 0 is the edge of a word, then a-z, digits, marks, and bytes of other characters.
_CLASS = np.zeros(256, np.int64)
_CLASS[:128] = 31
_CLASS[97:123] = np.arange(1, 27)
_CLASS[48:58] = 27
_CLASS[[46, 44, 33]] = 28, 29, 30
_CLASS[128:192] = 33 + np.arange(64) % 31
_CLASS[192:] = 32


@dataclass
class Vocabulary:
    """Frequent words and totals of the training texts, and the spelling model."""

    hash: np.ndarray
    count: np.ndarray
    place: np.ndarray
    ends: int
    tokens: int
    types: int
    spelling: tuple[np.ndarray, np.ndarray]
    rare: int
    unseen: float


def _counter():
    def each(column):
        w = words(column, lower_ascii=True)
        n = len(w.offsets) - 1
        if not len(w.hash):
            return [[[] for _ in range(n)]]
        hashes, first, counts = np.unique(w.hash, return_index=True, return_counts=True)
        codes, last, _ = _trigrams(w.data, w.start[first], w.end[first])
        codes, seen = np.unique(np.concatenate([codes, _CLASSES**3 + last.astype(np.int64)]), return_counts=True)
        kind = np.concatenate([np.zeros(len(hashes), np.int8), np.ones(len(codes), np.int8)])
        structs = pa.StructArray.from_arrays(
            [pa.array(kind), pa.array(np.concatenate([hashes.view(np.int64), codes])), pa.array(np.concatenate([counts, seen]))], ["kind", "w", "c"]
        )
        # the counts of the slice go out with its first row
        return [pa.ListArray.from_arrays(np.array([0, *[len(kind)] * n], np.int32), structs)]

    return each


def _trigrams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the class trigrams of words, with edges around them; the last byte of each trigram (0 at the end edge); where each word begins."""
    length = end - start
    own = gathered(data, start, length)
    n = len(start)
    first = np.cumsum(length) - length + np.arange(n)
    kinds, bytes_ = np.zeros(len(own) + n, np.int64), np.zeros(len(own) + n, np.uint8)
    inner = np.ones(len(own) + n, bool)
    inner[first + length] = False
    kinds[inner], bytes_[inner] = _CLASS[own], own
    one, two = np.zeros_like(kinds), np.zeros_like(kinds)
    one[1:], two[2:] = kinds[:-1], kinds[:-2]
    one[first], two[first] = 0, 0
    second = first[length > 0] + 1
    two[second] = 0
    return (two * _CLASSES + one) * _CLASSES + kinds, bytes_, first


def spelling_model(counts: np.ndarray, of_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probabilities of class trigrams, smoothed by bigrams and single classes, and of bytes in their class."""
    three = counts.reshape(_CLASSES, _CLASSES, _CLASSES)
    two, one = three.sum(0), three.sum((0, 1)) + 0.5
    p1 = one / one.sum()
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (three + 5 * p2) / (three.sum(2, keepdims=True) + 5)
    some = of_bytes + 0.5
    total = np.bincount(_CLASS, some, _CLASSES)
    inside = np.log10(some / total[_CLASS])
    inside[0] = 0.0  # stands for the edge
    return np.log10(p3).ravel(), inside


def count_words(training: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Counts of all training words (``w``, ``c``), and of class trigrams and bytes in different words of a slice."""
    found = map_text(training, text, [], {"found": "array<struct<kind:tinyint,w:bigint,c:bigint>>"}, _counter)
    counts = checkpointed(found.select(F.inline("found")).groupBy("kind", "w").agg(F.sum("c").alias("c")), "words")
    return counts.where("kind = 0").select("w", "c"), counts.where("kind = 1").select("w", "c")


def vocabulary(counts: DataFrame, spellings: DataFrame, ends: int, base_head: int = BASE_HEAD, head: int = HEAD) -> Vocabulary:
    """The most frequent words, at most ``base_head``: all words above some count.

    ``rare`` is how many training tokens are not among the first ``head`` words, and
    ``unseen`` the probability that a rare word is a new one.
    """
    bin_ = F.when(F.col("c") < 4096, F.col("c")).otherwise(4096 + F.floor(64 * F.log2(F.col("c") / 4096))).cast("int")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count(F.when(F.col("c") == 1, 1))).first()
    cut, room = None, base_head
    for b, n in sorted(((r[0], r[1]) for r in counts.groupBy(bin_.alias("b")).agg(F.count("*")).collect()), reverse=True):
        if n > room:
            break
        cut, room = b, room - n
    frequent = counts.where(bin_ >= cut).toPandas() if cut is not None else None
    hashes = frequent["w"].to_numpy(np.int64).view(np.uint64) if frequent is not None else np.zeros(0, np.uint64)
    many = frequent["c"].to_numpy(np.int64) if frequent is not None else np.zeros(0, np.int64)
    order = np.argsort(hashes)
    hashes, many = hashes[order], many[order]
    place = np.empty(len(hashes), np.int32)
    place[np.lexsort((hashes, -many))] = np.arange(len(hashes))
    # at most one row per trigram and byte
    seen = spellings.toPandas()
    table = np.zeros(_CLASSES**3 + 256)
    table[seen["w"].to_numpy(np.int64)] = seen["c"].to_numpy(float)
    spelling = spelling_model(table[: _CLASSES**3], table[_CLASSES**3 :])
    rare = int(totals[0]) - int(many[place < head].sum())
    unseen = min(0.5, (int(totals[2]) + 1) / (rare + 2))
    return Vocabulary(hashes, many, place, ends, int(totals[0]) + ends, int(totals[1]) + (1 if ends else 0), spelling, rare, unseen)


def encode(docs: DataFrame, vocab: Vocabulary, keep: list[str], text: str = "text", head: int = HEAD) -> DataFrame:
    """Per row: ``ids`` (rare words are ``head``, the end ``head + 1``), ``rare``, counts, and hashes and spellings of words that need a join.

    ``rare`` sums the log10 probabilities of the rare words whose counts are at hand.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocab.hash, vocab.count, vocab.place, vocab.spelling))
    end_log = float(np.log10(vocab.ends + 1))
    seen_log = _seen_log(vocab)

    def start():
        known, many, place, spelling = shared.value
        logs = np.log10(many + 1.0)

        def each(column):
            w = words(column, lower_ascii=True)
            bounds = w.bounds
            n = len(bounds) - 1
            hashes, inverse = np.unique(w.hash, return_inverse=True)
            at = lookup(known, hashes)
            if len(known):
                ids = np.where(at >= 0, np.minimum(place[at], head), head)[inverse]
                base = np.where(at >= 0, logs[at], 0.0)[inverse]
            else:
                ids, base = np.full(len(inverse), head), np.zeros(len(inverse))
            found = (at >= 0)[inverse]
            own = np.where((at >= 0) & (place[at] >= head), seen_log + np.log10(np.maximum(many[at], 1)), 0.0)[inverse] if len(known) else np.zeros(len(ids))
            far = np.flatnonzero(~found)
            spelled = np.zeros(0)
            if len(far):
                codes, last, first = _trigrams(w.data, w.start[far], w.end[far])
                spelled = np.add.reduceat(spelling[0][codes] + spelling[1][last], first)
            with_end = np.insert(ids, bounds[1:], head + 1).astype(np.int32)
            lists = pa.ListArray.from_arrays((bounds + np.arange(n + 1)).astype(np.int32), pa.array(with_end))
            structs = pa.StructArray.from_arrays([pa.array(w.hash[far].view(np.int64)), pa.array(spelled.astype(np.float32))], ["w", "spelled"])
            far_lists = pa.ListArray.from_arrays(np.searchsorted(far, bounds).astype(np.int32), structs)
            return [lists, np.diff(bounds) + 1, row_sums(own, bounds), row_sums(base, bounds) + end_log, row_sums(found.astype(np.int64), bounds), far_lists]

        return each

    added = {"ids": "array<int>", "n_tokens": "bigint", "rare": "double", "base": "double", "n_known": "bigint", "far": "array<struct<w:bigint,spelled:float>>"}
    return map_text(docs, text, keep, added, start)


def _seen_log(vocab: Vocabulary) -> float:
    """log10 of what one training count adds to a rare word's probability."""
    return float(np.log10((1 - vocab.unseen) / max(vocab.rare, 1)))


@dataclass
class Model:
    """Start, transition and emission probabilities; emissions by token and state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _pieces(ids: np.ndarray, bounds: np.ndarray, piece: int) -> np.ndarray:
    """Rows of ``piece`` token ids, cut inside texts; ends are filled with -1."""
    sizes = np.diff(bounds)
    per = (sizes + piece - 1) // piece
    first = np.repeat(bounds[:-1], per) + piece * (np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per))
    last = np.minimum(first + piece, np.repeat(bounds[1:], per))
    at = first[:, None] + np.arange(piece)
    return np.where(at < last[:, None], ids[np.minimum(at, len(ids) - 1)], -1)


def expected(tokens: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State probabilities of each token, expected moves, and expected start states of pieces."""
    n, length = tokens.shape
    k = len(model.start)
    real = tokens >= 0
    seen = model.emit[np.maximum(tokens, 0)]
    seen[~real] = 1.0
    forward, scale = np.empty((length, n, k)), np.empty((length, n))
    a = model.start * seen[:, 0]
    for t in range(length):
        if t:
            a = (forward[t - 1] @ model.move) * seen[:, t]
        scale[t] = a.sum(1)
        forward[t] = a / scale[t][:, None]
    moves = np.zeros((k, k))
    back = np.ones((n, k))
    state = np.empty((n, length, k))
    for t in range(length - 1, -1, -1):
        state[:, t] = forward[t] * back * real[:, t, None]
        if t:
            next_ = seen[:, t] * back / scale[t][:, None]
            moves += (forward[t - 1] * real[:, t, None]).T @ next_
            back = next_ @ model.move.T
    return state, moves * model.move, state[:, 0].sum(0)


def _expectations(encoded: DataFrame, model: Model | None, states: int, head: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected emissions, moves and starts over all texts; moves and starts come as rows below 0."""
    shared = encoded.sparkSession.sparkContext.broadcast(vars(model) if model else None)
    size = head + 2

    def run(batches):
        now = Model(**shared.value) if shared.value else None
        emitted = np.zeros((states, size))
        moves, starts = np.zeros((states, states)), np.zeros(states)
        for batch in batches:
            column = batch.column(0)
            flat, bounds = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            tokens = _pieces(flat, bounds, piece)
            for i in range(0, len(tokens), 2048):
                own = tokens[i : i + 2048]
                real = own >= 0
                if now is None:
                    least = np.where(real, own, size).min(1) % states
                    state = np.full((*own.shape, states), 0.3 / states)
                    state[np.arange(len(own)), :, least] += 0.7
                    state *= real[:, :, None]
                    moves += np.eye(states) * real[:, 1:].sum() / states
                    starts += state[:, 0].sum(0)
                else:
                    state, more, begun = expected(own, now)
                    moves += more
                    starts += begun
                ids = own[real]
                for s in range(states):
                    emitted[s] += np.bincount(ids, state[:, :, s][real], size)
        used = np.flatnonzero(emitted.sum(0))
        keys = np.concatenate([used, -1 - np.arange(states), [-1 - states]])
        values = np.concatenate([emitted[:, used].T, moves, starts[None]])
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), *[pa.array(values[:, s]) for s in range(states)]], ["w", *[f"g{s}" for s in range(states)]])

    schema = "w int, " + ", ".join(f"g{s} double" for s in range(states))
    got = encoded.select("ids").mapInArrow(run, schema).groupBy("w").agg(*[F.sum(f"g{s}").alias(f"g{s}") for s in range(states)]).toPandas()
    keys, values = got["w"].to_numpy(), got[[f"g{s}" for s in range(states)]].to_numpy(float)
    emitted, moves, starts = np.zeros((size, states)), np.zeros((states, states)), np.zeros(states)
    emitted[keys[keys >= 0]] = values[keys >= 0]
    for key, row in zip(keys[keys < 0], values[keys < 0], strict=True):
        if key == -1 - states:
            starts = row
        else:
            moves[-1 - key] = row
    return emitted, moves, starts


def fit(encoded: DataFrame, states: int = STATES, head: int = HEAD, rounds: int = ROUNDS, piece: int = PIECE) -> Model:
    """Baum-Welch over all encoded training texts."""
    model = None
    for _ in range(rounds + 1):
        emitted, moves, starts = _expectations(encoded, model, states, head, piece)
        overall = emitted.sum(1) + 0.01
        overall /= overall.sum()
        emit = emitted + PRIOR * overall[:, None]
        moves = moves + 1.0 + (0.05 * moves.sum(1, keepdims=True) / states if model is None else 0.0)
        model = Model((starts + 1) / (starts + 1).sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0))
    return model


def likelihoods(ids: np.ndarray, bounds: np.ndarray, model: Model) -> np.ndarray:
    """log10 likelihood of each sequence by the scaled forward recursion; all sequences advance together."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = bounds[:-1][order], sizes[order]
    out = np.zeros(len(order))
    state = np.tile(model.start, (len(order), 1))
    going = len(order)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        while sizes[going - 1] <= t:
            going -= 1
        ahead = state[:going] @ model.move if t else state[:going]
        ahead = ahead * model.emit[ids[first[:going] + t]]
        total = ahead.sum(1)
        out[:going] += np.log10(total)
        state = ahead / total[:, None]
    back = np.empty(len(out))
    back[order] = out
    return back


def score(docs: DataFrame, training: str, key: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS, head: int = HEAD, base_head: int = BASE_HEAD) -> DataFrame:
    """Scores of all rows, learned from the rows for which the boolean column ``training`` holds.

    Returns the key, ``training``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (add-one unigram) and ``score`` (the model), both log10 probabilities.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(training), F.lit(False)).alias("learn"), F.col(text).alias("t"))
    counts, spellings = count_words(rows.where("learn"), "t")
    vocab = vocabulary(counts, spellings, rows.where("learn").count(), base_head, head)
    numbered = encode(rows, vocab, ["id", "learn"], "t", head).withColumn("row", F.monotonically_increasing_id())
    encoded = checkpointed(numbered, "encoded")
    model = fit(encoded.where("learn"), states, head, rounds)

    seen = F.lit(_seen_log(vocab)) + F.log10("c")
    new = F.lit(float(np.log10(vocab.unseen))) + F.col("spelled")
    far = encoded.select("row", F.inline("far")).join(counts, "w", "left").groupBy("row").agg(
        F.sum(F.log10(F.col("c") + 1)).alias("far_base"), F.count("c").alias("far_known"), F.sum(F.coalesce(seen, new)).alias("far_rare")
    )
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        now = Model(**shared.value)
        for batch in batches:
            column = batch.column(1)
            bounds = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(likelihoods(column.flatten().to_numpy(), bounds, now))], ["row", "like"])

    scored = encoded.select("row", "ids").mapInArrow(run, "row bigint, like double")
    out = encoded.select("row", "id", "learn", "n_tokens", "rare", "base", "n_known").join(scored, "row").join(far, "row", "left")
    divisor = float(np.log10(vocab.tokens + vocab.types + 1))
    return out.select(
        F.col("id").alias(key), F.col("learn").alias(training), "n_tokens",
        (F.col("n_known") + F.coalesce("far_known", F.lit(0)) + (1 if vocab.ends else 0)).alias("n_known"),
        F.lit(vocab.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("far_base", F.lit(0.0)) - F.col("n_tokens") * divisor).alias("base_score"),
        (F.col("like") + F.col("rare") + F.coalesce("far_rare", F.lit(0.0))).alias("score"),
    )
