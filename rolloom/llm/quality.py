"""Quality rules: text statistics and learned decision lists.

Statistics of whole texts are computed once and written. Rules are learned from labelled
statistics by sequential covering: a rule grows by the threshold with the highest gain
until it covers no good text, is pruned on texts kept back, and stays while it is precise;
the texts it covers leave. The list becomes one ordered ``when`` expression.

Learning reads at most ``SAMPLE`` labelled rows, thinned by a hash of the key; it covers
all when there are fewer. Null and empty texts have no words and fail the base rule.
Repeated rows give repeated results; a null key or label is never learned from. Without
labels of both kinds the list is empty and the base rule decides alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.llm.arrow_text import map_text, mix, row_sums, span_hashes, words
from rolloom.session import checkpointed

#: Labelled rows at most, rules at most, conditions in a rule at most, and the least precision and cover of a rule.
SAMPLE, RULES, CONDITIONS, PRECISION, COVER = 20_000, 16, 4, 0.97, 3
#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint"}
RATES = ("word_length", "symbol_rate", "line_words", "dup_line_rate", "repeat_rate", "top_word_rate", "distinct_rate", "same_next_rate", "upper_rate", "exclaim_rate", "digit_rate")


def _flag(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.int32)
    table[list(chars)] = 1
    return table


_SYMBOL, _UPPER, _LOWER, _DIGIT, _EXCLAIM = _flag(SYMBOLS), _flag(bytes(range(65, 91))), _flag(bytes(range(97, 123))), _flag(b"0123456789"), _flag(b"!")


def _statistics():
    def each(column):
        w = words(column)
        data, at, bounds, row = w.data, w.offsets, w.bounds, w.row
        n, n_words = len(at) - 1, np.diff(bounds)
        size = np.maximum(n_words, 1)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        chars = row_sums(lead[w.end] - lead[w.start], bounds) if len(w.start) else np.zeros(n, np.int64)
        total = lambda table: row_sums(table[data].astype(np.int64), at)

        # lines with a word, and those equal to an earlier one
        stops = np.flatnonzero(data == 10)
        begin = np.unique(np.concatenate([at[:-1], stops + 1]))
        begin = begin[begin < len(data)]
        end = np.append(begin[1:], len(data))
        end = np.where((end > begin) & (data[end - 1] == 10), end - 1, end) if len(begin) else end
        filled = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
        begin, end = begin[filled], end[filled]
        line_row = np.searchsorted(at, begin, side="right") - 1
        lines = np.bincount(line_row, minlength=n)
        one = mix(span_hashes(data, begin, end - begin) + mix(line_row.astype(np.uint64))) if len(begin) else np.zeros(0, np.uint64)
        _, first = np.unique(one, return_index=True)
        dup = lines - np.bincount(line_row[first], minlength=n)

        salt = mix(row.astype(np.uint64))
        repeat = np.zeros(len(row), bool)
        if len(row) > 2:
            inside = np.flatnonzero(row[:-2] == row[2:])
            h = w.hash
            three = mix(mix(mix(h[inside] + salt[inside]) + h[inside + 1]) + h[inside + 2])
            _, where, counts = np.unique(three, return_inverse=True, return_counts=True)
            again = inside[counts[where] > 1]
            for k in range(3):
                repeat[again + k] = True
        n_repeat = row_sums(repeat.astype(np.int64), bounds)
        _, first, counts = np.unique(mix(w.hash + salt), return_index=True, return_counts=True)
        top, distinct = np.zeros(n, np.int64), np.bincount(row[first], minlength=n)
        np.maximum.at(top, row[first], counts)
        same = np.zeros(len(row), np.int64)
        if len(row) > 1:
            same[1:] = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])
        symbols, upper = total(_SYMBOL), total(_UPPER)
        return [
            n_words, chars, symbols, dup, n_repeat,
            chars / size, symbols / size, n_words / np.maximum(lines, 1), dup / np.maximum(lines, 1), n_repeat / size, top / size, distinct / size,
            row_sums(same, bounds) / size, upper / np.maximum(upper + total(_LOWER), 1), total(_EXCLAIM) / size, total(_DIGIT) / size,
        ]

    return each


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row with the counts and rates of its text."""
    return map_text(docs, text, keep, COUNTS | dict.fromkeys(RATES, "double"), _statistics)


@dataclass(frozen=True)
class Condition:
    """``name`` at least (``above``) or below ``limit``."""

    name: str
    above: bool
    limit: float

    def column(self) -> Column:
        return F.col(self.name) >= self.limit if self.above else F.col(self.name) < self.limit

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.name] >= self.limit if self.above else values[self.name] < self.limit


def _covers(rule: list[Condition], values: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(lambda a, c: a & c.holds(values), rule, np.ones(n, bool))


def _grow(values: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Add the threshold with the highest information gain while good texts are covered."""
    inside, rule = np.ones(len(bad), bool), []
    while len(rule) < CONDITIONS and (inside & ~bad).any() and (inside & bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        start, best, chosen = np.log2(p0 / (p0 + n0)), 0.0, None
        for name, v in values.items():
            order = np.argsort(v[inside], kind="stable")
            x, y = v[inside][order], bad[inside][order]
            cuts = np.flatnonzero(x[1:] > x[:-1]) + 1
            if not len(cuts):
                continue
            below = np.concatenate([[0], np.cumsum(y)])[cuts]
            for above in (True, False):
                p = p0 - below if above else below
                size = len(x) - cuts if above else cuts
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / size) - start), -1.0)
                i = int(gain.argmax())
                if gain[i] > best + 1e-9:
                    best, chosen = float(gain[i]), Condition(name, above, float((x[cuts[i] - 1] + x[cuts[i]]) / 2))
        if chosen is None:
            break
        rule.append(chosen)
        inside &= chosen.holds(values)
    return rule


def _prune(rule: list[Condition], values: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Drop last conditions while precision on the texts kept back does not fall."""
    def worth(r: list[Condition]) -> tuple[float, int]:
        c = _covers(r, values, len(bad))
        return ((c & bad).sum() + 0.5) / (c.sum() + 1.0), int((c & bad).sum())

    best = rule
    for size in range(len(rule) - 1, 0, -1):
        if worth(rule[:size])[0] >= worth(best)[0]:
            best = rule[:size]
    return best


def learn(values: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7) -> list[list[Condition]]:
    """An ordered list of rules for bad texts from labelled statistics."""
    back = np.random.default_rng(seed).random(len(bad)) < 1 / 3
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < RULES and (left & bad & ~back).sum() >= COVER:
        cut = lambda m: {k: v[m] for k, v in values.items()}  # noqa: E731, B023
        grown = _grow(cut(left & ~back), bad[left & ~back])
        if not grown:
            break
        rule = _prune(grown, cut(left & back), bad[left & back])
        covered = left & _covers(rule, values, len(bad))
        if (covered & bad).sum() < COVER or (covered & bad).sum() < PRECISION * covered.sum():
            rule, covered = grown, left & _covers(grown, values, len(bad))
            held = covered & back
            if (covered & bad).sum() < max(COVER, PRECISION * covered.sum()) or (held & bad).sum() < PRECISION * held.sum():
                break
        rules.append(rule)
        left &= ~covered
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list as an ordered expression: false where a rule for bad texts holds first, else true."""
    out = F.when(F.lit(False), F.lit(True))
    for rule in rules:
        out = out.when(reduce(lambda a, b: a & b, [c.column() for c in rule]), F.lit(False))
    return out.otherwise(F.lit(True))


def base_failed() -> Column:
    """The fixed base rule."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def examples(found: DataFrame, names: list[str], sample: int) -> DataFrame:
    """At most ``sample`` different labelled rows, first in the order of a hash: a repeated key adds no more than that."""
    different = found.select("_key", "bad", *names).distinct()
    return different.orderBy(F.xxhash64("_key", "bad", *names), "_key", "bad", *names).limit(sample).orderBy("_key", "bad", *names)


def judged(docs: DataFrame, labels: DataFrame, learned_from: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> tuple[DataFrame, list[list[Condition]]]:
    """Per row the key, the counts, ``base_failed`` and ``kept``; and the rules.

    ``learned_from`` is a condition on the labels' columns that marks rows to learn from.
    """
    stats = checkpointed(statistics(docs.select(F.col(key).alias("id"), F.col(text).alias("t")), ["id"], "t"), "statistics")
    given = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (learned_from if learned_from is not None else F.lit(True)))
    given = given.select(F.col(key).alias("_key"), (F.col(label) == 0).alias("bad"))
    n = given.count()
    h = F.pmod(F.xxhash64("_key", F.lit("quality")), F.lit(1 << 30))
    thin = given.where(h < int(min(1.0, sample / max(n, 1)) * (1 << 30)))
    names = [*RATES, *COUNTS]
    # the base rule has its own say: the list learns from what passes it
    got = examples(stats.where(~base_failed()).join(thin, F.col("id") == F.col("_key")), names, sample).toPandas()
    rules = learn({c: got[c].to_numpy(float) for c in names}, got["bad"].to_numpy(bool)) if len(got) else []
    out = stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return out.select(F.col("id").alias(key), *COUNTS, "base_failed", "kept"), rules
