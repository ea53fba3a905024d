"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The vocabulary file of a public tokenizer is read on the driver and broadcast (its size is
fixed by the file: 50,000 merges are about 3 MB). On the executors a slice of texts is
cut into pretokens by array operations on character classes; the distinct pretokens are
merged together: their symbols lie in one flat array, and in each round every pretoken
merges its lowest-ranked pair, found by binary search over the sorted pair keys. There is
no shuffle. Null and empty texts have no tokens; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.llm.arrow_text import code_points, gathered, letter_classes, lookup, map_text, span_hashes, utf8

_NONE = np.int32(2**31 - 1)
_LETTER, _SPACE = 1, 3
#: Pretokens kept per task between slices.
CACHE = 1 << 20


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merges and tokens of a byte-level BPE file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"] or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        self.classes = letter_classes()
        letters = _byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        ids = model["vocab"]
        self.byte_ids = np.array([ids[c] for c in letters], np.int32)
        added = {a["content"].encode(): a["id"] for a in spec["added_tokens"]}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
            raise ValueError("added tokens with strip rules are not supported")
        self.added = added
        size = max([*ids.values(), *added.values()]) + 1
        tokens = [b""] * size
        for token, i in ids.items():
            tokens[i] = bytes(byte_of[c] for c in token)
        for token, i in added.items():
            tokens[i] = token
        self.token_bytes, self.token_start, self.token_len = _flat(tokens)
        self.digits, self.digit_start, self.digit_len = _flat([b"%d," % i for i in range(size)])

        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        born = np.full(size, -1, np.int64)
        born[made] = np.arange(len(pairs))
        # rounds equal one-by-one merging only if a merge's parts come from earlier merges
        if len(set(made.tolist())) != len(made) or (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any():
            raise ValueError("merges do not build on earlier merges")
        order = np.argsort(left << 32 | right)
        self.pair_keys, self.pair_rank = (left << 32 | right)[order], order.astype(np.int32)
        self.made = made

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = lookup(self.pair_keys, left.astype(np.int64) << 32 | right)
        return np.where(at >= 0, self.pair_rank[at], _NONE)

    def merge(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many byte spans: flat ids and how many each span has."""
        symbol = self.byte_ids[gathered(data, start, length)]
        word = np.repeat(np.arange(len(start)), length)
        done_ids, done_words = [], []
        rank = np.full(len(symbol), _NONE, np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.rank(symbol[inner], symbol[inner + 1])
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(first, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, first), sizes)
            open_ = best != _NONE
            if not open_.all():
                done_ids.append(symbol[~open_])
                done_words.append(word[~open_])
                symbol, word, rank, best = symbol[open_], word[open_], rank[open_], best[open_]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == best)
            # of overlapping equal pairs every second one merges, from the left
            fresh = np.concatenate([[True], np.diff(hit) != 1])
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbol[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            at = np.cumsum(keep)[hit] - 1
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            redo = np.concatenate([at, at - 1])
            redo = redo[redo >= 0]
            rank[redo] = _NONE
            redo = redo[redo + 1 < len(symbol)]
            redo = redo[word[redo] == word[redo + 1]]
            rank[redo] = self.rank(symbol[redo], symbol[redo + 1])
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int32)
        words = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        order = np.argsort(words, kind="stable")
        return ids[order], np.bincount(words, minlength=len(start))

    def pretokens(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Start bytes of the pretokens of UTF-8 rows.

        The rule is the public pattern of the vocabulary, as runs of character classes:
        a run takes the single space before it; of white space before text, the last
        character stands alone; an apostrophe alone before s, t, re, ve, m, ll or d
        makes a pretoken with it.
        """
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        n = len(lead)
        if not n:
            return lead
        code = code_points(data)
        kind = self.classes[code]
        border = np.zeros(n + 1, bool)
        border[np.searchsorted(lead, offsets[:-1])] = True
        border[n] = True
        specials = []
        if self.added:
            for m in re.finditer(b"|".join(map(re.escape, self.added)), data.tobytes()):
                if np.searchsorted(offsets, m.start(), side="right") == np.searchsorted(offsets, m.end() - 1, side="right"):
                    a, b = np.searchsorted(lead, [m.start(), m.end()])
                    border[[a, b]] = True
                    specials.append((a, b))
        begin = border[:n].copy()
        begin[1:] |= kind[1:] != kind[:-1]
        space = kind == _SPACE
        # the last white space before text
        before_text = np.zeros(n, bool)
        before_text[:-1] = space[:-1] & ~space[1:] & ~border[1:n]
        token = begin | before_text
        takes = np.flatnonzero(before_text & (code == 32))
        token[takes + 1] = False
        alone = np.flatnonzero((code[:-1] == 39) & token[:-1] & (kind[1:] == _LETTER) & ~border[1:n]) if n > 1 else np.zeros(0, np.int64)
        if len(alone):
            one = code[alone + 1]
            second = np.minimum(alone + 2, n - 1)
            has_two = (alone + 2 < n) & ~border[np.minimum(alone + 2, n)]
            two = np.where(has_two, code[second], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long_ = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            token[alone[short | long_] + 1] = False
            after = np.concatenate([alone[short] + 2, alone[long_] + 3])
            token[after[after < n]] = True
        for a, b in specials:
            token[a + 1 : b] = False
        return lead[token]

    def encode(self, data: np.ndarray, offsets: np.ndarray, cache: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of UTF-8 rows: flat ids and how many each row has."""
        start = self.pretokens(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        length = np.diff(np.append(start, len(data)))
        hashes, where, inverse = np.unique(span_hashes(data, start, length), return_index=True, return_inverse=True)
        cache = {} if cache is None else cache
        known = cache.get("hash", np.zeros(0, np.uint64))
        new = np.flatnonzero(lookup(known, hashes) < 0)
        if len(new):
            spans, lens = start[where[new]], length[where[new]]
            order = np.argsort(spans)
            ids, counts = self.merge(data, spans[order], lens[order])
            for content, i in self.added.items():
                for k in np.flatnonzero(lens[order] == len(content)):
                    s = spans[order][k]
                    if data[s : s + len(content)].tobytes() == content:
                        at = int(counts[:k].sum())
                        ids = np.concatenate([ids[:at], [np.int32(i)], ids[at + counts[k] :]])
                        counts[k] = 1
            first = np.cumsum(counts) - counts
            if len(known) + len(new) > CACHE and len(known):
                cache.clear()
                return self.encode(data, offsets, cache)
            base = len(cache.get("ids", ()))
            at = np.empty(len(new), np.int64)
            many = np.empty(len(new), np.int64)
            at[order], many[order] = first + base, counts
            merged = np.concatenate([known, hashes[new]])
            sort = np.argsort(merged, kind="stable")
            cache["hash"] = merged[sort]
            cache["at"] = np.concatenate([cache.get("at", np.zeros(0, np.int64)), at])[sort]
            cache["n"] = np.concatenate([cache.get("n", np.zeros(0, np.int64)), many])[sort]
            cache["ids"] = np.concatenate([cache.get("ids", np.zeros(0, np.int32)), ids]).astype(np.int32)
        entry = lookup(cache["hash"], hashes)[inverse]
        counts = cache["n"][entry]
        flat = gathered(cache["ids"], cache["at"][entry], counts)
        total = np.concatenate([[0], np.cumsum(counts)])
        return flat, np.diff(total[np.searchsorted(start, offsets)])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a run of tokens."""
        return gathered(self.token_bytes, self.token_start[ids], self.token_len[ids]).tobytes()

    def listed(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return gathered(self.digits, self.digit_start[ids], self.digit_len[ids]).tobytes()[:-1]


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(length) - length, length


def default_path() -> str:
    """The byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _shared(spark: SparkSession, path: str):
    """The vocabulary as a broadcast of plain arrays, and how a task gets it back."""
    arrays = spark.sparkContext.broadcast(vars(Vocabulary(path)))

    def get() -> Vocabulary:
        vocabulary = Vocabulary.__new__(Vocabulary)
        vars(vocabulary).update(arrays.value)
        return vocabulary

    return get


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every text: the key and ``ids``, in document order of tokens."""
    get = _shared(docs.sparkSession, path)

    def start():
        vocabulary, cache = get(), {}

        def each(column):
            ids, counts = vocabulary.encode(*utf8(column), cache)
            bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            return [pa.ListArray.from_arrays(bounds, pa.array(ids, pa.int32()))]

        return each

    return map_text(docs, text, [key], {"ids": "array<int>"}, start)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of token ids: the key and ``text``. Bytes that are no UTF-8 become U+FFFD; null ids give an empty text."""
    get = _shared(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]):
        vocabulary = get()
        for batch in batches:
            texts = [vocabulary.decode(v.values.to_numpy()).decode("utf-8", "replace") if v.is_valid and len(v) else "" for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["k", "t"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(run, f"k {kind}, t string").toDF(key, "text")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the key, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; the text is encoded, and the ids decoded again."""
    get = _shared(docs.sparkSession, path)

    def start():
        vocabulary, cache = get(), {}

        def each(column):
            ids, counts = vocabulary.encode(*utf8(column), cache)
            parts = np.split(ids, np.cumsum(counts)[:-1])
            listed = [hashlib.sha256(vocabulary.listed(own)).hexdigest() for own in parts]
            decoded = [hashlib.sha256(vocabulary.decode(own).decode("utf-8", "replace").encode()).hexdigest() for own in parts]
            return [counts.astype(np.int64), listed, decoded]

        return each

    return map_text(docs, text, [key], {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, start)
