import hashlib
import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rolloom.llm import bpe
from rolloom.llm.arrow_text import utf8

TEXTS = ["", None, "a<|endoftext|> b", " <|endoftext|>", "it's 'tis 'S don't''s 'll'l '", "a" * 3000, " " * 50 + "x", "'s", "x's\n\n y", "é 中文 😀 ½", "dup", "dup"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.default_path())


def _split(vocabulary, texts):
    ids, counts = vocabulary.encode(*utf8(pa.array(texts, pa.string())))
    out, at = [], 0
    for n in counts:
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def test_random_texts_encode_as_the_library(library, vocabulary):
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(0x300), 0x2028, 0x3000, 0x85, 0xA0, 0x200B, 0xFEFF, 0x4E2D, 0x1F600, 0x660, 0xBD, 0x2160]]
    plain = list("  \n\t''strevmlld aaAA11.,<|endoftext|>")
    texts = ["".join(rng.choice(pool if rng.random() < 0.3 else plain) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    assert _split(vocabulary, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_character_has_the_librarys_class(library, vocabulary):
    every = "".join(chr(c) + "x" for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    texts = [every[i : i + 4000] for i in range(0, len(every), 4000)]
    assert _split(vocabulary, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_digests_and_round_trip(spark, library):
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    got = sorted(tuple(r) for r in bpe.digests(docs, bpe.default_path()).fillna({"doc_id": 0}).collect())
    want = []
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want)
    encoded = bpe.encode(docs, bpe.default_path())
    assert sorted(r["text"] for r in bpe.decode(encoded, bpe.default_path()).collect()) == sorted(t or "" for t in TEXTS)


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), bpe.default_path()).collect() == []
