import hashlib
import random
from collections import Counter, defaultdict

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from rolloom.llm import alignment, bpe

A_PATH, B_PATH = alignment.default_paths()
TEXTS = ["", None, " ", "foo ", "  two  spaces ", "a\n\n b\t c", "\n x", "it's 'll <|endoftext|> </s> <0x41> <s>", "é 中文 😀 ½ x", "lit ▁ x", "x" * 3000, " " * 700 + "y", "dup text here", "dup text here", "0123456789abcdef" * 40, "\x1c a\x85 b  c", "中文字符" * 200]


@pytest.fixture(scope="module")
def whole():
    a, b = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    letters = {c: i for i, c in enumerate(bpe._byte_letters())}

    def both(text):
        """Ids and token bytes of a whole text."""
        e = a.encode(" " + text, add_special_tokens=False)
        left = [(i, bytes(letters[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
        right = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        ok = text != "" and all(b"".join(t for _, t in s) == raw for s in (left, right))
        return (left, right) if ok else ([], [])

    return both


def brute(texts, both):
    """Groups, links and counts straight from the definitions, all token pairs written out."""
    rows, held = [], Counter()
    for text in texts:
        left, right = both(text or "")
        ends, at = [], 0
        for _, t in left:
            at += len(t)
            ends.append(at)
        at, other = 0, set()
        for _, t in right:
            at += len(t)
            other.add(at)
        cuts = [0] + [e for e in ends if e in other]
        spots = {e: i for i, e in enumerate(cuts)}
        groups = [([], []) for _ in cuts[1:]]
        for side, tokens in enumerate((left, right)):
            at, g = 0, 0
            for i, t in tokens:
                g = spots.get(at, g)
                groups[g][side].append(i)
                at += len(t)
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        held.update(set(links))
        rows.append((len(left), len(right), groups, links))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for n_a, n_b, groups, links in rows:
        line = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(line.encode()).hexdigest() if line else ""))
    return out


def random_texts(n, seed):
    rng = random.Random(seed)
    pool = list("   \n\tabcdeehillo thethe ingAZ09.,'\"-<>|éß中文😀  ")
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def columns(rows):
    return [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in rows]


def test_report_equals_all_pairs(spark, whole):
    texts = TEXTS + random_texts(300, 3)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string").repartition(3)
    got = columns(alignment.report(docs, A_PATH, B_PATH).orderBy("doc_id").collect())
    assert got == brute(texts, whole)


def test_a_text_of_several_blocks(spark, whole):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij0123") for _ in range(rng.randint(2, 12))) for _ in range(3000)]
    texts = ["short one", " ".join(rng.choice(words) for _ in range(80_000)), "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = columns(alignment.report(docs, A_PATH, B_PATH).orderBy("doc_id").collect())
    assert got[1][0] + got[1][1] > 1.5 * alignment.BLOCK_TOKENS
    assert got == brute(texts, whole)


def test_small_blocks_give_the_same_rows(whole, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", 20)
    texts = [t for t in TEXTS if t] + random_texts(40, 5)
    with open(A_PATH, "rb") as a, open(B_PATH, "rb") as b:
        v = bpe.Vocabulary(A_PATH)
        units = alignment.Units(a.read(), b.read(), [v.token_bytes[s : s + n].tobytes() for s, n in zip(v.token_start, v.token_len, strict=True)])
    got = [Counter() for _ in texts]
    read = [r if units.good[r].all() else r[:0] for r in units.of(texts)]
    for unit, doc in alignment.blocks(units, read):
        for d, p, n in alignment.pair_counts(alignment.aligned(units, unit, doc)):
            for x, y, z in zip(d.tolist(), p.tolist(), n.tolist(), strict=True):
                got[x][y >> 32, y & 0xFFFFFFFF] += z
    for text, pairs in zip(texts, got, strict=True):
        (n_a, n_b, _, n_links, _, _, _), = brute([text], whole)
        assert sum(pairs.values()) == n_links


def test_overlaps_are_the_union_of_both_directions(whole):
    with open(A_PATH, "rb") as a, open(B_PATH, "rb") as b:
        v = bpe.Vocabulary(A_PATH)
        units = alignment.Units(a.read(), b.read(), [v.token_bytes[s : s + n].tobytes() for s, n in zip(v.token_start, v.token_len, strict=True)])
    text = "unbelievably 0123456789abcdef tokenization"
    (own,) = units.of([text])
    block = alignment.aligned(units, own, alignment.np.zeros(len(own), int))
    got = {(int(x), int(y)) for w in block.overlaps for x, y in zip(w["a"], w["b"], strict=True)}
    want = {(i, j) for i in range(len(block.a.ids)) for j in range(len(block.b.ids)) if max(block.a.start[i], block.b.start[j]) < min(block.a.end[i], block.b.end[j])}
    assert got == want


def test_groups_tile_each_text(spark, whole):
    texts = TEXTS + random_texts(30, 9)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = defaultdict(list)
    for r in alignment.groups(docs, A_PATH, B_PATH).collect():
        found[r["doc_id"]].append(r)
    for i, text in enumerate(texts):
        left, right = whole(text or "")
        rows = sorted(found[i], key=lambda r: r["place"])
        assert [x for r in rows for x in r["a_ids"]] == [x for x, _ in left]
        assert [x for r in rows for x in r["b_ids"]] == [x for x, _ in right]
        assert [r["start"] for r in rows] == [0, *(r["stop"] for r in rows)][: len(rows)]
        assert not rows or rows[-1]["stop"] == len((" " + text).encode())


def test_empty_table_null_keys_and_hot_keys(spark, whole, monkeypatch):
    assert alignment.report(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH).collect() == []
    texts = ["the cat sat"] * 20 + ["the dog", None, "cat"]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert sorted(columns(alignment.report(docs, A_PATH, B_PATH).collect())) == sorted(brute(texts, whole))
