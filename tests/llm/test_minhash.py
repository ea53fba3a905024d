import random

import numpy as np
import pytest

from rolloom.llm import minhash
from rolloom.llm.components import components


def _shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _classes(rows):
    """Least key of each row's class, by comparing all pairs; rows are (key, text)."""
    sets = [_shingles(t) for _, t in rows]
    words = [tuple((t or "").lower().split()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if words[i] == words[j] or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                parent[find(i)] = find(j)
    best = {}
    for i, (key, _) in enumerate(rows):
        k = (key is None, key or 0)
        best[find(i)] = min(best.get(find(i), k), k)
    return [None if best[find(i)][0] else best[find(i)][1] for i in range(len(rows))]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 220))]
        for _ in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                k = rng.randrange(len(own))
                if rng.random() < 0.6:
                    own[k] = rng.choice(vocabulary)
                else:
                    del own[k]
            out.append(" ".join(own))
        if group % 3 == 0:
            out.append(" ".join(base[: len(base) // 2]) + " " + " ".join(rng.choice(vocabulary) for _ in range(60)))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    out += [" ".join(rng.choice(vocabulary) for _ in range(40)) + " " + passage for _ in range(10)]
    out += ["a b", "A  b", "a b c", None, "", " \n", "one two one two " * 20, "one two one two " * 19]
    rng.shuffle(out)
    keyed = [(i, t) for i, t in enumerate(out)]
    return [*keyed, (3, keyed[3][1]), (None, keyed[5][1]), (None, "alone in the world with nobody else around")]


def test_classes_equal_brute_force(spark, rows):
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, node string")
    got = minhash.near_duplicates(docs).select("doc_id", "class_id", "class_rows").collect()
    want = _classes(rows)
    assert sorted(map(repr, ((r[0], r[1]) for r in got))) == sorted(map(repr, ((k, c) for (k, _), c in zip(rows, want, strict=True))))
    sizes = {c: want.count(c) for c in want}
    assert all(r["class_rows"] == sizes[r["class_id"]] for r in got)


def test_one_row_of_each_class_stays(spark, rows):
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, _th string")
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(r[0]) for r in kept.collect()) == sorted(repr(c) for c in set(_classes(rows)))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).collect() == [] and minhash.keep_one(docs).collect() == []


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(1)
    shared, own = rng.integers(1, 1 << 62, 300, dtype=np.uint64), rng.integers(1, 1 << 62, 100, dtype=np.uint64)
    rows = np.repeat([0, 1], [350, 350])
    hashes = np.concatenate([shared, own[:50], shared, own[50:]])
    kept = minhash.registers(*minhash.weighted(rows, hashes), 2)
    assert abs((kept[0] == kept[1]).mean() - 300 / 400) < 0.15


def _probability_jaccard(x, y):
    """The definition: over shared shingles, one over the sum of the larger of the scaled weights."""
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in {*x, *y}) for d in x.keys() & y.keys())


def test_registers_estimate_the_probability_jaccard_of_weights():
    rng = np.random.default_rng(3)
    shared, own = rng.integers(1, 1 << 62, 60, dtype=np.uint64), rng.integers(1, 1 << 62, 60, dtype=np.uint64)
    for heavy in (0, 1, 2):
        texts = []
        for r in range(2):
            mine = np.concatenate([shared, own[30 * r : 30 * r + 30]])
            counts = np.ones(len(mine), int)
            counts[[slice(0, 0), slice(0, 30), slice(60, 90)][heavy]] = 1000
            texts.append(np.repeat(mine, counts))
        rows = np.repeat([0, 1], [len(t) for t in texts])
        r, h, w = minhash.weighted(rows, np.concatenate(texts))
        assert w.min() == 1.0 and w.max() <= minhash.HEAVIEST
        sets = [dict(zip(h[r == i].tolist(), w[r == i].tolist(), strict=True)) for i in (0, 1)]
        want = _probability_jaccard(*sets)
        # many sketches of renamed shingles
        hits = []
        for k in range(60):
            kept = minhash.registers(r, minhash.mix(h + np.uint64(k)), w, 2)
            hits.append((kept[0] == kept[1]).mean())
        assert abs(np.mean(hits) - want) < 0.02
        plain = len(sets[0].keys() & sets[1].keys()) / len(sets[0].keys() | sets[1].keys())
        assert want >= plain / (plain + (1 - plain) * minhash.HEAVIEST) - 1e-9


def test_repeated_lines_hide_no_pair(spark):
    """A line repeated a thousand times changes the plain similarity little: 100 shared shingles of 112 to 117."""
    rng = random.Random(8)
    rows = []
    for i in range(12):
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(104))
        spam = " ".join(f"s{rng.randrange(10**6)}" for _ in range(12))
        rows += [(2 * i, text), (2 * i + 1, text + "\n" + "\n".join([spam] * 1000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {k: k - k % 2 for k, _ in rows} == dict(zip([k for k, _ in rows], _classes(rows), strict=True))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
