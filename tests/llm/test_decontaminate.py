import numpy as np

from rolloom.llm import decontaminate

ITEMS = [(1, "If Alice has 12 apples and gives Bob 5 apples, how many apples does Alice keep for 3 days?"), (2, "short one here"), (3, "we saw four big dogs"), (4, None)]
ITEM_SHAPE, SHAPE = "item_id long, text string", "doc_id long, text string, h string"


def _found(spark, docs, items=ITEMS):
    rows = spark.createDataFrame([(k, t, "x") for k, t in docs], SHAPE)
    return {(r["doc_id"], r["item_id"]): (round(r["coverage"], 3), r["kind"]) for r in decontaminate.leaks(rows, spark.createDataFrame(items, ITEM_SHAPE)).collect()}


def test_kinds_and_slots(spark):
    docs = [
        (1, "Intro text. If Carol has 40 apples and gives Dave 7 apples, how many apples does Carol keep for 9 days? End."),
        (2, "If Carol has 40 apples and gives Dave 7 apples, how many apples does Eve keep for 9 days?"),
        (3, "x if Alice has 12 apples and gives Bob 5 apples, how many apples does Alice keep for 3 days?"),
        (3, "x if Alice has 12 apples and gives Bob 5 apples, how many apples does Alice keep for 3 days?"),
        (4, None),
        (5, ""),
        (None, "oh, we saw seven big dogs today"),
        (6, "nothing in it at all for any one, really not"),
        (7, "IF ALICE HAS 12 APPLES AND GIVES BOB 5 APPLES, HOW MANY APPLES DOES ALICE KEEP FOR 3 DAYS?"),
    ]
    got = _found(spark, docs)
    assert got[(1, 1)] == (1.0, "reparameterised") and got[(3, 1)] == (1.0, "verbatim") and got[(None, 3)] == (1.0, "reparameterised")
    assert (2, 1) not in got and len(got) <= 4
    rows = spark.createDataFrame([(k, t, "x") for k, t in docs], SHAPE)
    kept = decontaminate.drop_leaks(rows, spark.createDataFrame(ITEMS, ITEM_SHAPE))
    assert kept.columns == rows.columns and {r[0] for r in kept.collect()} >= {2, 4, 5, 6} and not {1, 3, None} & {r[0] for r in kept.collect()}


def test_plain_windows_equal_brute_force(spark):
    """Lower-case words without marks have no slots, so leaks are shared windows."""
    import random

    rng = random.Random(3)
    words = [f"x{c}" for c in "abcdefghijklmnop"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(8, 20)))) for i in range(12)]
    docs = []
    for i in range(60):
        t = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if i % 3 == 0:
            own = rng.choice(items)[1].split()
            at = rng.randrange(len(t))
            t[at:at] = own[: rng.randint(6, len(own))]
        docs.append((i, " ".join(t)))
    win = lambda t: [tuple(t[k : k + 8]) for k in range(len(t) - 7)]
    want = {}
    for d, t in docs:
        have = set(win(t.split()))
        for i, q in items:
            share = sum(w in have for w in win(q.split())) / len(win(q.split()))
            if share >= 0.5:
                want[(d, i)] = round(share, 3)
    assert {k: v[0] for k, v in _found(spark, docs, items).items()} == want


def test_edited_partial_dense_and_short_copies(spark):
    long = " ".join(f"l{c}{d}" for c in "abcdefgh" for d in "abcdefg")
    items = [
        (1, "xa xb xc xd xe xf xg xh xi xj xk xl xm xn xo"), (2, "Then " + long), (3, "12 15 18 21 24 27 30 33 36 39"), (4, "Riders cross the old bridge"),
        (5, "she had 2 apples and 2 pears in her bag"), (6, "Paul saw five dogs"),
    ]
    docs = [
        (1, "so xa xb xc xd xe xf xg zz xi xj xk xl xm xn xo end"), (2, "it says " + " ".join(long.split()[12:37]) + " and no more"), (3, "numbers 12 15 18 21 24 27 30 33 36 39 end"),
        (4, "they say Riders cross the old bridge"), (5, "she had 3 apples and 5 pears in her bag"), (6, "Yes. Mary saw nine dogs"), (7, "numbers 11 15 19 21 25 27 31 33 37 39 end"),
        (8, "so xa xb xc zz xe xf xg xh zz xj xk xl zz xn xo end"), (9, "it says " + " ".join(long.split()[12:25]) + " and no more"),
    ]
    got = _found(spark, docs, items)
    assert set(got) == {(i, i) for i in range(1, 7)}
    assert [got[(i, i)][1] for i in range(1, 7)] == ["reparameterised", "verbatim", "verbatim", "verbatim", "reparameterised", "reparameterised"]


def test_names_of_several_words(spark):
    def told(alice, bob, n=("12", "5", "3")):
        return f"If {alice} has {n[0]} apples and gives {bob} {n[1]} apples, how many apples does {alice} keep for {n[2]} days?"

    names = ["Carol", "Anna Maria", "Anna Maria Lopez", "Élise Marie"]
    docs = [(i * 10 + j, "Read this. " + told(a, b, ("twenty five", "one hundred", "9"))) for i, a in enumerate(names) for j, b in enumerate(names) if a != b]
    docs += [(90, told("Anna Maria", "Dave").replace("does Anna Maria", "does Anna Lucia")), (91, told("Anna Maria", "Dave").replace("does Anna Maria", "does Anna"))]
    got = _found(spark, docs)
    assert set(got) == {(d, 1) for d, _ in docs[:-2]} and {v for v in got.values()} == {(1.0, "reparameterised")}
    # at the opening of a sentence, and an item whose name has several words
    items = [(1, "Alice has 12 red apples in her old bag. How many apples does Alice keep at home?"), (2, "we gave Anna Maria Lopez a box with green pens and Anna Maria Lopez lost one")]
    docs = [(1, "Anna Maria has 7 red apples in her old bag. How many apples does Anna Maria keep at home?"), (2, "we gave Bob a box with green pens and Bob lost one"), (3, "so we gave Bob a box with green pens and Eve lost one")]
    assert set(_found(spark, docs, items)) == {(1, 1), (2, 2)}
    listed = [(1, "today Alice, Bob and Carol went to the big old market by bus")]
    assert set(_found(spark, [(1, "today Dan, Eve and Fay went to the big old market by bus"), (2, "today Dan Eve and Fay went to the big old market by bus")], listed)) >= {(1, 1)}


def test_rolling_hashes_equal_plain_ones():
    values = np.random.default_rng(5).integers(0, 1 << 63, 200, dtype=np.uint64)
    r = decontaminate.Rolling(values)
    with np.errstate(over="ignore"):
        for length in (1, 2, 8):
            got = r.of(3, length, 100)
            for i in range(100):
                h = np.uint64(0)
                for v in values[3 + i : 3 + i + length]:
                    h = h * decontaminate._P + v
                assert got[i] == h


def test_empty_tables(spark):
    none = spark.createDataFrame([], SHAPE)
    assert decontaminate.leaks(none, spark.createDataFrame(ITEMS, ITEM_SHAPE)).collect() == []
    assert _found(spark, [(1, "some text")], [(9, None)]) == {}
