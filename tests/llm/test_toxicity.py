import random

import numpy as np

from rolloom.llm import toxicity


def _tables(spark):
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        text = [rng.choice(plain) for _ in range(20)]
        if bad:
            text[5] = "Vileword" + rng.choice(["s", "ish", "er"]) + "!"
        if i % 4 == 0 or bad and i % 2:
            text[7] = rng.choice(["muslims", "women", "gay"])
        rows.append((i, " ".join(text), "x"))
        labels.append((i, 1, int(bad)))
    rows += [(900, None, "x"), (901, "", "x"), (None, "vilewords here", "x"), (902, "the muslims came", "x"), (902, "the muslims came", "x"), (903, "they came", "x")]
    labels += [(None, 1, 1), (900, 1, None), (0, 1, 1), (950, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores_and_edges(spark):
    docs, labels = _tables(spark)
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model, ["doc_id"]).collect()
    by = {}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert len(got) == 306 and all(by[i][0] > 0.5 for i in range(0, 300, 3)) and all(by[i][0] < 0.5 for i in range(300) if i % 3)
    assert by[900] == by[901] and by[None][0] > 0.5 and by[902][0] == by[902][1] < 0.5


def test_swaps_lower_the_change_for_identity_terms():
    x = np.array([0, 1, 0, 2, 2, 1])
    bounds = np.array([0, 2, 3, 4, 5, 6])
    y = np.array([1, 1, 0, 0, 0], float)
    swaps = [(np.array([2]), np.array([1]))]
    with_swaps, _ = toxicity._fit(x, bounds, y, swaps, 3)
    without, _ = toxicity._fit(x, bounds, y, [], 3)
    assert abs(with_swaps[2] - with_swaps[1]) < abs(without[2] - without[1])


def test_no_labels_and_empty_table(spark):
    docs, labels = _tables(spark)
    model = toxicity.train(docs, labels.limit(0))
    assert {tuple(r)[1:] for r in toxicity.score(docs, model, ["doc_id"]).collect()} == {(0.0, 0)}
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).collect() == []


def test_a_repeated_key_adds_no_more_than_the_bound(spark):
    rows = [(1, f"you are a fool {i}") for i in range(3000)] + [(2, "kind words")] * 3000 + [(i, f"plain {i}") for i in range(3, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] + [(i, 0) for i in range(2, 60)], "doc_id long, toxic int")
    got = toxicity.labelled(docs, labels, "doc_id", "text", "toxic", 10, 200).collect()
    assert sum(r["y"] for r in got) == 10 and sum(r["id"] == 2 for r in got) <= 1 and len(got) <= 10 + 58
    assert sorted(map(str, got)) == sorted(map(str, toxicity.labelled(docs.repartition(7), labels, "doc_id", "text", "toxic", 10, 200).collect()))
