import re
from collections import Counter

import numpy as np

from rolloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n", "a b\na b\n\n \r\na b\x85c", "\n\n", "a b\r\na b\r\nx", "x y z x y z x", "é#é *\n" * 3, "w " * 60, "dup", "dup", "a b c\na b c"]


def _brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup, marked = set(), 0, set()
    counts = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    for i in range(len(w) - 2):
        if counts[tuple(w[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def _docs(spark):
    good = [(100 + i, " ".join(f"w{i}x{j}" for j in range(60 + i)), 1) for i in range(60)]
    bad = [(200 + i, " ".join(f"w{i}x{j}" + "#" * (j % 2) for j in range(60 + i)), 0) for i in range(60)]
    rows = [(None if i == 3 else i, t) for i, t in enumerate(TEXTS)] + [(k, t) for k, t, _ in good + bad]
    labels = [(k, q, 0) for k, _, q in good + bad if k % 5] + [(None, 1, 0), (100, None, 0), (101, 1, 0), (101, 1, 0), (999, 0, 0)]
    return rows, spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, kept string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_counts_rules_and_verdicts(spark):
    rows, docs, labels = _docs(spark)
    found, rules = quality.judged(docs, labels)
    got = found.collect()
    names = list(quality.COUNTS)
    assert sorted((repr(r["doc_id"]), *[r[n] for n in names]) for r in got) == sorted((repr(k), *_brute(t)) for k, t in rows)
    for r in got:
        base = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == base and not (base and r["kept"])
        if r["doc_id"] and r["doc_id"] >= 100:
            assert r["kept"] == (r["doc_id"] < 200)
    assert rules and all(len(r) <= quality.CONDITIONS for r in rules)


def test_without_labels_the_base_rule_decides(spark):
    _, docs, labels = _docs(spark)
    found, rules = quality.judged(docs, labels.limit(0))
    assert rules == [] and all(r["kept"] != r["base_failed"] for r in found.collect())
    assert quality.judged(docs.limit(0), labels)[0].collect() == []


def test_list_keeps_its_order_and_covers_two_kinds():
    rng = np.random.default_rng(2)
    a, b = rng.random(600), rng.random(600)
    bad = (a > 0.8) | ((b < 0.2) & (a > 0.5))
    rules = quality.learn({"a": a, "b": b}, bad)
    hit = np.zeros(600, bool)
    for r in rules:
        hit |= quality._covers(r, {"a": a, "b": b}, 600)
    assert (hit == bad).mean() > 0.97 and len(rules) >= 2


def test_a_repeated_key_adds_no_more_than_the_bound(spark):
    rows = [(1, i % 2 == 0, float(i)) for i in range(3000)] + [(2, True, 1.0)] * 3000
    found = spark.createDataFrame(rows, "_key long, bad boolean, x double")
    assert quality.examples(found, ["x"], 20).count() == 20 and quality.examples(found, ["x"], 10_000).count() == 3001
