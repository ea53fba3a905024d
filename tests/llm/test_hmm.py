import itertools
import math
import re
from collections import Counter

import numpy as np

from rolloom.llm import hmm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["the cat sat", "The cat ran on the mat", "a dog a dog a dog", None, "", "unseen words é here the", "the cat sat", "der hund und der mann", "zz top"]


def _docs(spark):
    rows = [(None if i == 8 else i, t, i not in (5, 7), "x") for i, t in enumerate(TEXTS)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, learn boolean, score string")


def _tokens(t):
    return [*WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)})), None]


def test_base_scores_equal_brute_force_at_any_bound(spark):
    rows, docs = _docs(spark)
    counts = Counter(x for _, t, learn, _ in rows if learn for x in _tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((repr(k), learn, len(_tokens(t)), sum(counts[x] > 0 for x in _tokens(t)), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in _tokens(t)), 6)) for k, t, learn, _ in rows)
    for head, base_head in ((65536, 262144), (2, 4), (1, 1)):
        got = hmm.score(docs, "learn", head=head, base_head=base_head, rounds=1, states=3).collect()
        assert sorted((repr(r["doc_id"]), r["learn"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(r["score"] < 0 for r in got)


def _model(rng, k, n):
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hmm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((n, k)), 0))


def test_forward_equals_the_sum_over_all_paths():
    rng = np.random.default_rng(1)
    m = _model(rng, 3, 5)
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 6, 2)]
    got = hmm.likelihoods(np.concatenate(seqs), np.cumsum([0, *map(len, seqs)]), m)
    for s, g in zip(seqs, got, strict=True):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            total += p
        assert math.isclose(math.log10(total), g, rel_tol=1e-9)


def test_expected_counts_equal_the_sum_over_all_paths():
    rng = np.random.default_rng(2)
    m = _model(rng, 2, 4)
    tokens = np.array([[0, 3, 1, 2], [2, 2, -1, -1]])
    state, moves, starts = hmm.expected(tokens, m)
    want_state, want_moves = np.zeros_like(state), np.zeros((2, 2))
    for i, row in enumerate(tokens):
        s = row[row >= 0]
        paths = {}
        for path in itertools.product(range(2), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            paths[path] = p
        for path, p in paths.items():
            for t, k in enumerate(path):
                want_state[i, t, k] += p / sum(paths.values())
                if t:
                    want_moves[path[t - 1], k] += p / sum(paths.values())
    assert np.allclose(state, want_state) and np.allclose(moves, want_moves) and np.allclose(starts, want_state[:, 0].sum(0))


def test_no_training_rows_and_empty_table(spark):
    _, docs = _docs(spark)
    got = hmm.score(docs.selectExpr("doc_id", "text", "false AS learn"), "learn", rounds=1).collect()
    assert len(got) == len(TEXTS) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in got)
    assert hmm.score(docs.limit(0), "learn", rounds=1).collect() == []
