import math
from fractions import Fraction

import numpy as np
import pytest

from rolloom.llm import queries, whitening


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * np.array(values, float)) @ q.T


CASES = {
    "random": symmetric(np.linspace(50, 1, 40) ** 1.5),
    "wide range": symmetric(10.0 ** -np.arange(30)),
    "one repeated value": symmetric([9.0] * 12 + [4.0] * 5 + [1.0] * 9),
    "close values": symmetric(1 + 1e-9 * np.arange(35)),
    "diagonal": np.diag(np.array([3.0, 7.0, 7.0, 1.0, 0.5])),
    "split": np.kron(np.eye(4), symmetric([5.0, 2.0, 1.0], 3)),
    "identity": np.eye(33),
    "rank two": symmetric([8.0, 3.0, 0, 0, 0, 0, 0]),
    "tiny": symmetric([3e-200, 1e-200, 5e-201]),
    "huge": symmetric([3e200, 1e200, 5e199]),
    "single": np.array([[2.5]]),
    "pair": np.array([[2.0, -1.0], [-1.0, 2.0]]),
}


@pytest.mark.parametrize("name", CASES)
def test_leading_eigenpairs(name):
    m = CASES[name]
    m = (m + m.T) / 2
    values, vectors = whitening.leading_eigenpairs(m, 32)
    want = np.linalg.eigvalsh(m)[::-1]
    assert len(values) == min(32, int((want > 16 * len(m) * whitening._EPS * want[0]).sum()))
    assert np.abs(values - want[: len(values)]).max() <= 1e-13 * want[0]
    assert np.abs(m @ vectors - vectors * values).max() <= 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 1e-11


def test_no_variance_has_no_components():
    assert whitening.leading_eigenpairs(np.zeros((3, 3)), 2)[1].shape == (3, 0)


def test_sturm_counts_equal_sorted_values():
    d, e, _ = whitening.tridiagonal(CASES["random"])
    want = np.linalg.eigvalsh(CASES["random"])
    at = np.concatenate([want + 1e-6, want - 1e-6, [-1e9, 1e9]])
    assert (whitening.sturm_counts(d, e, at) == np.searchsorted(want, at)).all()


def brute(vectors, k):
    """The contract in exact sums and a library eigensolver."""
    kept = {i: [math.floor(Fraction(c) * 64) + 1_000_000 for c in v] for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    n = len(kept)
    sums = [sum(col) for col in zip(*kept.values(), strict=True)]
    centred = {i: [float(Fraction(n * x - s, n)) for x, s in zip(row, sums, strict=True)] for i, row in kept.items()}
    m = np.array(list(centred.values()))
    cov = m.T @ m / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    deviation = {i: sum((n * x - s) ** 2 for x, s in zip(row, sums, strict=True)) for i, row in kept.items()}
    return n, deviation, {i: np.array(c) @ basis / np.sqrt(values) for i, c in centred.items()}, values / np.trace(cov)


def test_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(40, 40)) * 0.1
    rows = [(i, (rng.normal(size=40) @ mix).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300, None), (301, rows[0][1][:39] + [None]), (302, rows[0][1][:39] + [math.nan]), (303, rows[0][1][:39] + [-math.inf]), (304, rows[5][1])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("component", whitening.F.lit("x")).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_whitening(spark, str(tmp_path)).collect()
    n, deviation, whitened, explained = brute(rows, 32)
    assert {r["vec_id"] for r in got} == set(whitened) and len(got) == 32 * n
    signs = {}
    for r in sorted(got, key=lambda r: -abs(r["whitened"])):
        k, want = r["component"] - 1, whitened[r["vec_id"]]
        sign = signs.setdefault(k, 1 if r["whitened"] * want[k] > 0 else -1)
        assert abs(sign * r["whitened"] - want[k]) < 1e-8
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]]
        assert abs(r["explained"] / explained[k] - 1) < 1e-10 and r["identity_error"] < 1e-9


def test_lengths_empty_vectors_ties_and_clashing_columns(spark):
    rows = [(1, [1.0, 2.0], "a"), (2, [3.0, 1.0], "b"), (2, [3.0, 1.0], "b"), (None, [0.0, 5.0], None), (4, [1.0], "c"), (5, [], "d"), (6, [1e300, 0.0], "e")]
    df = spark.createDataFrame(rows, "id long, v array<double>, whitened string")
    model = whitening.fit(df, "v")
    assert (model.n, len(model.values)) == (4, 2)
    got = whitening.transform(df, model, ["id", "whitened"], "v", whitened="w").collect()
    assert sorted((r["id"] or 0) for r in got) == [0, 1, 2, 2] and all(len(r["w"]) == 2 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.5])], [(1, [0.5, 0.5])] * 7])
def test_tables_without_variance_give_no_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op12_whitening(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("n", [10, 10**6, 10**9, 10**12])
def test_large_sums_stay_exact(n):
    d = np.array([[2**40, -(2**41)], [3, 4]])
    rest = np.array([5, 7])
    want = [sum((n * int(v) - int(r)) ** 2 for v, r in zip(row, rest, strict=True)) for row in d]
    assert whitening._deviations(d, rest, n).to_pylist() == [w if w < 10**38 else None for w in want]
    small = d % 50
    assert whitening._deviations(small, rest, n).to_pylist() == [sum((n * int(v) - int(r)) ** 2 for v, r in zip(row, rest, strict=True)) for row in small]
