"""Whitening of embedding vectors onto their leading principal components.

Entries become integers, ``x = floor(scale * c) + shift``, so that counts and sums are exact
and the same under any partitioning. Two passes over the vectors give the sums and the centred
covariance: every task adds its own rows, and the partial sums are added by a shuffle whose
size depends on the width of the vectors alone, as does what reaches the driver. There the
covariance is brought to tridiagonal form by Householder reflections, the leading eigenvalues
are bisected with Sturm counts, and inverse iteration finds their vectors; vectors of close
eigenvalues are orthogonalised against each other. The basis is broadcast (width times
components) and every vector is projected where it lies.

Left out are rows whose vector is null, holds a null or non-finite entry or one whose integer
is beyond 2**53, and rows of another length than the most frequent one (the longer of equally
frequent). Components whose eigenvalue is zero to working precision cannot be scaled to unit
variance and are not returned: with equal vectors only, or a single one, there is none.
Repeated rows count each time; an empty table gives a model without components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from rolloom.session import checkpointed

SCALE, SHIFT = 64, 1_000_000
#: Widest vectors whose covariance the driver solves.
MOST_DIMENSIONS = 8192
#: Rows of a vector batch that are multiplied at once, in entries.
BLOCK_ENTRIES = 1 << 21
#: Low bits of an integer that are summed apart from the high ones.
_LOW = 26
_EPS = np.finfo(float).eps


@dataclass
class Whitening:
    """Exact sums, and the leading eigenvalues and unit eigenvectors (columns) of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]

    def centre(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each dimension the mean's whole part, its remainder times n, and its fraction."""
        whole = [s // self.n for s in self.sums]
        rest = [s - w * self.n for s, w in zip(self.sums, whole, strict=True)]
        return np.array(whole, np.int64), np.array(rest, np.int64), np.array([r / self.n for r in rest])


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and integer vectors of a list column, by vector length; unusable rows are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)
    length = np.diff(at)
    length[column.is_null().to_numpy(zero_copy_only=False)] = 0
    for size in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == size)
        step = max(1, BLOCK_ENTRIES // int(size))
        for i in range(0, len(rows), step):
            own = rows[i : i + step]
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(SCALE * flat[at[own][:, None] + np.arange(size)])
                good = (np.abs(x) < float(1 << 53)).all(axis=1)
            yield own[good], x[good].astype(np.int64) + SHIFT


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.select(F.col(vector).cast("array<double>").alias("v"))


def _sums(df: DataFrame, vector: str) -> tuple[int, list[int]]:
    """Number and exact sums of the usable vectors of the most frequent length."""

    def run(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                own = total.setdefault(x.shape[1], [0, 0, 0])
                own[0] += len(x)
                own[1] = own[1] + (x >> _LOW).sum(axis=0)
                own[2] = own[2] + (x & ((1 << _LOW) - 1)).sum(axis=0)
        for size, (n, high, low) in total.items():
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, size)), pa.array(np.arange(size)), pa.array(np.full(size, n)), pa.array(high), pa.array(low)], ["size", "i", "n", "high", "low"])

    parts = _vectors(df, vector).mapInArrow(run, "size long, i long, n long, high long, low long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    total = checkpointed(parts.groupBy("size", "i").agg(F.sum("n").alias("n"), *exact), "sums")
    most = total.where("i = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return 0, []
    if most["size"] > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {most['size']} dimensions; at most {MOST_DIMENSIONS} are supported")
    rows = total.where(F.col("size") == most["size"]).orderBy("i").collect()
    return most["n"], [(int(r["high"]) << _LOW) + int(r["low"]) for r in rows]


def _moments(df: DataFrame, vector: str, rows, width: int) -> np.ndarray:
    """Sum of outer products of what ``rows`` makes of the usable vectors, one row each."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                y = rows(x)
                total += y.T @ y
        step = max(1, BLOCK_ENTRIES // width)
        for i in range(0, width, step):
            a, b = np.triu_indices(min(step, width - i), i, width)
            yield pa.RecordBatch.from_arrays([pa.array(a + i), pa.array(b), pa.array(total[a + i, b])], ["a", "b", "s"])

    parts = _vectors(df, vector).mapInArrow(run, "a long, b long, s double")
    sums = parts.groupBy("a", "b").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros((width, width))
    a, b, s = (sums.column(c).to_numpy() for c in ("a", "b", "s"))
    out[a, b] = out[b, a] = s
    return out


def _centred(model: Whitening):
    """Centred vectors of integer ones; rows of another length have none."""
    whole, _, fraction = model.centre()
    return lambda x: (x - whole) - fraction if x.shape[1] == len(whole) else np.zeros((0, len(whole)))


def fit(df: DataFrame, vector: str = "embedding", components: int = 32) -> Whitening:
    """Sums, covariance and leading components of all usable vectors."""
    n, sums = _sums(df, vector)
    model = Whitening(n, sums, np.zeros(0), np.zeros((len(sums), 0)), 0.0)
    if n:
        covariance = _moments(df, vector, _centred(model), len(sums)) / n
        model.trace = float(np.trace(covariance))
        model.values, model.vectors = leading_eigenpairs(covariance, components)
    return model


def _projection(model: Whitening):
    centred, basis = _centred(model), model.vectors / np.sqrt(model.values)
    return lambda x: centred(x) @ basis


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened vectors, measured on them, minus the identity."""
    k = len(model.values)
    if not k:
        return 0.0
    project = _projection(model)
    # a column of ones carries the sums
    total = _moments(df, vector, lambda x: np.pad(project(x), ((0, 0), (0, 1)), constant_values=1.0), k + 1)
    mean = total[:k, k] / model.n
    return float(np.abs(total[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(d: np.ndarray, rest: np.ndarray, n: int) -> pa.Array:
    """Exact sums over dimensions of ``(n * d - rest) ** 2``; null beyond 38 digits."""
    kind = pa.decimal128(38, 0)
    most, width = float(np.abs(d).max(initial=0) + 1), max(1, d.shape[1])
    if (most * n) ** 2 * width < 2**62:
        t = n * d - rest
        return pa.array((t * t).sum(axis=1)).cast(kind)
    if most * max(most, n) * width >= 2**62:
        d, rest = d.astype(object), rest.astype(object)
    last = sum(int(r) ** 2 for r in rest)
    exact = [n * n * int(a) - 2 * n * int(b) + last for a, b in zip((d * d).sum(axis=1), d @ rest, strict=True)]
    return pa.array([Decimal(s) if s < 10**38 else None for s in exact], kind)


def transform(df: DataFrame, model: Whitening, keep: list[str], vector: str = "embedding", whitened: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """Columns ``keep`` of every usable row, its ``deviation`` decimal(38,0) and ``whitened`` array<double>."""
    project = _projection(model)
    whole, rest, _ = model.centre() if model.n else (np.zeros(0, np.int64),) * 3
    n, k = model.n, len(model.values)
    names = [f"k{i}" for i in range(len(keep))]
    inner = StructType([StructField(a, df.schema[c].dataType, True) for a, c in zip(names, keep, strict=True)])
    types = [to_arrow_type(f.dataType) for f in inner.fields]
    inner = StructType([*inner.fields, *StructType.fromDDL("d decimal(38,0), w array<double>").fields])

    def run(batches):
        for batch in batches:
            for rows, x in _matrices(batch.column(len(names))):
                if x.shape[1] != len(whole) or not len(rows):
                    continue
                own = [batch.column(i).take(pa.array(rows)).cast(t) for i, t in enumerate(types)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * k, pa.int32()), pa.array(project(x).ravel()))
                yield pa.RecordBatch.from_arrays([*own, _deviations(x - whole, rest, n), lists], inner.names)

    rows = df.select(*[F.col(c).alias(a) for c, a in zip(keep, names, strict=True)], F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, inner).toDF(*keep, deviation, whitened)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of a symmetric matrix under Householder reflections, and their unit vectors."""
    a = np.array(matrix, float)
    n = len(a)
    mirrors = []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0 or not v[1:].any():
            mirrors.append(np.zeros(n - k - 1))
            continue
        to = -np.copysign(size, v[0])
        v[0] -= to
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        w = rest @ v
        w -= v * (v @ w)
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = to
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of eigenvalues of a tridiagonal matrix below each value."""
    square = np.concatenate([[0.0], off**2])
    least = np.finfo(float).tiny * max(1.0, square.max())
    q = np.ones(len(at))
    below = np.zeros(len(at), np.int64)
    for d, s in zip(diagonal, square, strict=True):
        q = d - at - s / q
        q[np.abs(q) < least] = -least
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, bisected until their bounds are neighbours in precision."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([off, [0.0]])) + np.abs(np.concatenate([[0.0], off]))
    low, high = (diagonal - reach).min(), (diagonal + reach).max()
    pad = 4 * _EPS * max(abs(low), abs(high)) * n
    low, high = np.full(k, low - pad), np.full(k, high + pad)
    wanted = n - np.arange(k)  # that many eigenvalues are not above
    while True:
        middle = (low + high) / 2
        if ((high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high))) | (middle <= low) | (middle >= high)).all():
            return middle
        above = sturm_counts(diagonal, off, middle) < wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def _solved(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Solutions of ``(T - at[j]) x = right[:, j]`` by elimination with row exchanges, all columns at once."""
    n, k = right.shape
    up = np.zeros((3, n, k))
    b = right.copy()
    own = np.stack([diagonal[0] - at, np.full(k, off[0] if n > 1 else 0.0), np.zeros(k)])
    for i in range(n - 1):
        under = np.stack([np.full(k, off[i]), diagonal[i + 1] - at, np.full(k, off[i + 1] if i + 2 < n else 0.0)])
        swap = np.abs(under[0]) > np.abs(own[0])
        top, other = np.where(swap, under, own), np.where(swap, own, under)
        head, tail = np.where(swap, b[i + 1], b[i]), np.where(swap, b[i], b[i + 1])
        pivot = np.where(np.abs(top[0]) < least, least, top[0])
        times = other[0] / pivot
        up[:, i] = np.stack([pivot, top[1], top[2]])
        own = np.stack([other[1] - times * top[1], other[2] - times * top[2], np.zeros(k)])
        b[i], b[i + 1] = head, tail - times * head
    up[0, n - 1] = np.where(np.abs(own[0]) < least, least, own[0])
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            b[i] -= up[1, i] * b[i + 1]
        if i + 2 < n:
            b[i] -= up[2, i] * b[i + 2]
        b[i] /= up[0, i]
        large = np.abs(b[i]) > 1e150
        if large.any():
            b[:, large] *= 1e-150
    return b / np.linalg.norm(b, axis=0)


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Unit eigenvectors (columns) of falling eigenvalues of a tridiagonal matrix.

    Values within a thousandth of the norm of their neighbour form a cluster; its vectors are
    orthogonalised in order, twice, after every round. Equal values are moved apart by a few
    units of precision, so that their solutions differ.
    """
    n, k = len(diagonal), len(values)
    norm = max(np.abs(diagonal).max(), np.abs(off).max() if len(off) else 0.0, np.finfo(float).tiny)
    at = values.copy()
    for j in range(1, k):
        at[j] = min(at[j], at[j - 1] - 8 * _EPS * norm)
    cluster = np.concatenate([[0], np.cumsum(values[:-1] - values[1:] > 1e-3 * norm)])
    x = np.random.default_rng(7).uniform(0.5, 1.0, (n, k)) * np.where(np.random.default_rng(8).random((n, k)) < 0.5, -1, 1)
    for _ in range(rounds):
        x = _solved(diagonal, off, at, x, _EPS * norm)
        for j in range(k):
            near = x[:, :j][:, cluster[:j] == cluster[j]]
            for _ in range(2):
                x[:, j] -= near @ (near.T @ x[:, j])
                x[:, j] /= np.linalg.norm(x[:, j])
    return x


def leading_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues that are positive to working precision, at most ``k``, falling, and unit eigenvectors.

    Of each vector the entry of largest size is positive.
    """
    size = float(np.abs(matrix).max()) if matrix.size else 0.0
    if size == 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, off, mirrors = tridiagonal(matrix / size)
    values = leading_values(diagonal, off, min(k, len(matrix)))
    values = values[values > 16 * len(matrix) * _EPS * values[0]]
    vectors = inverse_iteration(diagonal, off, values)
    for i in range(len(mirrors) - 1, -1, -1):
        v = mirrors[i]
        vectors[i + 1 :] -= 2 * np.outer(v, v @ vectors[i + 1 :])
    top = np.abs(vectors).argmax(axis=0)
    return values * size, vectors * np.sign(vectors[top, np.arange(len(values))])
