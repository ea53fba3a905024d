"""Ordered per-key computations that survive a hot key.

A plain ``Window.partitionBy(key).orderBy(pos)`` sorts a whole key in one task. Here each
key is cut into chunks of consecutive positions, spread over tasks; only one summary row
per chunk travels to the second, per-key window, and its result is joined back by
``(key, chunk)``. The same steps run at every size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rolloom.session import checkpointed

Order = str | Column | Sequence[str | Column]

#: Consecutive positions handled by one task-local window.
CHUNK_ROWS = 65_536


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    *,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add running sums and last non-null values per key, inclusive of the current row.

    ``pos`` is an integer position, unique within the key.
    """
    return running_in(df, keys, [pos], F.floor(F.col(pos) / chunk_rows), sums=sums, lasts=lasts)


def _running(df, keys, order, sums, lasts):
    inputs = {f"_in_{n}": c for n, c in {**sums, **lasts}.items()}
    base = df.withColumns(inputs) if inputs else df
    local = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)

    totals = [F.sum(f"_in_{n}").alias(f"_c_{n}") for n in sums]
    newest = [
        F.max_by(F.struct(F.col(f"_in_{n}").alias("v")), F.when(F.col(f"_in_{n}").isNotNull(), F.struct(*order))).alias(f"_c_{n}")
        for n in lasts
    ]
    summary = base.groupBy(*keys, "_chunk").agg(*totals, *newest)
    carry = summary.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_chunk").alias("_k_chunk"),
        *[F.sum(f"_c_{n}").over(before).alias(f"_p_{n}") for n in sums],
        *[F.last(f"_c_{n}", ignorenulls=True).over(before).alias(f"_p_{n}") for n in lasts],
    )
    same = F.col("_chunk") == F.col("_k_chunk")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = base.join(carry, same, "left")
    out = {n: F.coalesce(F.sum(f"_in_{n}").over(local), F.lit(0)) + F.coalesce(F.col(f"_p_{n}"), F.lit(0)) for n in sums}
    out |= {n: F.coalesce(F.last(f"_in_{n}", ignorenulls=True).over(local), F.col(f"_p_{n}.v")) for n in lasts}
    return joined.withColumns(out).drop(*inputs, *[f"_k_{k}" for k in keys], "_k_chunk", *[f"_p_{n}" for n in {**sums, **lasts}])


def _parts(df: DataFrame, buckets: int | None) -> int:
    return buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _listed(order: Order) -> list[str | Column]:
    return [order] if isinstance(order, str | Column) else list(order)


def ranges(df: DataFrame, order: Order, name: str, buckets: int | None = None) -> DataFrame:
    """Add the number of the range of ``order`` that a row falls in, rising along it.

    ``order`` is one column or several of any types; as many ranges as shuffle partitions are
    cut at sampled rows, so they hold about equally many whatever the distribution is. With a
    tie-break among the columns, a value that a third of all rows share is cut as well. The
    rows are written once: ranges drawn anew would differ.
    """
    ranged = df.repartitionByRange(_parts(df, buckets), *_listed(order))
    return checkpointed(ranged.withColumn(name, F.spark_partition_id()), "ranges")


def running_in(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    *,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Like :func:`running` for any order; ``bucket`` must not decrease along ``order``.

    A bucket bounds how many rows of a hot key one task sorts.
    """
    return _running(df.withColumn("_chunk", bucket), keys, list(order), sums or {}, lasts or {}).drop("_chunk")


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "rn") -> DataFrame:
    """1-based row number per key by ``order``; ``bucket`` as in :func:`running_in`."""
    return running_in(df, keys, order, bucket, sums={name: F.lit(1)})


def number_rows(df: DataFrame, order: Order, name: str = "rn", buckets: int | None = None) -> DataFrame:
    """1-based global row number by one column or several, of any types; rows equal in all are in any order.

    Rows are dealt by range and sorted, and written with their place in their range; the sizes
    of the ranges, one row each, are summed up and broadcast.
    """
    by = _listed(order)
    dealt = df.repartitionByRange(_parts(df, buckets), *by).sortWithinPartitions(*by)
    placed = checkpointed(dealt.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    # the upper bits of the id are the range, the lower ones the place in it
    placed = placed.withColumns({"_range": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_range").alias("_s"), before.alias("_before"))
    numbered = placed.join(F.broadcast(starts), F.col("_range") == F.col("_s"))
    return numbered.withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_id", "_range", "_place", "_s", "_before")
