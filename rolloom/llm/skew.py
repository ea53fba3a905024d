"""Joins that stay even when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hot keys are fewer than this; the rows of any other key are at most one in as many.
HOT_KEYS = 1 << 14


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Inner join of ``rows`` with a table that has one row per key and its number of rows.

    Keys with more than ``1 / hot_keys`` of all rows are fewer than ``hot_keys``, whatever the
    data, so their part of the table is broadcast and their rows are not shuffled. All other
    keys are joined by a shuffle in which none holds more than that share.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) > int(total) // hot_keys
    hot, cold = table.where(is_hot), table.where(~is_hot)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return near.unionByName(far)
