"""Joins in which no key meets in one task, however many rows it has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.llm.durable import durable, is_durable

#: A key of more than one in this many rows is hot.
HOT_KEYS = 1 << 14


def with_hot(rows: DataFrame, stats: DataFrame, key: str, total: int, least: int) -> DataFrame:
    """``rows`` joined with ``stats(key, n, ...)``, where ``n`` is the number of rows of the key among ``total``.

    Keys of more than one in ``HOT_KEYS`` of all rows, and of ``least`` rows at
    least, are fewer than ``HOT_KEYS``, so they are broadcast and their rows
    stay where they are; the others are shuffled.
    """
    hot = F.col("n") > max(least, total // HOT_KEYS)
    stats = stats if is_durable(stats) else durable(stats, "stats")
    few = stats.where(hot)
    if few.isEmpty():
        return rows.join(stats.hint("merge"), key)
    cold = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(cold.join(stats.where(~hot).hint("merge"), key))
