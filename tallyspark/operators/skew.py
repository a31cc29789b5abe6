"""Joins of rows with one-row-per-key summaries that survive keys holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least total / HOT_KEYS rows is hot; so there are at most HOT_KEYS hot keys, whatever the data.
HOT_KEYS = 1_000


def join_summaries(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per key, with its number of rows in ``size``).

    Hot keys meet their rows without a shuffle: their summaries, at most HOT_KEYS of them by the
    definition above, are broadcast, and their rows stay where they are. All other keys join by a shuffle
    in which no key has more than a thousandth of the rows. ``groups`` is read twice: pass a written or
    checkpointed frame. The result has the columns of ``rows`` and the other columns of ``groups`` but ``size``.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first().n
    bound = max(2, -(-total // HOT_KEYS))
    hot = groups.where(F.col(size) >= bound).drop(size)
    cold = groups.where(F.col(size) < bound).drop(size)
    if hot.isEmpty():
        return rows.join(cold, keys)
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return near.unionByName(far)


#: A frame of at most so many rows of a few numbers (a few MB) is broadcast by ``without``.
SMALL_ROWS = 100_000


def without(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Anti-join of ``rows`` with a checkpointed frame of ``keys``: without a shuffle of ``rows`` if the keys
    are counted to be few, by a shuffle otherwise."""
    few = keys.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return rows.join(F.broadcast(keys.select(*on)) if few else keys.select(*on), on, "left_anti")
