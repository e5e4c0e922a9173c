"""Joining per-key results back to the rows they describe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.session import checkpointed

# Rows of a side that is broadcast once its size is known.
BROADCAST_ROWS = 50_000


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Add the columns of ``stats`` (one row per key) to ``df``.

    No broadcast is forced: the number of keys grows with the data, so the choice
    is left to Spark's size check, and a skewed key is split by adaptive execution.
    Without keys ``stats`` is a single row and is read as a scalar subquery.
    """
    keys = list(keys)
    if keys:
        return df.join(stats, keys, how)
    row = stats.select(F.struct(*stats.columns).alias("_row")).scalar()
    return (
        df.withColumn("_stats", row)
        .select(*df.columns, *[F.col(f"_stats.{c}").alias(c) for c in stats.columns])
    )


def attach_counted(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``attach`` for a side with one row per frame, field or axis value.

    The side is computed once and kept, and its rows are counted; up to
    ``galeframe.broadcast.rows`` of them are broadcast, so that cells are not shuffled to
    meet a few thousand rows. Beyond that Spark joins as it finds best.
    """
    keys = list(keys)
    if not keys:
        return attach(df, stats, keys, how)
    most = int(df.sparkSession.conf.get("galeframe.broadcast.rows", str(BROADCAST_ROWS)))
    side = checkpointed(stats)
    return df.join(F.broadcast(side) if side.count() <= most else side, keys, how)
