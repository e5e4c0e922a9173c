"""Bulletin feeds: selection, ranking and the first readable bulletin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.functions import classify


def bulletin_entries(entries: DataFrame, title: str | None = None) -> DataFrame:
    """Entries with a storm bulletin code, scored; ``title`` must occur if given."""
    kept = entries.filter(classify.is_bulletin(F.col("id"), F.col("link")))
    if title is not None:
        kept = kept.filter(F.col("title").contains(title))
    return kept.withColumn("score", classify.feed_score(F.col("id"), F.col("link")))


def ranked_entries(entries: DataFrame) -> DataFrame:
    """Best score first, then latest update."""
    return bulletin_entries(entries).orderBy(F.desc("score"), F.desc("updated"), F.asc("id"))


def first_readable(entries: DataFrame, points: DataFrame) -> DataFrame:
    """The best-ranked entry whose bulletin gave at least one point."""
    readable = points.groupBy("id").agg(F.count(F.lit(1)).alias("n_points"))
    return (
        bulletin_entries(entries).join(readable, "id")
        .orderBy(F.desc("score"), F.desc("updated"), F.asc("id")).limit(1)
    )
