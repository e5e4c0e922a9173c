"""Placemark tables: selectors, orderings, profiles and lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.functions import text
from galeframe.operators.ordered import position, with_ordered


def with_role(marks: DataFrame) -> DataFrame:
    """Add ``role``: what a placemark stands for, by folder, geometry and style."""
    folder, kind, style = F.col("folder"), F.col("geometry"), F.col("style")
    # Folder names and style ids of warning files.
    return marks.withColumn(
        "role",
        F.when((folder == "Forecast") & (kind == "Point"), "forecast_point")
        .when((folder == "Previous Best Track Posits") & (kind == "Point"), "best_point")
        .when((folder == "Forecast") & (kind == "LineString"), "forecast_line")
        .when((kind == "LineString") & (style == "#BestTrack"), "best_line")
        .when((kind == "Polygon") & (style == "#WindRadii34"), "radius_34")
        .when((kind == "Polygon") & (style == "#WindRadii50"), "radius_50")
        .when((kind == "Polygon") & (style == "#msn_ylw-pushpin"), "danger_swath"),
    )


def with_warning_values(marks: DataFrame) -> DataFrame:
    """Add tau, wind and best-track time from the table and the name."""
    field = lambda k: F.try_element_at(F.col("table"), F.lit(k))
    return marks.withColumns(
        {
            "tau": text.tau_hours(field("TIME")),
            "wind_kt": text.wind_knots(field("WIND SPD")),
            "best_time": text.best_track_time(F.col("name")),
        }
    )


def forecast_order(points: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Add ``pos``: by tau (none counts as 9999), then name, then document order."""
    ranked = points.withColumn("_tau", F.coalesce("tau", F.lit(9999)))
    return with_ordered(ranked, keys, ["_tau", "name", "seq"], {"pos": position()}).drop("_tau")


def best_track_order(points: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Add ``pos``: by parsed time, unreadable names last, then document order."""
    far = F.lit("9999-12-31 00:00:00").cast("timestamp")
    ranked = points.withColumn("_t", F.coalesce("best_time", far))
    return with_ordered(
        ranked, keys, ["_t", "seq"], {"pos": position()}, F.unix_micros("_t")
    ).drop("_t")


def count_by(marks: DataFrame, attribute: str, blank: str | None = None, top: int | None = None) -> DataFrame:
    """Placemarks per value; blanks are named ``blank`` or left out.

    With ``top``, the most frequent values, earlier first occurrence first on ties.
    """
    named = F.nullif(F.trim(attribute), F.lit(""))
    value = F.coalesce(named, F.lit(blank)) if blank is not None else named
    counted = (
        marks.withColumn("value", value).filter(F.col("value").isNotNull()).groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "seq")).alias("_first"))
    )
    if top is not None:
        counted = counted.orderBy(F.desc("n"), F.asc("_first")).limit(top)
    return counted.select("value", "n")


def field_profile(marks: DataFrame, shown: int = 3) -> DataFrame:
    """Per table key: occurrences, distinct values, the first few and how many more.

    Values are counted as rows; only the first ``shown`` of a key are put together.
    """
    values = marks.select(F.explode("table").alias("key", "value")).groupBy("key", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = values.groupBy("key").agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("n_values")
    )
    first = smallest(values, "key", "value", shown)
    return totals.join(first, "key").select(
        "key", "occurrences", "n_values",
        F.concat(
            F.array_join("_least", ", "),
            F.when(F.col("n_values") > shown, F.format_string(" ...(+%d)", F.col("n_values") - shown)).otherwise(""),
        ).alias("preview"),
    )


def smallest(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """``_least``: the n smallest distinct values per key.

    Repeated minimum: each round is a combining aggregate, so a key with very many
    values never sits in one task.
    """
    least = rows.groupBy(key).agg(F.array(F.min(value)).alias("_least"))
    for _ in range(n - 1):
        above = rows.join(least, key).filter(F.col(value) > F.element_at("_least", -1))
        more = above.groupBy(key).agg(F.min(value).alias("_next"))
        least = least.join(more, key, "left").select(
            key,
            F.when(F.col("_next").isNull(), F.col("_least"))
            .otherwise(F.concat("_least", F.array("_next")))
            .alias("_least"),
        )
    return least


def track_line(lines: DataFrame, points: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Line of each document as rows: its first line, else its points if two or more.

    ``lines`` have ``seq`` and ``coords``; ``points`` have ``pos``, ``lat`` and ``lon``.
    """
    keys = list(keys)
    given = lines.groupBy(*keys).agg(F.min_by("coords", "seq").alias("coords"))
    drawn = given.select(*keys, F.posexplode("coords").alias("pos", "c")).select(
        *keys, (F.col("pos") + 1).cast("long").alias("pos"), "c.lat", "c.lon"
    )
    many = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2)
    usable = many.join(given.select(*keys), keys, "left_anti").select(*keys)
    return drawn.unionByName(
        points.join(usable, keys, "left_semi").select(*keys, "pos", "lat", "lon")
    )


def all_coordinates(marks: DataFrame) -> DataFrame:
    """Every coordinate of every placemark, for bounding boxes."""
    return marks.select("doc_id", F.explode("coords").alias("c")).select("doc_id", "c.lat", "c.lon")
