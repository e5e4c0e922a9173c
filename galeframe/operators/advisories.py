"""Advisory tracks: hours, metadata, initial points and movement between advisories.

``points`` carry ``storm_id``, ``adv``, ``seq``, ``lat``, ``lon``, ``style`` and the
map ``ext``; ``lines`` carry ``storm_id``, ``adv``, ``seq`` and ``ext``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.functions import geo, text
from galeframe.functions.times import hours_between
from galeframe.operators.attach import attach
from galeframe.operators.ordered import HotKeys, position, previous, row_count, whole, with_ordered

ADVISORY = ["storm_id", "adv"]


def _ext(source: str, key: str) -> Column:
    return text.blank_to_null(F.try_element_at(F.col(source), F.lit(key)))


def best_metadata(lines: DataFrame) -> DataFrame:
    """Per advisory the line metadata with most filled values (first on a tie).

    Also the largest forecast period named by a line.
    """
    filled = F.size(F.filter(F.map_values("ext"), lambda v: F.trim(v) != ""))
    return lines.filter(F.size("ext") > 0).groupBy(*ADVISORY).agg(
        F.max_by("ext", F.struct(filled, -F.col("seq"))).alias("best"),
        F.max(F.coalesce(_ext("ext", "fcstpd").try_cast("int"), F.lit(0))).alias("max_fcstpd"),
    )


def _with_best(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Points with position and count in their advisory, and its best metadata."""
    placed = with_ordered(points, ADVISORY, ["seq"], {"pos": position(), "n": row_count()})
    return attach(placed, best_metadata(lines), ADVISORY, "left")


def _hour() -> Column:
    given = F.coalesce(_ext("ext", "fcstpd").try_cast("int"), F.lit(-1))
    i, last = F.col("pos") - 1, F.col("n") - 1
    spread = F.rint(F.col("max_fcstpd") * i / F.nullif(last.cast("double"), F.lit(0.0))).cast("int")
    return (
        F.when(given >= 0, given)
        .when(i == 0, F.lit(0))
        .when((F.col("max_fcstpd") > 0) & (F.col("n") > 1), spread)
        .otherwise((i * 6).cast("int"))
        .alias("hour")
    )


def impute_hours(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Add ``hour``: the given one, or one spread over the period, or six-hourly."""
    return _with_best(points, lines).select(*points.columns, _hour())


# Result column -> metadata names tried in order.
METADATA_FIELDS = {
    "storm_name": ("stormName",),
    "storm_type": ("stormType",),
    "adv_time": ("pubAdvTime", "advisoryDate"),
    "wind_kt": ("maxWindKnots",),
    "wind_mph": ("maxWindMPH",),
    "movement": ("stormMovement",),
    "pressure_mb": ("minimumPressure", "minimumPressureMb"),
    "advisory_num": ("advisoryNum",),
}


def _metadata() -> list[Column]:
    return [
        F.coalesce(*[_ext("ext", k) for k in keys], *[_ext("best", k) for k in keys], F.lit("")).alias(name)
        for name, keys in METADATA_FIELDS.items()
    ]


def fill_metadata(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Each field from the point, else from the advisory's best metadata, else ''."""
    return attach(points, best_metadata(lines), ADVISORY, "left").select(*points.columns, *_metadata())


def advisory_points(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Hours and metadata together, with one pass over points and over lines."""
    return _with_best(points, lines).select(*points.columns, _hour(), *_metadata())


def initial_points(points: DataFrame) -> DataFrame:
    """Per advisory the first point with hour 0, else the earliest point."""
    rest = [c for c in points.columns if c not in ADVISORY]
    rank = F.struct((F.col("hour") != 0).alias("later"), F.col("hour"), F.col("seq"))
    return (
        points.groupBy(*ADVISORY)
        .agg(F.min_by(F.struct(*rest), rank).alias("p"))
        .select(*ADVISORY, "p.*")
    )


def latest_advisory(points: DataFrame) -> DataFrame:
    """Points of each storm's highest advisory."""
    top = points.groupBy("storm_id").agg(F.max("adv").alias("adv"))
    return attach(points, top, ADVISORY)


def advisory_movement(initials: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Speed and direction between a storm's last two advisories.

    Six hours are assumed where a time cannot be read; a movement text in the
    advisory wins over the computed direction.
    """
    timed = initials.withColumn("_t", text.advisory_time(F.col("adv_time")))
    seen = with_ordered(
        timed, ["storm_id"], ["adv"],
        {"prev": previous("lat", "lon", "_t"), "_top": whole(F.max, F.col("adv"))}, hot=hot,
    ).filter(F.col("adv") == F.col("_top"))
    here = (F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon"))
    gap = hours_between(F.col("prev._t"), F.col("_t"))
    hours = F.when(gap.isNull(), F.lit(6.0)).otherwise(F.greatest(gap, F.lit(0.1)))
    course = F.when(F.col("prev").isNotNull(), geo.bearing_deg(*here))
    return seen.select(
        "storm_id",
        "adv",
        F.when(F.col("prev").isNotNull(), geo.haversine_km(*here) / hours).alias("speed_kmh"),
        course.alias("bearing"),
        F.coalesce(text.blank_to_null(F.col("movement")), geo.compass16(course), F.lit("N/A")).alias("direction"),
    )


def history_path(initials: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Initial positions of all advisories in order, one row each."""
    placed = with_ordered(initials, ["storm_id"], ["adv"], {"pos": position()}, hot=hot)
    return placed.select("storm_id", "pos", "adv", "lat", "lon")


def track_profile(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Per advisory: points, periods named by lines in order, first metadata sample."""
    counted = points.groupBy(*ADVISORY).agg(F.count(F.lit(1)).alias("point_count"))
    # Advisory files name at most one period per line and hold a handful of lines.
    named = (
        lines.groupBy(*ADVISORY)
        .agg(
            F.concat_ws(",", F.transform(
                F.array_sort(F.collect_set(F.when(
                    _ext("ext", "fcstpd").isNotNull(), F.struct("seq", _ext("ext", "fcstpd").alias("p"))
                ))), lambda x: x["p"])).alias("line_fcstpd"),
            F.min_by("ext", F.when(F.size("ext") > 0, F.col("seq"))).alias("sample"),
        )
    )
    out = counted.join(named, ADVISORY, "full")
    return out.withColumn("line_fcstpd", F.coalesce("line_fcstpd", F.lit("")))


def pair_files(tracks: DataFrame, cones: DataFrame, five_days: DataFrame, keep: str = "last") -> DataFrame:
    """Track files with the cone and five-day file of the same advisory number.

    Of several cones with one number the last (or first) by name counts; of several
    five-day files the first.
    """
    best = F.max if keep == "last" else F.min
    cone = cones.groupBy("storm_id", "adv").agg(best("file").alias("cone_file"))
    five = five_days.groupBy("storm_id", "adv").agg(F.min("file").alias("five_day_file"))
    return attach(attach(tracks, cone, ADVISORY, "left"), five, ADVISORY, "left")


def storm_summary(points: DataFrame, initials: DataFrame, movement: DataFrame) -> DataFrame:
    """One row per storm: the latest advisory in words, with counts."""
    latest = latest_advisory(initials).drop("hour", "seq")
    history = initials.groupBy("storm_id").agg(F.count(F.lit(1)).alias("history_advisories"))
    counted = points.groupBy(*ADVISORY).agg(F.count(F.lit(1)).alias("forecast_points"))
    joined = attach(attach(attach(latest, counted, ADVISORY), history, ["storm_id"]), movement, ADVISORY, "left")
    shown = lambda c: F.coalesce(text.blank_to_null(F.col(c)), F.lit("N/A")).alias(c)
    return joined.select(
        "storm_id",
        shown("storm_name"),
        shown("storm_type"),
        F.coalesce(text.blank_to_null(F.col("advisory_num")), F.col("adv").cast("string")).alias("advisory"),
        shown("adv_time"),
        F.coalesce("direction", F.lit("N/A")).alias("direction"),
        F.coalesce(F.format_string("%.1f km/h", "speed_kmh"), F.lit("N/A")).alias("speed"),
        shown("wind_kt"),
        shown("pressure_mb"),
        "forecast_points",
        "history_advisories",
    )
