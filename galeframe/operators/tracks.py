"""Storm tracks: enrichment, merging with history, interpolation, cones, catalogues.

Tables of points have one row per point.  ``advisory_time`` is a timestamp and
``seq`` breaks ties; everything that looks along a track goes through
``with_ordered``, so a storm with very many points is cut instead of landing in
one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions import classify, geo, units
from galeframe.functions.times import hours_between
from galeframe.operators.attach import attach
from galeframe.operators.ordered import (
    HotKeys,
    following,
    hot_keys,
    in_parts,
    last_known,
    next_known,
    position,
    previous,
    row_count,
    whole,
    with_ordered,
)

STORM = ["storm_id"]
ALONG = ["advisory_time", "seq"]


def along(
    points: DataFrame, values: dict, keys: Sequence[str] = STORM, hot: HotKeys | None = None
) -> DataFrame:
    """``with_ordered`` over the points of each storm in time order."""
    return with_ordered(points, keys, ALONG, values, F.unix_micros("advisory_time"), hot)


def _motion(points: DataFrame) -> DataFrame:
    """Add ``forward_speed`` and ``direction`` from the struct ``prev``."""
    here = (F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon"))
    hours = hours_between(F.col("prev.advisory_time"), F.col("advisory_time"))
    speed = F.bround(geo.haversine_km(*here) / F.nullif(hours, F.lit(0.0)), 1)
    return points.withColumns(
        {
            "forward_speed": F.when(hours > 0, speed).otherwise(F.lit(0.0)),
            "direction": F.when(F.col("prev").isNull(), F.lit("N")).otherwise(
                geo.compass16(geo.bearing_deg(*here))
            ),
        }
    )


PREV = previous("advisory_time", "lat", "lon")


def forward_motion(points: DataFrame) -> DataFrame:
    """Speed (km/h) and 16-point direction from the point before; first 0.0 and N."""
    return _motion(along(points, {"prev": PREV})).drop("prev")


def current_time() -> Column:
    return F.when(F.col("type") == "current", F.col("advisory_time"))


def describe(points: DataFrame, given_radius: Column | None = None) -> DataFrame:
    """Units, icon, motion and cone from the columns ``prev`` and ``current_time``."""
    lead = hours_between(F.col("current_time"), F.col("advisory_time"))
    return (
        _motion(points)
        .withColumns(
            {
                "wind_kmh": units.knots_to_kmh(F.col("wind_kts")),
                "pressure_mmhg": units.hpa_to_mmhg(F.col("pressure_hpa")),
                "icon_tag": classify.icon_by_wind(F.col("wind_kts"), F.col("type")),
                "cone_radius_km": classify.point_cone_radius(F.col("type"), lead, given_radius),
            }
        )
        .drop("prev", "current_time")
    )


def enrich_track(points: DataFrame, given_radius: str | None = None) -> DataFrame:
    """Units, icon, speed, direction and cone radius of every point.

    Lead time counts from the storm's first current point; without one every
    forecast point gets the smallest radius. ``given_radius`` names a column with
    the source's own radius, which wins where present.
    """
    seen = along(points, {"prev": PREV, "current_time": whole(F.min, current_time())})
    return describe(seen, F.col(given_radius) if given_radius else None)


def dedupe_track(points: DataFrame, newest: Sequence[str] = ("batch_seq", "seq")) -> DataFrame:
    """One row per storm, time and position at 4 decimals; the newest row wins.

    An aggregate, so that many copies of one point combine before the shuffle.
    """
    rest = [c for c in points.columns if c not in ("storm_id", "advisory_time")]
    return (
        points.groupBy(
            "storm_id", "advisory_time",
            F.bround("lat", 4).alias("_lat"), F.bround("lon", 4).alias("_lon"),
        )
        .agg(F.max_by(F.struct(*rest), F.struct(*newest)).alias("_row"))
        .select("storm_id", "advisory_time", "_row.*")
        .select(*points.columns)
    )


def fold_batches(points: DataFrame, batch: str = "batch_seq") -> DataFrame:
    """State of each storm after its bulletins arrived one after the other.

    ``batch`` orders the arrivals. Of equal points the latest wins; forecasts stay
    only from the storm's last bulletin; earlier current points become past; of
    several current points in the last bulletin the newest stays. The result is
    enriched. Folding all arrivals at once equals merging them one by one.
    """
    hot = hot_keys(points, STORM)
    # A row of the last bulletin always survives the de-duplication, so the last
    # batch may be taken afterwards; both ordered passes then share one shuffle.
    unique = dedupe_track(points, (batch, "seq"))
    values = {"_last": whole(F.max, F.col(batch))}
    if "storm_name" in points.columns:
        # A bulletin without a name takes the last one that is known.
        values["_named"] = whole(F.max, F.when(F.col("storm_name").isNotNull(), F.struct(batch, "seq", F.col("storm_name").alias("name"))))
    tagged = along(unique, values, hot=hot)
    if "_named" in values:
        tagged = tagged.withColumn("storm_name", F.coalesce("storm_name", "_named.name")).drop("_named")
    kept = tagged.filter((F.col("type") != "forecast") | (F.col(batch) == F.col("_last")))
    demoted = kept.withColumn(
        "type",
        F.when(
            (F.col("type") == "current") & (F.col(batch) < F.col("_last")), F.lit("past")
        ).otherwise(F.col("type")),
    ).drop("_last")
    seen = along(
        demoted, {"prev": PREV, "current_time": whole(F.max, current_time())}, hot=hot
    )
    settled = seen.withColumn(
        "type",
        F.when(
            (F.col("type") == "current") & (F.col("advisory_time") < F.col("current_time")),
            F.lit("past"),
        ).otherwise(F.col("type")),
    )
    return describe(settled)


def merge_track(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored points and a new bulletin per storm, merged and enriched.

    Storms without a new bulletin keep their points as they are. A missing name is
    filled from the stored one.
    """
    both = stored.withColumn("batch_seq", F.lit(0)).unionByName(
        new.withColumn("batch_seq", F.lit(1)), allowMissingColumns=True
    )
    return fold_batches(both)


def latest_issue(points: DataFrame) -> DataFrame:
    """Like ``fold_batches`` but by issue time, so a late old bulletin does no harm.

    Forecasts stay only from the newest issue of the storm, whenever it arrived. A
    bulletin without issue time counts as older than any other.
    """
    dated = points.withColumn("_issue", F.coalesce("issue_time", F.to_timestamp(F.lit("0001-01-01"))))
    return fold_batches(dated, "_issue").drop("_issue")


def point_type(points: DataFrame, now: Column) -> DataFrame:
    """Set ``type``: the point nearest to ``now`` is current, earlier ones are past.

    Of two equally near points the earlier counts.
    """
    gap = F.abs(F.unix_micros("advisory_time") - F.unix_micros(now))
    rank = F.struct(gap.alias("gap"), F.col("advisory_time").alias("t"), F.col("seq").alias("s"))
    nearest = points.groupBy("storm_id").agg(F.min(rank).alias("_near"))
    here = F.struct(F.col("advisory_time"), F.col("seq"))
    there = F.struct(F.col("_near.t").alias("advisory_time"), F.col("_near.s").alias("seq"))
    return (
        attach(points.drop("type"), nearest, STORM)
        .withColumn("type", F.when(here == there, "current").when(here < there, "past").otherwise("forecast"))
        .drop("_near")
    )


def time_window(points: DataFrame, start: Column, end: Column) -> DataFrame:
    return points.filter(F.col("advisory_time").between(start, end))


def drop_incomplete(points: DataFrame) -> DataFrame:
    return points.dropna(subset=["advisory_time", "lat", "lon"])


def season_storms(points: DataFrame, year: int) -> DataFrame:
    """Storms whose first time lies in ``year``."""
    return (
        points.groupBy("storm_id")
        .agg(F.min("advisory_time").alias("start_time"))
        .filter(F.year("start_time") == year)
    )


def storm_catalog(points: DataFrame) -> DataFrame:
    """One row per storm: name, basin, start and end, peak wind (0 if none), lowest pressure."""
    order = F.struct("advisory_time", "seq")
    return points.groupBy("storm_id").agg(
        F.min_by("storm_name", order).alias("storm_name"),
        F.min_by("basin", order).alias("basin"),
        F.min("advisory_time").alias("start_time"),
        F.max("advisory_time").alias("end_time"),
        F.coalesce(F.max("wind_kts"), F.lit(0.0)).alias("max_wind"),
        F.min("pressure_hpa").alias("min_pressure"),
        F.count(F.lit(1)).alias("n_points"),
    )


def recent_storms(catalog: DataFrame, n: int = 10) -> DataFrame:
    return catalog.orderBy(F.desc("start_time"), F.asc("storm_id")).limit(n)


def last_storms(points: DataFrame, n: int = 3) -> DataFrame:
    """Last storms in data order (by the first row of each storm)."""
    return (
        points.groupBy("storm_id").agg(F.min("seq").alias("first_seq"))
        .orderBy(F.desc("first_seq")).limit(n)
    )


def latest_tail(points: DataFrame, n: int = 5) -> DataFrame:
    """Last points of the storm that started last."""
    newest = recent_storms(storm_catalog(points), 1).select("storm_id")
    return (
        points.join(F.broadcast(newest), "storm_id", "left_semi")
        .orderBy(F.desc("advisory_time"), F.desc("seq"))
        .limit(n)
    )


def mean_center(points: DataFrame, keys: Sequence[str] = STORM) -> DataFrame:
    return points.groupBy(*keys).agg(F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon"))


def warning_center(points: DataFrame, keys: Sequence[str], ahead: Column, seen: Column) -> DataFrame:
    """First point that is ``ahead`` (forecast), else the last that was ``seen``, by ``rank``."""
    spot = F.struct("lat", "lon")
    first = F.min_by(spot, F.when(ahead, F.col("rank")))
    last = F.max_by(spot, F.when(seen, F.col("rank")))
    centers = points.groupBy(*keys).agg(F.coalesce(first, last).alias("_c"))
    return centers.filter(F.col("_c").isNotNull()).select(
        *keys, F.col("_c.lat").alias("center_lat"), F.col("_c.lon").alias("center_lon")
    )


def last_leg_speed(points: DataFrame, keys: Sequence[str] = STORM) -> DataFrame:
    """km/h over the last two points of each storm, null if time does not advance."""
    order = F.struct("advisory_time", "seq")
    seen = along(points, {"prev": PREV, "_end": whole(F.max, order)}, keys)
    hours = hours_between(F.col("prev.advisory_time"), F.col("advisory_time"))
    km = geo.haversine_km(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon"))
    return seen.filter((order == F.col("_end")) & F.col("prev").isNotNull()).select(
        *keys, F.when(hours > 0, km / F.nullif(hours, F.lit(0.0))).alias("speed_kmh")
    )


FORECAST_HOURS = tuple(sorted(classify.CONE_ERRORS))


def time_interpolate(
    points: DataFrame,
    cutoff: Column,
    hours: Sequence[int] = FORECAST_HOURS,
    values: Sequence[str] = ("lat", "lon", "wind_kts"),
) -> DataFrame:
    """Values at ``cutoff`` plus each hour, linear in time between known samples.

    After the last sample its value holds; before the first there is none. Targets
    join the samples as extra rows of the same ordered pass, so there is no range join.
    """
    samples = points.select(
        "storm_id", "advisory_time", "seq", *values, F.lit(None).cast("int").alias("fhr")
    )
    asked = points.select("storm_id").distinct().select(
        "storm_id", F.explode(F.lit(list(hours))).alias("fhr")
    )
    targets = asked.select(
        "storm_id",
        F.timestamp_micros(F.unix_micros(cutoff) + F.col("fhr").cast("long") * F.lit(3_600_000_000)).alias(
            "advisory_time"
        ),
        F.lit(None).cast("long").alias("seq"),
        *[F.lit(None).cast("double").alias(v) for v in values],
        "fhr",
    )
    line = samples.unionByName(targets)
    known = lambda v: F.when(
        F.col(v).isNotNull(), F.struct(F.unix_micros("advisory_time").alias("t"), F.col(v).alias("v"))
    )
    wanted = {f"_b_{v}": last_known(known(v)) for v in values}
    wanted |= {f"_a_{v}": next_known(known(v)) for v in values}
    seen = along(line, wanted).filter(F.col("fhr").isNotNull())

    def at(v: str) -> Column:
        before, after, now = F.col(f"_b_{v}"), F.col(f"_a_{v}"), F.unix_micros("advisory_time")
        share = (now - before["t"]) / F.nullif((after["t"] - before["t"]).cast("double"), F.lit(0.0))
        line_value = before["v"] + (after["v"] - before["v"]) * share
        exact = F.when(after["t"] == now, after["v"])
        return F.coalesce(
            exact, F.when(after.isNull(), before["v"]).when(before.isNotNull(), line_value)
        ).alias(v)

    return seen.select("storm_id", "fhr", "advisory_time", *[at(v) for v in values])


def cone_edges(
    points: DataFrame,
    error: str = "cone_error_km",
    keys: Sequence[str] = STORM,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Left and right edge points of the cone at each forecast hour ``fhr``.

    Heading to the next point; the last point keeps the heading from the one before,
    and a single point heads north.
    """
    seen = with_ordered(
        points, keys, ["fhr"], {"prev": previous("lat", "lon"), "next": following("lat", "lon")}, hot=hot
    )
    lat, lon = F.col("lat"), F.col("lon")
    heading = (
        F.when(F.col("next").isNotNull(), geo.bearing_deg(lat, lon, F.col("next.lat"), F.col("next.lon")))
        .when(F.col("prev").isNotNull(), geo.bearing_deg(F.col("prev.lat"), F.col("prev.lon"), lat, lon))
        .otherwise(F.lit(0.0))
    )
    headed = seen.withColumn("heading", heading)
    sides = {}
    for side, turn in (("left", -90), ("right", 90)):
        course = F.col("heading") + turn
        sides[f"{side}_lat"] = geo.destination_lat(lat, course, F.col(error))
        sides[f"{side}_lon"] = geo.destination_lon(lat, lon, course, F.col(error))
    return headed.withColumns(sides).drop("prev", "next")


def cone_ring(edges: DataFrame, keys: Sequence[str] = STORM, hot: HotKeys | None = None) -> DataFrame:
    """The polygon as rows: left edge onwards, then right edge backwards."""
    placed = with_ordered(edges, keys, ["fhr"], {"pos": position(), "n": row_count()}, hot=hot)
    left = F.struct(F.col("pos").alias("ring_seq"), F.col("left_lat").alias("lat"), F.col("left_lon").alias("lon"))
    right = F.struct(
        (F.col("n") * 2 + 1 - F.col("pos")).alias("ring_seq"),
        F.col("right_lat").alias("lat"),
        F.col("right_lon").alias("lon"),
    )
    return placed.select(*keys, F.explode(F.array(left, right)).alias("p")).select(*keys, "p.*")


def with_icons(points: DataFrame, icons: DataFrame, storm_type: str = "storm_type") -> DataFrame:
    """Add ``icon_file`` and ``icon_label`` by type code, given the icons at hand.

    ``icons`` has one row per icon stem (at most eleven are defined), so it is
    broadcast. Where the wanted icon is missing its plain form is used.
    """
    wanted, fallback = classify.icon_stem(F.col(storm_type), F.col("lat"))
    first = F.broadcast(icons.select(F.col("stem").alias("_w"), F.col("file").alias("_wf"), F.col("label").alias("_wl")))
    second = F.broadcast(icons.select(F.col("stem").alias("_b"), F.col("file").alias("_bf"), F.col("label").alias("_bl")))
    return (
        points.withColumns({"_want": wanted, "_back": fallback})
        .join(first, F.col("_want") == F.col("_w"), "left")
        .join(second, F.col("_back") == F.col("_b"), "left")
        .select(
            *points.columns,
            F.coalesce("_wf", "_bf").alias("icon_file"),
            F.coalesce("_wl", "_bl").alias("icon_label"),
        )
    )


def icon_table(spark: SparkSession, stems: Sequence[str] | None = None) -> DataFrame:
    """Icon definitions, all of them or those whose file is at hand."""
    rows = [r for r in classify.ICON_ROWS if stems is None or r[0] in stems]
    values = ", ".join(f"('{s}', '{s}.png', '{label}', {active})" for s, label, active in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(stem, file, label, active)")


def basin_route(points: DataFrame) -> DataFrame:
    """Add the agency and the extra field source a basin is read from."""
    # Basin -> agency.
    return points.withColumns(
        {
            "agency": F.when(F.col("basin").isin("NA", "EP"), "NHC").when(F.col("basin") == "WP", "JMA"),
            "field_source": F.when(F.col("basin") == "WP", "GFS"),
        }
    )


def forecast_columns(forecast: DataFrame, part_rows: int = 1000, keys: Sequence[str] = STORM) -> DataFrame:
    """Rows to ``forecast`` struct of parallel arrays (fhr, lat, lon), in parts."""
    placed = in_parts(forecast, keys, ["fhr"], part_rows)
    items = F.array_sort(F.collect_list(F.struct("fhr", "lat", "lon")))
    return (
        placed.groupBy(*keys, "part").agg(items.alias("_p"))
        .select(*keys, "part", F.struct(
            F.transform("_p", lambda p: p["fhr"]).alias("fhr"),
            F.transform("_p", lambda p: p["lat"]).alias("lat"),
            F.transform("_p", lambda p: p["lon"]).alias("lon"),
        ).alias("forecast"))
    )
