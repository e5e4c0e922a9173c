"""Queries over storm points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe import sinks
from galeframe.functions import classify, geo, times, units
from galeframe.operators import grid_stats, tracks
from galeframe.operators.ordered import hot_keys, position
from galeframe.plans import sqlkit as q
from galeframe.plans import views
from galeframe.plans.registry import micros, query, r6, rounded
from galeframe.plans.views import BATCHES_SQL, CUTOFF, TRACK_SQL, table, track
from galeframe.session import scratch_dir
from galeframe.sources import documents

WITH_PREV = (
    f"WITH {TRACK_SQL}, l AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, "
    "lag(advisory_time) OVER w AS pt FROM track "
    "WINDOW w AS (PARTITION BY storm_id ORDER BY advisory_time, seq))"
)
LEG = ("plat", "plon", "lat", "lon")
SPEED = (
    f"CASE WHEN {q.hours('pt', 'advisory_time')}>0 THEN "
    f"round_even({q.hav(*LEG)}/{q.hours('pt', 'advisory_time')},1) ELSE 0e0 END"
)
DIRECTION = f"CASE WHEN pt IS NULL THEN 'N' ELSE {q.compass(q.bearing(*LEG))} END"


def legs(spark, sf) -> DataFrame:
    """Points with the position before as ``plat``, ``plon``."""
    seen = tracks.along(track(spark, sf), {"prev": tracks.PREV})
    return seen.filter("prev IS NOT NULL").withColumns(
        {"plat": F.col("prev.lat"), "plon": F.col("prev.lon")}
    )


def leg_columns():
    return [F.col(c) for c in LEG]


@query("haversine_km", f"{WITH_PREV} SELECT seq, ROUND({q.hav(*LEG)},6) AS km FROM l WHERE pt IS NOT NULL")
def _(spark, sf):
    return legs(spark, sf).select("seq", r6(geo.haversine_km(*leg_columns())).alias("km"))


@query("bearing_deg", f"{WITH_PREV} SELECT seq, ROUND({q.bearing(*LEG)},6) AS deg FROM l WHERE pt IS NOT NULL")
def _(spark, sf):
    return legs(spark, sf).select("seq", r6(geo.bearing_deg(*leg_columns())).alias("deg"))


@query(
    "compass16",
    f"WITH {TRACK_SQL} SELECT seq, {q.compass(q.mod360('lon'))} AS direction FROM track",
)
def _(spark, sf):
    return track(spark, sf).select(
        "seq", geo.compass16(geo.whole_turn(F.col("lon"))).alias("direction")
    )


DEST = ("lat", "lon", "(seq%360)*1e0", "(seq%900)*1e0")


@query(
    "destination_point",
    f"WITH {TRACK_SQL} SELECT seq, ROUND({q.dest_lat(DEST[0], DEST[2], DEST[3])},6) AS to_lat, "
    f"ROUND({q.dest_lon(*DEST)},6) AS to_lon FROM track",
)
def _(spark, sf):
    lat, lon = F.col("lat"), F.col("lon")
    course, km = (F.col("seq") % 360) * F.lit(1.0), (F.col("seq") % 900) * F.lit(1.0)
    return track(spark, sf).select(
        "seq",
        r6(geo.destination_lat(lat, course, km)).alias("to_lat"),
        r6(geo.destination_lon(lat, lon, course, km)).alias("to_lon"),
    )


LEAD = q.hours(f"TIMESTAMP '{CUTOFF}'", "advisory_time")


def lead():
    return times.hours_between(F.lit(CUTOFF).cast("timestamp"), F.col("advisory_time"))


@query("lead_hours", f"WITH {TRACK_SQL} SELECT seq, ROUND({LEAD},6) AS lead FROM track")
def _(spark, sf):
    return track(spark, sf).select("seq", r6(lead()).alias("lead"))


@query(
    "cone_radius",
    f"WITH {TRACK_SQL} SELECT seq, CASE WHEN type IN ('past','current') THEN 0e0 ELSE {q.cone(LEAD)} END "
    "AS radius FROM track",
)
def _(spark, sf):
    return track(spark, sf).select(
        "seq", classify.point_cone_radius(F.col("type"), lead()).alias("radius")
    )


@query("knots_to_kmh", f"WITH {TRACK_SQL} SELECT seq, round_even(wind_kts*1.852e0,1) AS kmh FROM track")
def _(spark, sf):
    return track(spark, sf).select("seq", units.knots_to_kmh(F.col("wind_kts")).alias("kmh"))


@query(
    "hpa_to_mmhg",
    f"WITH {TRACK_SQL} SELECT seq, round_even(pressure_hpa*0.75e0,1) AS mmhg, "
    "CAST(floor(pressure_hpa*0.75e0) AS INT) AS whole_mmhg FROM track",
)
def _(spark, sf):
    hpa = F.col("pressure_hpa")
    return track(spark, sf).select(
        "seq", units.hpa_to_mmhg(hpa).alias("mmhg"), units.hpa_to_whole_mmhg(hpa).alias("whole_mmhg")
    )


@query("icon_tag_wind", f"WITH {TRACK_SQL} SELECT seq, {q.icon('wind_kts', 'type')} AS icon FROM track")
def _(spark, sf):
    return track(spark, sf).select(
        "seq", classify.icon_by_wind(F.col("wind_kts"), F.col("type")).alias("icon")
    )


@query(
    "icon_tag_jtwc",
    f"WITH {TRACK_SQL}, w AS (SELECT seq, type='past' AS gray, wind_kts-20 AS kt FROM track) "
    "SELECT seq, CASE WHEN kt<=0 THEN 'LOW.png' ELSE concat(CASE WHEN kt IS NULL OR kt<34 THEN 'TD' "
    "WHEN kt<64 THEN 'TS' ELSE 'TY' END, CASE WHEN gray THEN 'gray' ELSE '' END, '.png') END AS icon FROM w",
)
def _(spark, sf):
    return track(spark, sf).select(
        "seq", classify.icon_by_warning(F.col("wind_kts") - 20, F.col("type") == "past").alias("icon")
    )


CODES = ["TD", "ts", "SS", "HU", "TY", "ST", "LO", "EX", "DB", "XX", "et"]
HAND_ICONS = ["LOW", "TD", "TS", "TY", "TSSH", "TDgray", "TSgray", "TYgray"]


@query(
    "icon_from_type",
    f"WITH {TRACK_SQL}, c AS (SELECT seq, lat<0 AS s, upper(([{', '.join(repr(c) for c in CODES)}])[seq%11+1]) "
    "AS code FROM track), k AS (SELECT seq, CASE WHEN code IN ('TS','SS') THEN CASE WHEN s THEN 'TSSH' ELSE 'TS' END "
    "WHEN code IN ('HU','TY','ST') THEN 'TY' WHEN code='TD' THEN 'TD' WHEN code='LO' THEN 'LOW' ELSE 'TDgray' END "
    "AS stem FROM c) SELECT seq, concat(stem,'.png') AS icon_file, CASE stem WHEN 'LOW' THEN 'Low' "
    "WHEN 'TD' THEN 'Tropical Depression' WHEN 'TS' THEN 'Tropical Storm' WHEN 'TY' THEN 'Hurricane/Typhoon' "
    "WHEN 'TSSH' THEN 'Tropical Storm (South Hemisphere)' ELSE 'Post/Weak Depression' END AS icon_label FROM k",
)
def _(spark, sf):
    code = F.element_at(F.lit(CODES), (F.col("seq") % 11 + 1).cast("int"))
    typed = track(spark, sf).select("seq", "lat", code.alias("storm_type"))
    icons = tracks.icon_table(spark, HAND_ICONS)
    return tracks.with_icons(typed, icons).select("seq", "icon_file", "icon_label")


@query(
    "type_from_vmax",
    f"WITH {TRACK_SQL} SELECT seq, CASE WHEN wind_kts IS NULL OR wind_kts<34 THEN 'TD' "
    "WHEN wind_kts<64 THEN 'TS' ELSE 'HU' END AS storm_type FROM track",
)
def _(spark, sf):
    return track(spark, sf).select("seq", classify.type_by_wind(F.col("wind_kts")).alias("storm_type"))


@query(
    "point_label",
    f"WITH {TRACK_SQL}, h AS (SELECT seq, CASE WHEN seq%5=0 THEN NULL ELSE CAST(seq%12*6 AS INT) END AS tau, "
    "CASE WHEN seq%4=0 THEN '#initial_point' ELSE '#point' END AS style FROM track) "
    "SELECT seq, CASE WHEN tau IS NULL THEN 'Initial' ELSE concat('+',tau,'h') END AS label, "
    "coalesce(tau=0,false) OR style='#initial_point' AS initial FROM h",
)
def _(spark, sf):
    h = track(spark, sf).select(
        "seq",
        F.when(F.col("seq") % 5 != 0, (F.col("seq") % 12 * 6).cast("int")).alias("tau"),
        F.when(F.col("seq") % 4 == 0, "#initial_point").otherwise("#point").alias("style"),
    )
    return h.select(
        "seq",
        classify.point_label(F.col("tau")).alias("label"),
        classify.is_initial(F.col("tau"), F.col("style")).alias("initial"),
    )


ENRICHED = (
    "storm_id, seq, epoch_us(advisory_time) AS advisory_time, type, round_even(wind_kts*1.852e0,1) AS wind_kmh, "
    f"round_even(pressure_hpa*0.75e0,1) AS pressure_mmhg, {q.icon('wind_kts', 'type')} AS icon_tag, "
    f"{SPEED} AS forward_speed, {DIRECTION} AS direction, "
    f"CASE WHEN type IN ('past','current') THEN 0e0 ELSE {q.cone(q.hours('ct', 'advisory_time'))} END AS cone_radius_km"
)


def enriched_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "storm_id", "seq", micros("advisory_time"), "type", "wind_kmh", "pressure_mmhg",
        "icon_tag", "forward_speed", "direction", "cone_radius_km",
    )


@query(
    "enrich_track",
    f"{WITH_PREV}, e AS (SELECT *, min(CASE WHEN type='current' THEN advisory_time END) "
    f"OVER (PARTITION BY storm_id) AS ct FROM l) SELECT {ENRICHED} FROM e",
)
def enrich_track(spark, sf):
    return enriched_columns(tracks.enrich_track(track(spark, sf)))


@query("forward_speed", f"{WITH_PREV} SELECT seq, {SPEED} AS forward_speed FROM l")
def _(spark, sf):
    return tracks.forward_motion(track(spark, sf)).select("seq", "forward_speed")


@query("direction", f"{WITH_PREV} SELECT seq, {DIRECTION} AS direction FROM l")
def _(spark, sf):
    return tracks.forward_motion(track(spark, sf)).select("seq", "direction")


@query(
    "point_type",
    f"WITH {TRACK_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY storm_id ORDER BY "
    f"abs(epoch_us(advisory_time)-epoch_us(TIMESTAMP '{CUTOFF}')), advisory_time, seq) AS rn FROM track), "
    "c AS (SELECT storm_id, advisory_time AS ct, seq AS cs FROM n WHERE rn=1) "
    "SELECT seq, CASE WHEN rn=1 THEN 'current' WHEN (advisory_time,seq)<(ct,cs) THEN 'past' ELSE 'forecast' END "
    "AS type FROM n JOIN c USING (storm_id)",
)
def _(spark, sf):
    now = F.lit(CUTOFF).cast("timestamp")
    return tracks.point_type(track(spark, sf), now).select("seq", "type")


@query(
    "track_time_window",
    f"WITH {TRACK_SQL} SELECT storm_id, seq FROM track WHERE advisory_time BETWEEN TIMESTAMP '2024-01-08' "
    f"AND TIMESTAMP '{CUTOFF}'",
)
def _(spark, sf):
    ts = lambda t: F.lit(t).cast("timestamp")
    return tracks.time_window(track(spark, sf), ts("2024-01-08 00:00:00"), ts(CUTOFF)).select("storm_id", "seq")


@query(
    "drop_incomplete",
    f"WITH {TRACK_SQL}, h AS (SELECT seq, CASE WHEN seq%7=0 THEN NULL ELSE lat END AS lat, "
    "CASE WHEN seq%5=0 THEN NULL ELSE lon END AS lon FROM track) SELECT seq, lat, lon FROM h "
    "WHERE lat IS NOT NULL AND lon IS NOT NULL",
)
def _(spark, sf):
    holes = track(spark, sf).withColumns(
        {
            "lat": F.when(F.col("seq") % 7 != 0, F.col("lat")),
            "lon": F.when(F.col("seq") % 5 != 0, F.col("lon")),
        }
    )
    return tracks.drop_incomplete(holes).select("seq", "lat", "lon")


def shifted(spark, sf):
    """Storms moved to different years by their number."""
    moved = F.timestamp_micros(
        F.unix_micros("advisory_time") + (F.col("storm_id") % 4) * F.lit(366 * 86_400_000_000)
    )
    return track(spark, sf).withColumn("advisory_time", moved)


@query(
    "season_filter",
    f"WITH {TRACK_SQL}, s AS (SELECT storm_id, min(epoch_us(advisory_time)+(storm_id%4)*31622400000000) AS t "
    "FROM track GROUP BY 1) SELECT storm_id, t AS start_time FROM s WHERE year(make_timestamp(t))=2026",
)
def _(spark, sf):
    return tracks.season_storms(shifted(spark, sf), 2026).select("storm_id", micros("start_time"))


CATALOG = (
    "SELECT storm_id, arg_min(storm_name,(advisory_time,seq)) AS storm_name, arg_min(basin,(advisory_time,seq)) "
    "AS basin, min(epoch_us(advisory_time)) AS start_time, max(epoch_us(advisory_time)) AS end_time, "
    "coalesce(max(wind_kts),0e0) AS max_wind, min(pressure_hpa) AS min_pressure, count(*) AS n_points "
    "FROM track GROUP BY storm_id"
)


@query("storm_catalog", f"WITH {TRACK_SQL} {CATALOG}")
def _(spark, sf):
    cat = tracks.storm_catalog(track(spark, sf))
    return cat.withColumns({c: F.unix_micros(c) for c in ("start_time", "end_time")})


@query(
    "topn_recent_storms",
    f"WITH {TRACK_SQL}, c AS ({CATALOG}) SELECT storm_id, storm_name, start_time, max_wind FROM c "
    "ORDER BY start_time DESC, storm_id LIMIT 10",
)
def _(spark, sf):
    return tracks.recent_storms(tracks.storm_catalog(track(spark, sf))).select(
        "storm_id", "storm_name", micros("start_time"), "max_wind"
    )


@query(
    "last_n_storms",
    f"WITH {TRACK_SQL} SELECT storm_id, min(seq) AS first_seq FROM track GROUP BY 1 ORDER BY 2 DESC LIMIT 3",
)
def _(spark, sf):
    return tracks.last_storms(track(spark, sf))


@query(
    "latest_track_tail",
    f"WITH {TRACK_SQL}, c AS ({CATALOG}), n AS (SELECT storm_id FROM c ORDER BY start_time DESC, storm_id LIMIT 1) "
    "SELECT storm_id, epoch_us(advisory_time) AS advisory_time, lat, lon, wind_kts FROM track "
    "WHERE storm_id IN (SELECT storm_id FROM n) ORDER BY advisory_time DESC, seq DESC LIMIT 5",
)
def _(spark, sf):
    return tracks.latest_tail(track(spark, sf)).select(
        "storm_id", micros("advisory_time"), "lat", "lon", "wind_kts"
    )


@query(
    "track_bbox",
    f"WITH {TRACK_SQL} SELECT storm_id, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east, "
    "ROUND((min(lat)+max(lat))/2,6) AS center_lat, ROUND((min(lon)+max(lon))/2,6) AS center_lon FROM track GROUP BY 1",
)
def _(spark, sf):
    box = grid_stats.bounds_center(track(spark, sf), ["storm_id"])
    return rounded(box, "center_lat", "center_lon")


@query(
    "track_center",
    f"WITH {TRACK_SQL}, f AS (SELECT storm_id, lat, lon FROM track WHERE type='forecast' AND storm_id%3<>0 "
    "QUALIFY row_number() OVER (PARTITION BY storm_id ORDER BY advisory_time, seq)=1), "
    "b AS (SELECT storm_id, lat, lon FROM track WHERE type<>'forecast' "
    "QUALIFY row_number() OVER (PARTITION BY storm_id ORDER BY advisory_time DESC, seq DESC)=1), "
    "m AS (SELECT storm_id, avg(lat) AS alat, avg(lon) AS alon FROM track GROUP BY 1), "
    "c AS (SELECT coalesce(f.storm_id,b.storm_id) AS storm_id, coalesce(f.lat,b.lat) AS clat, "
    "coalesce(f.lon,b.lon) AS clon FROM f FULL JOIN b ON f.storm_id=b.storm_id) "
    "SELECT storm_id, ROUND(alat,10) AS mean_lat, ROUND(alon,10) AS mean_lon, clat AS warn_lat, clon AS warn_lon "
    "FROM m JOIN c USING (storm_id)",
)
def _(spark, sf):
    points = track(spark, sf).withColumn("rank", F.struct("advisory_time", "seq"))
    ahead = (F.col("type") == "forecast") & (F.col("storm_id") % 3 != 0)
    warn = tracks.warning_center(points, ["storm_id"], ahead, F.col("type") != "forecast")
    return tracks.mean_center(points).join(warn.withColumnsRenamed({"center_lat": "warn_lat", "center_lon": "warn_lon"}), "storm_id").select(
        "storm_id", F.round("center_lat", 10).alias("mean_lat"), F.round("center_lon", 10).alias("mean_lon"), "warn_lat", "warn_lon"
    )


HOURS = "[0, 12, 24, 36, 48, 72, 96, 120]"


def interp(v: str) -> str:
    return (
        f"CASE WHEN a{v}.t=x.t THEN a{v}.v WHEN b{v}.t IS NULL THEN NULL WHEN a{v}.t IS NULL THEN b{v}.v "
        f"ELSE b{v}.v+(a{v}.v-b{v}.v)*((x.t-b{v}.t)/((a{v}.t-b{v}.t)*1e0)) END"
    )


def asof(v: str) -> str:
    src = f"(SELECT storm_id, epoch_us(advisory_time) AS t, {v} AS v FROM track WHERE {v} IS NOT NULL)"
    return (
        f"ASOF LEFT JOIN {src} b{v} ON x.storm_id=b{v}.storm_id AND x.t>=b{v}.t "
        f"ASOF LEFT JOIN {src} a{v} ON x.storm_id=a{v}.storm_id AND x.t<=a{v}.t"
    )


# Storm numbers move the cutoff, so that targets lie before, between and after samples.
INTERP_SQL = (
    f"WITH {TRACK_SQL}, x AS (SELECT storm_id, h AS fhr, epoch_us(TIMESTAMP '2024-01-28')+h*3600000000 AS t "
    f"FROM (SELECT DISTINCT storm_id FROM track), unnest({HOURS}) AS u(h)) "
)


@query(
    "time_interpolate",
    INTERP_SQL + f"SELECT x.storm_id, CAST(fhr AS INT) AS fhr, ROUND({interp('lat')},6) AS lat, "
    f"ROUND({interp('lon')},6) AS lon, ROUND({interp('wind_kts')},6) AS wind_kts FROM x "
    f"{asof('lat')} {asof('lon')} {asof('wind_kts')}",
)
def interpolated(spark, sf):
    cutoff = F.lit("2024-01-28 00:00:00").cast("timestamp")
    out = tracks.time_interpolate(track(spark, sf), cutoff)
    return rounded(out.drop("advisory_time"), "lat", "lon", "wind_kts")


def forecast_points(spark, sf) -> DataFrame:
    """Eight forecast points per storm group: points of the track seen as hours."""
    return (
        table(spark, sf, "events")
        .selectExpr(
            "CAST(floor(event_id/8) AS BIGINT) AS storm_id",
            "element_at(array(0,12,24,36,48,72,96,120), CAST(event_id%8 AS INT)+1) AS fhr",
            "((event_id*37)%12000)/1e2-60 AS lat",
            "((event_id*91)%36000)/1e2-180 AS lon",
        )
    )


FORECAST_SQL = (
    "fc AS (SELECT CAST(floor(event_id/8) AS BIGINT) AS storm_id, "
    f"({HOURS})[event_id%8+1] AS fhr, ((event_id*37)%12000)/1e2-60 AS lat, "
    "((event_id*91)%36000)/1e2-180 AS lon FROM events)"
)
ERRORS = (
    "CASE fhr WHEN 0 THEN 0e0 WHEN 12 THEN 50e0 WHEN 24 THEN 80e0 WHEN 36 THEN 120e0 WHEN 48 THEN 150e0 "
    "WHEN 72 THEN 220e0 WHEN 96 THEN 300e0 WHEN 120 THEN 350e0 END"
)


@query("cone_error_lookup", f"WITH {FORECAST_SQL} SELECT storm_id, fhr, {ERRORS} AS cone_error_km FROM fc")
def _(spark, sf):
    return forecast_points(spark, sf).select(
        "storm_id", "fhr", classify.cone_error(F.col("fhr")).alias("cone_error_km")
    )


EDGES_SQL = (
    f"WITH {FORECAST_SQL}, n AS (SELECT *, {ERRORS} AS err, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon, "
    "lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM fc WINDOW w AS (PARTITION BY storm_id ORDER BY fhr)), "
    f"h AS (SELECT *, CASE WHEN nlat IS NOT NULL THEN {q.bearing('lat', 'lon', 'nlat', 'nlon')} "
    f"WHEN plat IS NOT NULL THEN {q.bearing('plat', 'plon', 'lat', 'lon')} ELSE 0e0 END AS hd FROM n), "
    f"e AS (SELECT storm_id, fhr, {q.dest_lat('lat', '(hd-90)', 'err')} AS left_lat, "
    f"{q.dest_lon('lat', 'lon', '(hd-90)', 'err')} AS left_lon, {q.dest_lat('lat', '(hd+90)', 'err')} AS right_lat, "
    f"{q.dest_lon('lat', 'lon', '(hd+90)', 'err')} AS right_lon FROM h)"
)


def edges(spark, sf, hot=None):
    fc = forecast_points(spark, sf)
    return tracks.cone_edges(fc.withColumn("cone_error_km", classify.cone_error(F.col("fhr"))), hot=hot)


@query(
    "cone_edges",
    f"{EDGES_SQL} SELECT storm_id, fhr, ROUND(left_lat,6) AS left_lat, ROUND(left_lon,6) AS left_lon, "
    "ROUND(right_lat,6) AS right_lat, ROUND(right_lon,6) AS right_lon FROM e",
)
def _(spark, sf):
    cols = ["left_lat", "left_lon", "right_lat", "right_lon"]
    return rounded(edges(spark, sf).select("storm_id", "fhr", *cols), *cols)


@query(
    "cone_polygon",
    f"{EDGES_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY storm_id ORDER BY fhr) AS i, "
    "count(*) OVER (PARTITION BY storm_id) AS n FROM e) SELECT storm_id, i AS ring_seq, ROUND(left_lat,6) AS lat, "
    "ROUND(left_lon,6) AS lon FROM p UNION ALL SELECT storm_id, 2*n+1-i, ROUND(right_lat,6), ROUND(right_lon,6) FROM p",
)
def _(spark, sf):
    hot = hot_keys(forecast_points(spark, sf), ["storm_id"])
    return rounded(tracks.cone_ring(edges(spark, sf, hot), hot=hot), "lat", "lon")


@query(
    "forecast_columns",
    f"WITH {FORECAST_SQL} SELECT storm_id, CAST(0 AS INT) AS part, string_agg(fhr, ',' ORDER BY fhr) AS fhr, "
    "string_agg(CAST(ROUND(lat*100) AS BIGINT), ',' ORDER BY fhr) AS lat, "
    "string_agg(CAST(ROUND(lon*100) AS BIGINT), ',' ORDER BY fhr) AS lon FROM fc GROUP BY 1",
)
def _(spark, sf):
    cols = tracks.forecast_columns(forecast_points(spark, sf))
    cents = lambda c: F.array_join(F.transform(c, lambda x: F.round(x * 100).cast("long").cast("string")), ",")
    return cols.select(
        "storm_id", "part",
        F.array_join(F.transform("forecast.fhr", lambda x: x.cast("string")), ",").alias("fhr"),
        cents("forecast.lat").alias("lat"), cents("forecast.lon").alias("lon"),
    )


@query(
    "best_track_speed",
    f"{WITH_PREV}, z AS (SELECT *, row_number() OVER (PARTITION BY storm_id ORDER BY advisory_time DESC, seq DESC) "
    f"AS rn FROM l) SELECT storm_id, ROUND(CASE WHEN {q.hours('pt', 'advisory_time')}>0 THEN "
    f"{q.hav(*LEG)}/{q.hours('pt', 'advisory_time')} END,6) AS speed_kmh FROM z WHERE rn=1 AND pt IS NOT NULL",
)
def _(spark, sf):
    return rounded(tracks.last_leg_speed(track(spark, sf)), "speed_kmh")


@query(
    "sort_track",
    f"WITH {TRACK_SQL} SELECT storm_id, seq, row_number() OVER (PARTITION BY storm_id ORDER BY advisory_time, seq) "
    "AS pos FROM track",
)
def _(spark, sf):
    return tracks.along(track(spark, sf), {"pos": position()}).select("storm_id", "seq", "pos")


@query(
    "union_observed_forecast",
    f"WITH {TRACK_SQL}, {FORECAST_SQL} SELECT storm_id, lat, lon, 'observed' AS kind FROM track WHERE type<>'forecast' "
    "UNION ALL SELECT storm_id, lat, lon, 'forecast' FROM fc",
)
def _(spark, sf):
    seen = track(spark, sf).filter("type <> 'forecast'").select("storm_id", "lat", "lon", F.lit("observed").alias("kind"))
    ahead = forecast_points(spark, sf).withColumn("kind", F.lit("forecast"))
    both = seen.unionByName(ahead, allowMissingColumns=True)
    return both.select("storm_id", "lat", "lon", "kind")


@query(
    "basin_route",
    f"WITH {TRACK_SQL} SELECT seq, CASE WHEN basin IN ('NA','EP') THEN 'NHC' ELSE 'JMA' END AS agency, "
    "CASE WHEN basin='WP' THEN 'GFS' END AS field_source FROM track",
)
def _(spark, sf):
    return tracks.basin_route(track(spark, sf)).select("seq", "agency", "field_source")


# --- merging ----------------------------------------------------------------------

DEDUPED = (
    "u AS (SELECT * FROM batches QUALIFY row_number() OVER (PARTITION BY storm_id, advisory_time, "
    "round_even(lat,4), round_even(lon,4) ORDER BY {batch} DESC, seq DESC)=1)"
)


@query("dedupe_track", f"WITH {BATCHES_SQL}, {DEDUPED.format(batch='batch_seq')} SELECT storm_id, seq, batch_seq, wind_kts FROM u")
def _(spark, sf):
    both = views.stored_points(spark, sf).withColumn("batch_seq", F.lit(0)).unionByName(
        views.arrived_points(spark, sf).withColumn("batch_seq", F.lit(1))
    )
    return tracks.dedupe_track(both).select("storm_id", "seq", "batch_seq", "wind_kts")


def folded_sql(batch: str, source: str = BATCHES_SQL) -> str:
    return (
        f"WITH {source}, {DEDUPED.format(batch=batch)}, t AS (SELECT *, max({batch}) OVER (PARTITION BY storm_id) AS lb FROM u), "
        f"k AS (SELECT * EXCLUDE (type), CASE WHEN type='current' AND {batch}<lb THEN 'past' ELSE type END AS type FROM t "
        f"WHERE type<>'forecast' OR {batch}=lb), "
        "c AS (SELECT *, max(CASE WHEN type='current' THEN advisory_time END) OVER (PARTITION BY storm_id) AS ct, "
        "lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(advisory_time) OVER w AS pt FROM k "
        "WINDOW w AS (PARTITION BY storm_id ORDER BY advisory_time, seq)), "
        "d AS (SELECT * EXCLUDE (type), CASE WHEN type='current' AND advisory_time<ct THEN 'past' ELSE type END AS type FROM c) "
        f"SELECT {ENRICHED} FROM d"
    )


@query("merge_track", folded_sql("batch_seq"))
def _(spark, sf):
    merged = tracks.merge_track(views.stored_points(spark, sf), views.arrived_points(spark, sf))
    return enriched_columns(merged)


# --- documents ---------------------------------------------------------------------


@query(
    "scan_storm_columns",
    "SELECT CAST(floor(event_id/16) AS BIGINT) AS id, CAST(row_number() OVER (PARTITION BY floor(event_id/16) ORDER BY "
    "event_id)-1 AS INT) AS pos, epoch_us(ts) AS time, value AS vmax, event_type AS type FROM events",
)
def storm_columns_rows(spark, sf):
    rows = documents.array_rows(storm_columns(spark, sf), ["time", "vmax", "type"])
    return rows.select("id", "pos", micros("time"), "vmax", "type")


def storm_columns(spark, sf):
    """Parallel arrays of sixteen events each."""
    items = F.array_sort(F.collect_list(F.struct("event_id", F.col("ts").cast("timestamp").alias("time"), F.col("value").alias("vmax"), F.col("event_type").alias("type"))))
    return (
        table(spark, sf, "events")
        .groupBy(F.floor(F.col("event_id") / 16).cast("long").alias("id")).agg(items.alias("_i"))
        .select("id", *[F.col(f"_i.{c}").alias(c) for c in ("time", "vmax", "type")])
    )


@query(
    "preview_n",
    "WITH g AS (SELECT CAST(floor(event_id/16) AS BIGINT) AS id, event_id, event_type, row_number() OVER "
    "(PARTITION BY floor(event_id/16) ORDER BY event_id) AS i FROM events) SELECT id, CAST(count(*) AS INT) AS type_len, "
    "string_agg(event_type, ',' ORDER BY i) FILTER (i<=5) AS type FROM g GROUP BY 1",
)
def _(spark, sf):
    shown = documents.preview(storm_columns(spark, sf).select("id", "type"), ["type"])
    return shown.select("id", "type_len", F.array_join("type", ",").alias("type"))


DOC_SQL = (
    "{enriched} SELECT CAST(storm_id AS VARCHAR) AS storm_id, advisory_time//1000000*1000000 AS advisory_time, type, "
    "wind_kmh, direction, forward_speed, icon_tag, cone_radius_km FROM doc"
)
DOC_ENRICHED = (
    f"{WITH_PREV}, e AS (SELECT *, min(CASE WHEN type='current' THEN advisory_time END) "
    f"OVER (PARTITION BY storm_id) AS ct FROM l), doc AS (SELECT {ENRICHED} FROM e)"
)


def doc_rows(points: DataFrame) -> DataFrame:
    return points.select(
        "storm_id", micros("advisory_time"), "type", "wind_kmh", "direction",
        "forward_speed", "icon_tag", "cone_radius_km",
    )


@query("storm_document", DOC_SQL.format(enriched=DOC_ENRICHED))
def _(spark, sf):
    docs = sinks.storm_documents(tracks.enrich_track(track(spark, sf)))
    return doc_rows(documents.storm_doc_points(docs))


@query("sink_storm_doc", DOC_SQL.format(enriched=DOC_ENRICHED))
def _(spark, sf):
    """Documents put in place of earlier ones of the same storms, then read again."""
    docs = sinks.storm_documents(tracks.enrich_track(track(spark, sf)))
    path = scratch_dir(spark, "storm-docs")
    sinks.replace_storm_docs(docs, path)
    return doc_rows(documents.storm_doc_points(sinks.read_documents(spark, path, documents.STORM_DOC_KEYED)))


@query(
    "scan_storm_doc",
    f"WITH {TRACK_SQL} SELECT CAST(storm_id AS VARCHAR) AS storm_id, count(*) AS n_points, "
    "CAST(count(*) FILTER (type='past') AS BIGINT) AS n_past, min(epoch_us(advisory_time)//1000000) AS first_s FROM track GROUP BY 1",
)
def _(spark, sf):
    """Documents written in short parts, then read again and counted."""
    path = scratch_dir(spark, "storm-parts")
    sinks.write_json(sinks.storm_documents(tracks.enrich_track(track(spark, sf)), part_rows=20), path)
    points = documents.read_storm_docs(spark, path)
    return points.groupBy("storm_id").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.count_if(F.col("type") == "past").alias("n_past"),
        F.min(F.unix_seconds("advisory_time")).alias("first_s"),
    )
