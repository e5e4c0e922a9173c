"""Queries over bulletins, placemarks, advisories and hourly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe import sinks
from galeframe.functions import text
from galeframe.operators import advisories as adv
from galeframe.operators import grid_stats
from galeframe.operators import placemarks as pm
from galeframe.operators.ordered import hot_keys
from galeframe.plans import sqlkit as q
from galeframe.plans import views
from galeframe.plans.registry import query, r6, rounded
from galeframe.plans.views import (
    ADV_EXT,
    ADV_SQL,
    BULLETIN_SQL,
    ENTRIES_SQL,
    HOURLY_SQL,
    LAT_CENTS,
    LON_CENTS,
    MARKS_SQL,
    ZONE_MINUTES,
    signed_text,
    table,
)
from galeframe.session import checkpointed, scratch_dir
from galeframe.sources import documents, markup, rejects

# --- bulletins and feeds ---------------------------------------------------------


@query(
    "scan_jma_bulletin",
    f"WITH {BULLETIN_SQL} SELECT bulletin, storm_id, storm_name, seq, advisory_s, ROUND(lat,6) AS lat, ROUND(lon,6) AS lon, type, "
    "wind_kts, pressure_hpa FROM bp",
)
def _(spark, sf):
    points = markup.parse_bulletins(views.bulletins(spark, sf))
    return points.select(
        "bulletin", "storm_id", "storm_name", "seq", F.unix_seconds("advisory_time").alias("advisory_s"),
        r6("lat").alias("lat"), r6("lon").alias("lon"), "type", "wind_kts", "pressure_hpa",
    )


# Damage by bulletin: cut off, a tag that does not close, a coordinate with a letter, blank.
DAMAGE = (
    "CASE bulletin%7 WHEN 1 THEN left(xml, length(xml)-20) WHEN 2 THEN replace(xml, '</Body>', '') "
    "WHEN 3 THEN replace(xml, '/</Coordinate>', 'x</Coordinate>') WHEN 4 THEN ' ' ELSE xml END AS xml"
)


@query(
    "bulletin_rejects",
    "WITH e AS (SELECT *, CAST(floor(event_id/6) AS BIGINT) AS bulletin, CAST(event_id%6 AS INT) AS seq FROM events), "
    "d AS (SELECT DISTINCT bulletin FROM e) "
    "SELECT bulletin, CAST(NULL AS INT) AS seq, CASE WHEN bulletin%7=4 THEN 'empty' ELSE 'malformed' END AS reason FROM d WHERE bulletin%7 IN (1, 2, 4) "
    "UNION ALL SELECT bulletin, seq, CASE WHEN event_id%11=5 THEN 'no time' WHEN event_id%7=3 THEN 'no coordinate' ELSE 'coordinate' END FROM e "
    "WHERE bulletin%7 NOT IN (1, 2, 4) AND (event_id%11=5 OR event_id%7=3 OR bulletin%7=3)",
)
def _(spark, sf):
    """What is unusable in bulletins of which some are damaged."""
    damaged = views.bulletins(spark, sf).selectExpr("bulletin", DAMAGE)
    return rejects.bulletins(damaged).rejects.select("bulletin", "seq", "reason")


def escaped(column):
    return F.replace(F.replace(column, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@query(
    "scan_atom_feed",
    f"WITH {ENTRIES_SQL} SELECT CAST(floor(page_id/10) AS BIGINT) AS feed, id, link, updated, title FROM entries",
)
def _(spark, sf):
    """Feeds of ten entries each."""
    entry = F.concat(
        F.lit("<entry><title>"), "title", F.lit("</title><id>"), "id", F.lit('</id><link type="application/xml" href="'),
        escaped(F.col("link")), F.lit('"/><updated> '), "updated", F.lit(" </updated></entry>"),
    )
    rows = views.entries(spark, sf).select(
        "page_id", F.floor(F.col("page_id") / 10).cast("long").alias("feed"), entry.alias("e")
    )
    docs = rows.groupBy("feed").agg(views.joined("page_id", "e").alias("body")).select(
        "feed", F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), "body", F.lit("</feed>")).alias("xml")
    )
    return markup.parse_atom(docs)


RSS_IDS = [*markup.REGIONS, "OTHER", "MORE"]
RSS_ITEM = (
    f"concat('<item><guid isPermaLink=\"false\">', {views.pick(RSS_IDS, 'page_id*7+floor(page_id/10)')}, '</guid><description><![CDATA[', "
    "CASE WHEN page_id%3=0 THEN '<p>No Current Tropical Cyclone Warnings.</p>' ELSE concat('<p><b>Typhoon ', CAST(page_id AS STRING), "
    "' &amp; more</b>\n', '<a href=\"https://x/wp', CAST(page_id AS STRING), '.kmz\">KMZ</a> <a href=\"https://x/wp', CAST(page_id AS STRING), "
    "'web.txt\">TEXT</a></p>') END, ']]></description></item>')"
)


@query(
    "scan_rss_regions",
    f"WITH i AS (SELECT CAST(floor(page_id/10) AS BIGINT) AS feed, page_id, {views.pick(RSS_IDS, 'page_id*7+floor(page_id/10)')} AS guid FROM pages), "
    "f AS (SELECT DISTINCT feed FROM i), r(guid, region) AS (VALUES "
    + ", ".join(f"('{g}', '{n}')" for g, n in markup.REGIONS.items())
    + "), m AS (SELECT feed, guid, min(page_id) AS p FROM i GROUP BY 1, 2) SELECT f.feed, region, CASE WHEN p IS NOT NULL THEN p%3<>0 END AS active, "
    "CASE WHEN p%3<>0 THEN concat('Typhoon ', p, ' & more') END AS title, CASE WHEN p%3<>0 THEN concat('https://x/wp', p, '.kmz') END AS kmz, "
    "CASE WHEN p%3<>0 THEN concat('https://x/wp', p, 'web.txt') END AS txt FROM f CROSS JOIN r LEFT JOIN m USING (feed, guid)",
)
def _(spark, sf):
    """Feeds of ten items; some regions occur twice or not at all."""
    rows = table(spark, sf, "pages").withColumn("feed", F.expr("CAST(floor(page_id/10) AS BIGINT)"))
    docs = rows.groupBy("feed").agg(views.joined("page_id", RSS_ITEM).alias("body")).select(
        "feed", F.concat(F.lit("<rss><channel><pubDate>now</pubDate>"), "body", F.lit("</channel></rss>")).alias("xml")
    )
    return markup.parse_rss_regions(docs).select(
        "feed", "region", "active", "title",
        F.array_join("kmz_links", ",").alias("kmz"), F.array_join("text_links", ",").alias("txt"),
    )


# --- small parsers ----------------------------------------------------------------


@query(
    "parse_jma_coordinate",
    f"SELECT event_id, CASE WHEN event_id%9<>0 THEN {LAT_CENTS}/1e2 END AS lat, CASE WHEN event_id%9<>0 THEN {LON_CENTS}/1e2 END AS lon FROM events",
)
def _(spark, sf):
    coded = f"CASE WHEN event_id%9=0 THEN 'unknown' ELSE concat(' ', {signed_text(LAT_CENTS)}, {signed_text(LON_CENTS)}, '/') END AS c"
    rows = table(spark, sf, "events").selectExpr("event_id", coded)
    c = F.col("c")
    return rows.select("event_id", text.signed_pair_lat(c).alias("lat"), text.signed_pair_lon(c).alias("lon"))


def marks(spark, sf):
    """Placemarks as the parser gives them."""
    return markup.parse_placemarks(views.placemark_files(spark, sf))


@query(
    "parse_coords_list",
    f"WITH {MARKS_SQL}, k(i, a, b) AS (VALUES (0,0,0),(1,100,0),(2,100,100)) SELECT doc_id, turn, i AS pos, "
    "(CAST(ROUND(mark_lat*100) AS BIGINT)+b)/1e2 AS lat, (CAST(ROUND(mark_lon*100) AS BIGINT)+a)/1e2 AS lon FROM pm, k",
)
def _(spark, sf):
    rows = views.mark_columns(spark, sf).select(
        "doc_id", "turn", F.posexplode(text.coordinate_list(F.col("three_coords"))).alias("pos", "c")
    )
    return rows.select("doc_id", "turn", "pos", "c.lat", "c.lon")


@query(
    "parse_html_table",
    f"WITH {MARKS_SQL} SELECT doc_id, turn, concat('N',storm_no) AS name, time_text AS time, wind_text AS wind, CAST(3 AS INT) AS n_keys FROM pm0",
)
def _(spark, sf):
    rows = views.mark_columns(spark, sf).select("doc_id", "turn", text.html_table(F.expr(views.TABLE_HTML)).alias("t"))
    at = lambda k: F.try_element_at("t", F.lit(k))
    return rows.select(
        "doc_id", "turn", at("NAME").alias("name"), at("TIME").alias("time"), at("WIND SPD").alias("wind"), F.size("t").alias("n_keys")
    )


@query(
    "parse_tau_wind",
    f"WITH {MARKS_SQL} SELECT doc_id, turn, CASE WHEN turn%3<>0 THEN CAST(turn*12 AS INT) END AS tau, "
    "CAST(split_part(wind_text,' ',1) AS INT) AS wind_kt FROM pm0",
)
def _(spark, sf):
    return views.mark_columns(spark, sf).select(
        "doc_id", "turn",
        text.tau_hours(F.lower("time_text")).alias("tau"), text.wind_knots(F.col("wind_text")).alias("wind_kt"),
    )


@query(
    "parse_best_track_time",
    f"WITH {MARKS_SQL} SELECT doc_id, turn, CASE WHEN turn%2=0 THEN epoch_us(strptime(concat('20',name),'%Y%m%d%HZ')) END AS best_us FROM pm0",
)
def _(spark, sf):
    return views.mark_columns(spark, sf).select(
        "doc_id", "turn", F.unix_micros(text.best_track_time(F.col("name"))).alias("best_us")
    )


ADV_TIME = (
    "concat(CAST(CASE WHEN event_id%12=0 THEN 12 ELSE event_id%12 END AS STRING), CASE WHEN event_id%2=0 THEN ':' ELSE '' END, "
    "lpad(CAST(event_id%60 AS STRING),2,'0'), CASE WHEN event_id%3=0 THEN ' AM' ELSE ' PM' END, "
    "CASE event_id%4 WHEN 0 THEN ' UTC' WHEN 1 THEN ' GMT' WHEN 2 THEN '' ELSE ' AST' END, ' Sun Apr ', lpad(CAST(1+event_id%28 AS STRING),2,'0'), ' 2026')"
)


@query(
    "parse_advisory_time",
    "SELECT event_id, CASE WHEN event_id%4<>3 THEN epoch_us(TIMESTAMP '2026-04-01')+(event_id%28)*86400000000"
    "+((event_id%12)+CASE WHEN event_id%3=0 THEN 0 ELSE 12 END)*3600000000+(event_id%60)*60000000 END AS at_us FROM events",
)
def _(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", f"{ADV_TIME} AS t")
    return rows.select("event_id", F.unix_micros(text.advisory_time(F.col("t"))).alias("at_us"))


@query(
    "to_int_default",
    "SELECT event_id, CAST(CASE WHEN event_id%3=0 THEN event_id%1000 ELSE -1 END AS INT) AS n FROM events",
)
def _(spark, sf):
    mixed = "CASE event_id%3 WHEN 0 THEN concat(' ', CAST(event_id%1000 AS STRING)) WHEN 1 THEN 'x1' ELSE NULL END AS t"
    rows = table(spark, sf, "events").selectExpr("event_id", mixed)
    return rows.select("event_id", text.int_or(F.col("t"), -1).alias("n"))


# --- placemarks -----------------------------------------------------------------------


@query(
    "scan_placemarks",
    f"WITH {MARKS_SQL} SELECT doc_id, seq, folder, name, style, geometry, CAST(CASE WHEN geometry='Point' THEN 1 ELSE 3 END AS INT) AS n_coords, "
    "CASE WHEN geometry='Point' THEN mark_lat END AS lat, CASE WHEN geometry='Point' THEN mark_lon END AS lon, time_text AS time FROM pm",
)
def _(spark, sf):
    return marks(spark, sf).select(
        "doc_id", "seq", "folder", "name", "style", "geometry", F.size("coords").alias("n_coords"), "lat", "lon",
        F.try_element_at("table", F.lit("TIME")).alias("time"),
    )


ROLE_SQL = (
    "ro AS (SELECT *, CASE WHEN folder='Forecast' AND geometry='Point' THEN 'forecast_point' WHEN folder LIKE 'Prev%' AND geometry='Point' THEN 'best_point' "
    "WHEN folder='Forecast' AND geometry='LineString' THEN 'forecast_line' WHEN geometry='LineString' THEN 'best_line' "
    "WHEN style='#WindRadii34' THEN 'radius_34' WHEN style='#WindRadii50' THEN 'radius_50' WHEN style='#msn_ylw-pushpin' THEN 'danger_swath' END AS role, "
    "CASE WHEN turn%3<>0 THEN CAST(turn*12 AS INT) END AS tau FROM pm)"
)


def roles(spark, sf):
    return pm.with_warning_values(pm.with_role(marks(spark, sf)))


@query("placemark_selectors", f"WITH {MARKS_SQL}, {ROLE_SQL} SELECT doc_id, seq, role FROM ro WHERE role IS NOT NULL")
def _(spark, sf):
    return pm.with_role(marks(spark, sf)).filter("role IS NOT NULL").select("doc_id", "seq", "role")


@query(
    "sort_forecast_points",
    f"WITH {MARKS_SQL}, {ROLE_SQL} SELECT doc_id, seq, 'forecast' AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(tau,9999), name, seq) AS pos "
    "FROM ro WHERE role='forecast_point' UNION ALL SELECT doc_id, seq, 'best', row_number() OVER (PARTITION BY doc_id ORDER BY "
    "CASE WHEN turn%2=0 THEN name END NULLS LAST, seq) FROM ro WHERE role='best_point'",
)
def _(spark, sf):
    every = roles(spark, sf)
    ahead = pm.forecast_order(every.filter("role = 'forecast_point'")).withColumn("kind", F.lit("forecast"))
    best = pm.best_track_order(every.filter("role = 'best_point'")).withColumn("kind", F.lit("best"))
    return ahead.unionByName(best).select("doc_id", "seq", "kind", "pos")


@query(
    "count_by_attr",
    f"WITH {MARKS_SQL}, s AS (SELECT style AS value, count(*) AS n, min((doc_id,seq)) AS f FROM pm WHERE style<>'' GROUP BY 1 ORDER BY n DESC, f LIMIT 10) "
    "SELECT 'folder' AS attribute, CASE WHEN folder='' THEN '(root)' ELSE folder END AS value, count(*) AS n FROM pm GROUP BY 2 "
    "UNION ALL SELECT 'geometry', geometry, count(*) FROM pm GROUP BY 2 UNION ALL SELECT 'style', value, n FROM s",
)
def _(spark, sf):
    every = marks(spark, sf).select("doc_id", "seq", "folder", "geometry", "style")
    parts = [
        pm.count_by(every, "folder", "(root)").withColumn("attribute", F.lit("folder")),
        pm.count_by(every, "geometry").withColumn("attribute", F.lit("geometry")),
        pm.count_by(every, "style", top=10).withColumn("attribute", F.lit("style")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("attribute", "value", "n")


@query(
    "field_profile",
    f"WITH {MARKS_SQL}, t AS (SELECT 'NAME' AS key, concat('N',storm_no) AS value FROM pm UNION ALL SELECT 'TIME', time_text FROM pm "
    "UNION ALL SELECT 'WIND SPD', wind_text FROM pm), d AS (SELECT key, count(*) AS occurrences, count(DISTINCT value) AS n_values, "
    "list_sort(list_distinct(list(value))) AS vs FROM t GROUP BY 1) SELECT key, occurrences, n_values, "
    "concat(array_to_string(vs[1:3],', '), CASE WHEN n_values>3 THEN concat(' ...(+',n_values-3,')') ELSE '' END) AS preview FROM d",
)
def _(spark, sf):
    return pm.field_profile(marks(spark, sf))


@query(
    "track_line",
    f"WITH {MARKS_SQL}, {ROLE_SQL}, l AS (SELECT doc_id, min_by(mark_lat,seq) AS la, min_by(mark_lon,seq) AS lo FROM ro WHERE role='forecast_line' GROUP BY 1), "
    "k(i, a, b) AS (VALUES (1,0,0),(2,100,0),(3,100,100)), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(tau,9999), name, seq) AS pos, "
    "count(*) OVER (PARTITION BY doc_id) AS n FROM ro WHERE role='forecast_point') SELECT doc_id, CAST(i AS BIGINT) AS pos, "
    "(CAST(ROUND(la*100) AS BIGINT)+b)/1e2 AS lat, (CAST(ROUND(lo*100) AS BIGINT)+a)/1e2 AS lon FROM l, k "
    "UNION ALL SELECT doc_id, pos, mark_lat, mark_lon FROM p WHERE n>=2 AND doc_id NOT IN (SELECT doc_id FROM l)",
)
def _(spark, sf):
    every = roles(spark, sf)
    points = pm.forecast_order(every.filter("role = 'forecast_point'"))
    return pm.track_line(every.filter("role = 'forecast_line'"), points)


# --- advisories ---------------------------------------------------------------------------


@query(
    "scan_nhc_track",
    f"WITH {ADV_SQL} SELECT storm_id, adv, seq, CASE WHEN seq=5 THEN 'line' ELSE 'point' END AS kind, CASE WHEN seq<5 THEN lat END AS lat, "
    'CASE WHEN seq<5 THEN lon END AS lon, coalesce(fcstpd,\'\') AS fcstpd, coalesce("stormName",\'\') AS storm_name, '
    f"CAST({len(ADV_EXT)} AS INT) AS n_ext FROM adv",
)
def _(spark, sf):
    rows = markup.parse_advisory_tracks(views.advisory_files(spark, sf))
    return rows.select(
        "storm_id", "adv", "seq", "kind", "lat", "lon", F.col("ext")["fcstpd"].alias("fcstpd"),
        F.col("ext")["stormName"].alias("storm_name"), F.size("ext").alias("n_ext"),
    )


@query("scan_nhc_cone", f"WITH {ADV_SQL} SELECT storm_id, adv, seq AS ring_seq, lat, lon FROM adv")
def _(spark, sf):
    return markup.parse_cones(views.cone_files(spark, sf))


IMPUTED_SQL = (
    f"{ADV_SQL}, px AS (SELECT storm_id, adv, max(coalesce(TRY_CAST(fcstpd AS INT),0)) AS mx FROM al GROUP BY 1, 2), "
    "im AS (SELECT ap.*, row_number() OVER w-1 AS i, count(*) OVER (PARTITION BY storm_id, adv) AS n FROM ap WINDOW w AS (PARTITION BY storm_id, adv ORDER BY seq)), "
    "hh AS (SELECT im.*, CAST(CASE WHEN coalesce(TRY_CAST(fcstpd AS INT),-1)>=0 THEN TRY_CAST(fcstpd AS INT) WHEN i=0 THEN 0 "
    "WHEN coalesce(mx,0)>0 AND n>1 THEN round_even(mx*i/((n-1)*1e0),0) ELSE i*6 END AS INT) AS hour FROM im LEFT JOIN px USING (storm_id, adv))"
)


@query("forecast_hour_impute", f"WITH {IMPUTED_SQL} SELECT storm_id, adv, seq, hour FROM hh")
def _(spark, sf):
    points, lines = views.advisory_rows(spark, sf)
    return adv.impute_hours(points, lines).select("storm_id", "adv", "seq", "hour")


FILLED_SQL = (
    f"{IMPUTED_SQL}, fl AS (SELECT hh.storm_id, hh.adv, hh.seq, hh.hour, hh.lat, hh.lon, "
    "coalesce(hh.\"stormName\",al.\"stormName\",'') AS storm_name, coalesce(hh.\"stormType\",al.\"stormType\",'') AS storm_type, "
    "coalesce(hh.\"advisoryDate\",al.\"advisoryDate\",'') AS adv_time, coalesce(hh.\"maxWindKnots\",al.\"maxWindKnots\",'') AS wind_kt, "
    "coalesce(hh.\"stormMovement\",al.\"stormMovement\",'') AS movement, coalesce(hh.\"minimumPressureMb\",al.\"minimumPressureMb\",'') AS pressure_mb, "
    "coalesce(hh.\"advisoryNum\",al.\"advisoryNum\",'') AS advisory_num FROM hh LEFT JOIN al ON hh.storm_id=al.storm_id AND hh.adv=al.adv)"
)


def filled(spark, sf):
    return adv.advisory_points(*views.advisory_rows(spark, sf))


@query(
    "metadata_fill",
    f"WITH {FILLED_SQL} SELECT storm_id, adv, seq, storm_name, storm_type, adv_time, wind_kt, movement, pressure_mb, advisory_num FROM fl",
)
def _(spark, sf):
    return filled(spark, sf).select(
        "storm_id", "adv", "seq", "storm_name", "storm_type", "adv_time", "wind_kt", "movement", "pressure_mb", "advisory_num"
    )


@query(
    "best_metadata",
    "WITH e AS (SELECT *, CAST(floor(event_id/6) AS BIGINT) AS g, CASE WHEN event_id%2=0 THEN 1 ELSE 0 END"
    "+CASE WHEN event_id%3=0 THEN 1 ELSE 0 END AS filled FROM events) SELECT g AS storm_id, arg_max(CAST(event_id AS VARCHAR),(filled,-event_id)) AS best_id, "
    "CAST(max(CASE WHEN event_id%3=0 THEN event_id%120 ELSE 0 END) AS INT) AS max_fcstpd FROM e GROUP BY 1",
)
def _(spark, sf):
    """Six metadata maps per advisory that differ in how much they hold."""
    lines = table(spark, sf, "events").selectExpr(
        "CAST(floor(event_id/6) AS BIGINT) AS storm_id", "0 AS adv", "event_id AS seq",
        "map('id', CAST(event_id AS STRING), 'a', CASE WHEN event_id%2=0 THEN 'x' ELSE ' ' END, "
        "'fcstpd', CASE WHEN event_id%3=0 THEN CAST(event_id%120 AS STRING) ELSE '' END) AS ext",
    )
    return adv.best_metadata(lines).select("storm_id", F.col("best")["id"].alias("best_id"), "max_fcstpd")


INITIAL_SQL = (
    f"{FILLED_SQL}, it AS (SELECT * FROM fl QUALIFY row_number() OVER (PARTITION BY storm_id, adv ORDER BY hour<>0, hour, seq)=1)"
)


@query("initial_point", f"WITH {INITIAL_SQL} SELECT storm_id, adv, seq, hour, lat, lon FROM it")
def _(spark, sf):
    return adv.initial_points(filled(spark, sf)).select("storm_id", "adv", "seq", "hour", "lat", "lon")


@query(
    "latest_advisory",
    f"WITH {ADV_SQL} SELECT storm_id, adv, seq, lat, lon FROM ap WHERE (storm_id, adv) IN (SELECT storm_id, max(adv) FROM ap GROUP BY 1)",
)
def _(spark, sf):
    points, _ = views.advisory_rows(spark, sf)
    return adv.latest_advisory(points).select("storm_id", "adv", "seq", "lat", "lon")


@query("history_path", f"WITH {INITIAL_SQL} SELECT storm_id, row_number() OVER (PARTITION BY storm_id ORDER BY adv) AS pos, adv, lat, lon FROM it")
def _(spark, sf):
    return adv.history_path(adv.initial_points(filled(spark, sf)), storm_sizes(spark, sf))


PARSED_TIME = (
    "CASE WHEN adv_time LIKE '%UTC%' THEN strptime(concat(CASE WHEN adv_time LIKE '500%' THEN '05' ELSE '23' END, regexp_extract(adv_time,'Apr (\\d+)',1)),'%H%d') END"
)
MOVE_SQL = (
    f"{INITIAL_SQL}, mv AS (SELECT *, {PARSED_TIME} AS t, row_number() OVER (PARTITION BY storm_id ORDER BY adv DESC) AS rn FROM it), "
    "m2 AS (SELECT *, lead(lat) OVER w AS plat, lead(lon) OVER w AS plon, lead(t) OVER w AS tp FROM mv WINDOW w AS (PARTITION BY storm_id ORDER BY adv DESC)), "
    f"m3 AS (SELECT storm_id, adv, movement, plat, {q.hav('plat', 'plon', 'lat', 'lon')}/CASE WHEN tp IS NULL OR t IS NULL THEN 6e0 "
    f"ELSE greatest((epoch_us(t)-epoch_us(tp))/3.6e9,0.1e0) END AS speed, {q.bearing('plat', 'plon', 'lat', 'lon')} AS brg FROM m2 WHERE rn=1), "
    f"mo AS (SELECT storm_id, adv, CASE WHEN plat IS NOT NULL THEN speed END AS speed_kmh, CASE WHEN plat IS NOT NULL THEN brg END AS bearing, "
    f"CASE WHEN movement<>'' THEN movement WHEN plat IS NOT NULL THEN {q.compass('brg')} ELSE 'N/A' END AS direction FROM m3)"
)


def storm_sizes(spark, sf):
    """Size check by storm on the raw points, which outnumber the advisories."""
    return hot_keys(views.advisory_rows(spark, sf)[0], ["storm_id"])


def movement(spark, sf):
    return adv.advisory_movement(adv.initial_points(filled(spark, sf)), storm_sizes(spark, sf))


@query("advisory_movement", f"WITH {MOVE_SQL} SELECT storm_id, adv, ROUND(speed_kmh,6) AS speed_kmh, ROUND(bearing,6) AS bearing, direction FROM mo")
def _(spark, sf):
    return rounded(movement(spark, sf), "speed_kmh", "bearing")


@query(
    "storm_summary",
    f"WITH {MOVE_SQL}, c AS (SELECT storm_id, adv, count(*) AS forecast_points FROM ap GROUP BY 1, 2), "
    "h AS (SELECT storm_id, count(*) AS history_advisories FROM it GROUP BY 1) SELECT storm_id, coalesce(nullif(storm_name,''),'N/A') AS storm_name, "
    "coalesce(nullif(storm_type,''),'N/A') AS storm_type, coalesce(nullif(advisory_num,''),CAST(adv AS VARCHAR)) AS advisory, "
    "coalesce(nullif(adv_time,''),'N/A') AS adv_time, direction, CASE WHEN speed_kmh IS NULL THEN 'N/A' ELSE printf('%.1f km/h',speed_kmh) END AS speed, "
    "coalesce(nullif(wind_kt,''),'N/A') AS wind_kt, coalesce(nullif(pressure_mb,''),'N/A') AS pressure_mb, forecast_points, history_advisories "
    "FROM mv JOIN mo USING (storm_id, adv) JOIN c USING (storm_id, adv) JOIN h USING (storm_id) WHERE rn=1",
)
def _(spark, sf):
    points, _ = views.advisory_rows(spark, sf)
    # Four parts of the summary read the initial points, so they are computed once.
    initials = checkpointed(adv.initial_points(filled(spark, sf)))
    moved = adv.advisory_movement(initials, storm_sizes(spark, sf))
    return adv.storm_summary(points, initials, moved)


@query(
    "track_file_profile",
    f"WITH {ADV_SQL} SELECT storm_id, adv, count(*) FILTER (seq<5) AS point_count, coalesce(max(CASE WHEN seq=5 THEN fcstpd END),'') AS line_fcstpd, "
    'max(CASE WHEN seq=5 THEN "stormName" END) AS sample_name FROM adv GROUP BY 1, 2',
)
def _(spark, sf):
    points, lines = views.advisory_rows(spark, sf)
    # The last advisory of the table may be cut short before its line, which has the sample.
    return adv.track_profile(points, lines).select(
        "storm_id", "adv", "point_count", "line_fcstpd", F.col("sample")["stormName"].alias("sample_name")
    )


FILE_KEYS = [
    "CAST(floor(event_id/60) AS BIGINT) AS storm_id",
    "CAST(floor(event_id/6)%10+1 AS INT) AS adv",
    "CASE WHEN event_id%6=0 THEN 'track' WHEN event_id%6<=2 AND CAST(floor(event_id/6)%10+1 AS INT)%3<>0 THEN 'cone' "
    "WHEN event_id%6 IN (3,4) AND CAST(floor(event_id/6)%10+1 AS INT)%4<>0 THEN 'five' ELSE 'other' END AS kind",
]
FILE_NAME = "concat('f', lpad(CAST(event_id AS STRING), 9, '0'))"


@query(
    "track_cone_file_join",
    f"WITH f AS (SELECT {', '.join(FILE_KEYS)}, {FILE_NAME} AS file FROM events), t AS (SELECT storm_id, adv, file AS track_file FROM f WHERE kind='track'), "
    "c AS (SELECT storm_id, adv, max(file) AS cone_last, min(file) AS cone_first FROM f WHERE kind='cone' GROUP BY 1, 2), "
    "z AS (SELECT storm_id, adv, min(file) AS five_day_file FROM f WHERE kind='five' GROUP BY 1, 2), "
    "o AS (SELECT storm_id, adv, count(*) AS other_files FROM f WHERE kind='other' GROUP BY 1, 2) "
    "SELECT storm_id, adv, track_file, cone_last, cone_first, five_day_file, coalesce(other_files,0) AS other_files FROM t LEFT JOIN c USING (storm_id, adv) "
    "LEFT JOIN z USING (storm_id, adv) LEFT JOIN o USING (storm_id, adv)",
)
def _(spark, sf):
    rows = table(spark, sf, "events").selectExpr(*FILE_KEYS, f"{FILE_NAME} AS file")
    tracks = rows.filter("kind = 'track'").select("storm_id", "adv", F.col("file").alias("track_file"))
    cones, five = rows.filter("kind = 'cone'"), rows.filter("kind = 'five'")
    others = rows.filter("kind = 'other'").groupBy("storm_id", "adv").agg(F.count(F.lit(1)).alias("other_files"))
    last = adv.pair_files(tracks, cones, five, "last").withColumnRenamed("cone_file", "cone_last")
    first = adv.pair_files(tracks, cones, five, "first").select("storm_id", "adv", F.col("cone_file").alias("cone_first"))
    paired = last.join(first, ["storm_id", "adv"]).join(others, ["storm_id", "adv"], "left")
    return paired.withColumn("other_files", F.coalesce("other_files", F.lit(0)))


# --- hourly series ------------------------------------------------------------------------

OFFSETS = "CAST(CASE tz " + " ".join(f"WHEN '{z}' THEN {m}" for z, m in ZONE_MINUTES.items()) + " END AS BIGINT)"
ISO_LOCAL = (
    f"concat(strftime(make_timestamp(t_us+{OFFSETS}*60000000),'%Y-%m-%dT%H:%M:%S'), '+', lpad(CAST({OFFSETS}//60 AS VARCHAR),2,'0'), ':', "
    f"lpad(CAST({OFFSETS}%60 AS VARCHAR),2,'0'))"
)


def hourly_rows(spark, sf):
    return documents.hourly_rows(views.hourly(spark, sf), ["temperature_2m", "precipitation"])


@query(
    "hourly_index",
    f"WITH {HOURLY_SQL} SELECT location_id, t_us AS utc_us, t_us+{OFFSETS}*60000000 AS local_us FROM hr",
)
def _(spark, sf):
    return hourly_rows(spark, sf).select(
        "location_id", F.unix_micros("time_utc").alias("utc_us"), F.unix_micros("time_local").alias("local_us")
    )


@query(
    "scan_hourly_vectors",
    f"WITH {HOURLY_SQL} SELECT location_id, t_us, temperature_2m, precipitation FROM hr",
)
def _(spark, sf):
    rows = hourly_rows(spark, sf)
    value = F.nanvl("precipitation", F.lit(None).cast("double"))
    return rows.select("location_id", F.unix_micros("time_utc").alias("t_us"), "temperature_2m", value.alias("precipitation"))


@query(
    "iso_format",
    f"WITH {HOURLY_SQL} SELECT location_id, {ISO_LOCAL} AS iso_local, concat(strftime(make_timestamp(t_us),'%Y-%m-%dT%H:%M:%S'),'+00:00') AS iso_utc FROM hr",
)
def _(spark, sf):
    return documents.with_iso_times(hourly_rows(spark, sf)).select("location_id", "iso_local", "iso_utc")


PAYLOAD_SQL = (
    f"WITH {HOURLY_SQL}, n AS (SELECT location_id, count(*) AS k FROM hr GROUP BY 1) SELECT location_id, k AS count, tz AS timezone, "
    f"{ISO_LOCAL} AS date_local, temperature_2m, precipitation FROM hr JOIN n USING (location_id)"
)
PAYLOAD = (
    "location_id bigint, part int, source string, timezone string, count bigint, fields array<string>, "
    "values array<struct<date_local:string,date_utc:string,temperature_2m:double,precipitation:double>>"
)


def payloads(spark, sf):
    return sinks.series_payloads(hourly_rows(spark, sf), ["location_id"], ["temperature_2m", "precipitation"])


def payload_rows(docs):
    return docs.select("location_id", "count", "timezone", F.explode("values").alias("v")).select(
        "location_id", "count", "timezone", "v.date_local", "v.temperature_2m", "v.precipitation"
    )


@query("series_payload", PAYLOAD_SQL)
def _(spark, sf):
    as_text = payloads(spark, sf).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
    return payload_rows(as_text.select(F.from_json("json", PAYLOAD).alias("d")).select("d.*"))


@query("sink_series_payload", PAYLOAD_SQL)
def _(spark, sf):
    path = scratch_dir(spark, "series")
    sinks.write_json(payloads(spark, sf), path)
    return payload_rows(spark.read.schema(PAYLOAD).json(path))


@query(
    "placemark_bbox",
    f"WITH {MARKS_SQL} SELECT doc_id, min(mark_lat) AS south, max(CASE WHEN geometry='Point' THEN mark_lat ELSE (CAST(ROUND(mark_lat*100) AS BIGINT)+100)/1e2 END) AS north, "
    "min(mark_lon) AS west, max(CASE WHEN geometry='Point' THEN mark_lon ELSE (CAST(ROUND(mark_lon*100) AS BIGINT)+100)/1e2 END) AS east FROM pm GROUP BY 1",
)
def _(spark, sf):
    """Box around all points, lines and polygons of a file."""
    return grid_stats.bounds_center(pm.all_coordinates(marks(spark, sf)), ["doc_id"]).drop("center_lat", "center_lon")
