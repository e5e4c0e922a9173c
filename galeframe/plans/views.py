"""Weather views over the given tables, for Spark and as SQL text.

``events`` are seen as storm points, ``lineitem`` as grid cells and files, ``part``
as index lines, ``pages`` as feed entries, ``conversations`` as placemarks and
``supplier`` and ``orders`` as runs asked for.  Expressions that read the same in
both dialects are shared as text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.session import checkpointed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(columns: list[str], source: str, where: str = "") -> str:
    return f"SELECT {', '.join(columns)} FROM {source}" + (f" WHERE {where}" if where else "")


# --- storm points ---------------------------------------------------------------

CUTOFF = "2024-01-16 00:00:00"


def _type_at(cutoff: str) -> str:
    day = cutoff[:10]
    half = f"{day[:8]}{int(day[8:]) - 1:02d} 12:00:00"
    return (
        f"CASE WHEN ts < TIMESTAMP '{half}' THEN 'past' "
        f"WHEN ts <= TIMESTAMP '{cutoff}' THEN 'current' ELSE 'forecast' END AS type"
    )


POINT = [
    "user_id AS storm_id",
    "event_id AS seq",
    "CAST(ts AS TIMESTAMP) AS advisory_time",
    "((event_id*37)%12000)/1e2-60 AS lat",
    "((event_id*91)%36000)/1e2-180 AS lon",
    "CASE WHEN event_id%13=0 THEN NULL ELSE value*2 END AS wind_kts",
    "1010-value/5 AS pressure_hpa",
    "concat('S', CAST(user_id%40 AS STRING)) AS storm_name",
    "CASE WHEN user_id%3=0 THEN 'NA' WHEN user_id%3=1 THEN 'EP' ELSE 'WP' END AS basin",
    "event_type",
]
TRACK = POINT + [_type_at(CUTOFF)]
TRACK_SQL = f"track AS ({_select(TRACK, 'events')})"


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*TRACK)


STORED_CUTOFF = "2024-01-11 00:00:00"
STORED = POINT + [_type_at(STORED_CUTOFF), f"CAST(TIMESTAMP '{STORED_CUTOFF}' AS TIMESTAMP) AS issue_time"]
ARRIVED = [c if "AS wind_kts" not in c else "value*2+5 AS wind_kts" for c in POINT] + [
    _type_at(CUTOFF),
    f"CAST(TIMESTAMP '{CUTOFF}' AS TIMESTAMP) AS issue_time",
]
STORED_WHERE = "event_type IN ('view', 'click', 'signup')"
ARRIVED_WHERE = "event_type IN ('purchase', 'click', 'error')"
BATCHES_SQL = (
    f"batches AS ({_select(STORED + ['0 AS batch_seq'], 'events', STORED_WHERE)} "
    f"UNION ALL {_select(ARRIVED + ['1 AS batch_seq'], 'events', ARRIVED_WHERE)})"
)


def stored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(STORED_WHERE).selectExpr(*STORED)


def arrived_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(ARRIVED_WHERE).selectExpr(*ARRIVED)


# --- grid cells -----------------------------------------------------------------

ROWS, COLS = 65, 33
SHAPE = (ROWS, COLS)
CELL_SUMS = [
    "COUNT(*) AS n",
    "SUM(CAST(l_quantity AS BIGINT)) AS q",
    "SUM(CAST(ROUND(l_discount*100) AS BIGINT)) AS d",
    "SUM(CAST(ROUND(l_tax*100) AS BIGINT)) AS t",
]
CELL_KEYS = [
    "(l_linenumber-1)*3 AS fff",
    "CAST(l_orderkey%65 AS INT) AS lat_idx",
    "CAST(l_partkey%33 AS INT) AS lon_idx",
]
# Sums of whole numbers, so that the cell values do not depend on the order of rows.
CELL = [
    "fff", "lat_idx", "lon_idx",
    "24-lat_idx/4e0 AS lat",
    "102+lon_idx/4e0 AS lon",
    "CASE WHEN (lat_idx+lon_idx)%11=0 THEN NULL ELSE q/(n*1e0) END AS value",
    "q/(n*1e0)+273.15e0 AS t2m",
    "d/(n*1e4) AS prate",
    "CASE WHEN t%3=0 THEN 0e0 WHEN t%3>0 THEN 1e0 END AS crain",
    "CASE WHEN d%3=0 THEN 1e0 WHEN d%3>0 THEN 0e0 END AS csnow",
    "q/(n*1e0)-25 AS u",
    "t/(n*1e0)-4 AS v",
    "d*10/(n*1e0) AS low",
    "t*10/(n*1e0) AS mid",
    "q*2/(n*1e0) AS high",
    "(d+t)*5/(n*1e0) AS tcc",
]
CELLS_SQL = (
    f"sums AS (SELECT {', '.join(CELL_KEYS + CELL_SUMS)} FROM lineitem GROUP BY 1, 2, 3), "
    "grid AS (SELECT fff, CAST(i AS INT) AS lat_idx, CAST(j AS INT) AS lon_idx "
    f"FROM (SELECT DISTINCT fff FROM sums), range({ROWS}) AS r(i), range({COLS}) AS c(j)), "
    f"cells AS (SELECT {', '.join(CELL)} FROM grid LEFT JOIN sums USING (fff, lat_idx, lon_idx))"
)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense frames: every cell of every forecast hour, null where there is no data.

    The sums come to one row per hour and cell whatever the size of the table. They
    are kept, so that a query that goes over the cells more than once still reads the
    table once.
    """
    sums = checkpointed(
        table(spark, sf_dir, "lineitem")
        .selectExpr(*CELL_KEYS, "l_quantity", "l_discount", "l_tax")
        .groupBy("fff", "lat_idx", "lon_idx")
        .agg(*[F.expr(e) for e in CELL_SUMS])
    )
    grid = (
        sums.select("fff").distinct()
        .withColumn("lat_idx", F.explode(F.sequence(F.lit(0), F.lit(ROWS - 1))))
        .withColumn("lon_idx", F.explode(F.sequence(F.lit(0), F.lit(COLS - 1))))
    )
    return grid.join(sums, ["fff", "lat_idx", "lon_idx"], "left").selectExpr(*CELL)


def long_cells(spark: SparkSession, sf_dir: str, variables: list[str]) -> DataFrame:
    """Cells with one row per variable."""
    return cells(spark, sf_dir).unpivot(
        ["fff", "lat_idx", "lon_idx", "lat", "lon"], variables, "variable", "value"
    )


def long_cells_sql(variables: list[str], name: str = "long") -> str:
    parts = [
        f"SELECT fff, lat_idx, lon_idx, lat, lon, '{v}' AS variable, {v} AS value FROM cells"
        for v in variables
    ]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


# Frames by run and hour: a run is 15,000 order keys, so frames follow the table.
WIDE_SHAPE = (130, 66)
WIDE_KEYS = [
    "CAST((l_orderkey-l_orderkey%15000)/15000 AS INT) AS run",
    "CAST((l_linenumber-1)*3 AS INT) AS fff",
    f"CAST(l_orderkey%{WIDE_SHAPE[0]} AS INT) AS lat_idx",
    f"CAST(l_partkey%{WIDE_SHAPE[1]} AS INT) AS lon_idx",
]
_WIDE_SUMS = ["COUNT(*) AS n", "SUM(CAST(l_quantity AS BIGINT)) AS q"]
WIDE_SQL = (
    f"sums AS (SELECT {', '.join(WIDE_KEYS + _WIDE_SUMS)} FROM lineitem GROUP BY 1, 2, 3, 4), "
    "places AS (SELECT run, fff, CAST(i AS INT) AS lat_idx, CAST(j AS INT) AS lon_idx "
    f"FROM (SELECT DISTINCT run, fff FROM sums), range({WIDE_SHAPE[0]}) AS r(i), range({WIDE_SHAPE[1]}) AS c(j)), "
    "wide AS (SELECT run, fff, lat_idx, lon_idx, coalesce(q/(n*1e0), 0e0) AS value "
    "FROM places LEFT JOIN sums USING (run, fff, lat_idx, lon_idx))"
)


def wide_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that have data, of frames whose number grows with the table.

    Two of three rows are a cell of their own, so sums before the shuffle would save
    little, and would hold the cells of a whole file split in one task.
    """
    keys = ["run", "fff", "lat_idx", "lon_idx"]
    read = table(spark, sf_dir, "lineitem").selectExpr(*WIDE_KEYS, "l_quantity")
    dealt = read.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    sums = dealt.groupBy(*keys).agg(*[F.expr(e) for e in _WIDE_SUMS])
    return sums.selectExpr("run", "fff", "lat_idx", "lon_idx", "q/(n*1e0) AS value")


# --- index lines, runs and files --------------------------------------------------

# Variables and levels that index lines name.
VARS = ["TMP", "APCP", "PRATE", "CRAIN", "CSNOW", "TCDC", "LCDC", "MCDC", "HCDC", "SNOD", "UGRD", "VGRD"]
LEVELS = [
    "2 m above ground", "surface", "entire atmosphere", "low cloud layer", "middle cloud layer",
    "high cloud layer", "30 m above ground", "50 m above ground", "100 m above ground",
    "600 mb", "300 mb", "250 mb", "200 mb", "330 m above ground",
]


def pick(names: list[str], index: str) -> str:
    """CASE text that chooses one of ``names``, the same in both dialects."""
    arms = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"CASE CAST(({index})%{len(names)} AS INT) {arms} END"


LINE = [
    "CAST((p_size%4)*6 AS INT) AS run_hour",
    "CAST((p_partkey%40)*3 AS INT) AS fff",
    f"concat(CAST(p_partkey AS STRING), ':', CAST(p_partkey*1000 AS STRING), ':d=2026040600:', "
    f"{pick(VARS, 'p_partkey*7+p_size')}, ':', {pick(LEVELS, 'p_partkey*5+p_size*3')}, ':anl:') AS line",
]
LINES_SQL = (
    f"idx AS (SELECT *, split_part(line, ':', 4) AS var, split_part(line, ':', 5) AS level "
    f"FROM ({_select(LINE, 'part')}))"
)


def index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("DATE '2026-04-06' AS run_date", *LINE)


MAPS = [
    "temperature_feels_like", "rain_basic", "rain_advanced", "cloud_total",
    "cloud_layered", "snow_depth", "wind_animation",
]
MODES = ["full", "available_only", "f00_only", "init_only", "segments"]
REQUEST = [
    "s_suppkey AS request_id",
    "CAST((s_suppkey%4)*6 AS INT) AS run_hour",
    f"{pick(MAPS, 's_nationkey')} AS map_type",
    f"{pick(MODES, 's_suppkey')} AS mode",
]
OFFERED = [
    "CAST((p_partkey%4)*6 AS INT) AS run_hour",
    f"{pick(MAPS, 'p_size')} AS map_type",
    "CAST(p_partkey%50*3 AS INT) AS fff",
]
REQUEST_SQL = (
    f"rq AS (SELECT DATE '2026-04-01'+CAST(s_suppkey%30 AS INT) AS run_date, {', '.join(REQUEST)} FROM supplier), "
    f"av AS (SELECT DISTINCT DATE '2026-04-01'+CAST(p_partkey%30 AS INT) AS run_date, {', '.join(OFFERED)} FROM part)"
)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = "date_add(DATE '2026-04-01', CAST(s_suppkey%30 AS INT)) AS run_date"
    return table(spark, sf_dir, "supplier").selectExpr(day, *REQUEST)


def offered_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = "date_add(DATE '2026-04-01', CAST(p_partkey%30 AS INT)) AS run_date"
    return table(spark, sf_dir, "part").selectExpr(day, *OFFERED).distinct()


FILE = [
    f"{pick(MAPS[1:4], 'l_suppkey')} AS map_type",
    "CASE WHEN l_partkey%10=0 THEN concat('x', CAST(l_orderkey AS STRING), '.grib2') "
    "WHEN l_partkey%10=1 THEN 'readme.txt' ELSE concat('gfs.t00z.pgrb2.0p25.f', "
    "lpad(CAST((l_linenumber-1)*3 AS STRING), 3, '0'), '.p', CAST(l_suppkey AS STRING), '.grib2') END AS file",
    "CAST(floor(l_extendedprice*100) AS BIGINT) AS size_bytes",
    "CASE WHEN l_linenumber%3=0 THEN 'downloaded' WHEN l_linenumber%3=1 THEN 'skipped_existing' "
    "ELSE 'failed:HTTP 404' END AS status",
]
FILES_SQL = f"files AS ({_select(FILE, 'lineitem')})"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*FILE)


# --- feeds ------------------------------------------------------------------------

ENTRY = [
    "concat('urn:', CAST(page_id AS STRING), CASE page_id%5 WHEN 0 THEN '_VPTW60_' WHEN 1 THEN '_VPWW54_' "
    "WHEN 2 THEN '_VPWW53_' WHEN 3 THEN '_VPTW_VPWW53_' ELSE '_OTHER_' END) AS id",
    "concat(url, CASE WHEN page_id%2=0 THEN '.xml' ELSE '' END) AS link",
    "concat('2026-04-', lpad(CAST(1+page_id%28 AS STRING), 2, '0'), 'T00:00:00Z') AS updated",
    "CASE WHEN page_id%3=0 THEN 'Typhoon Information' ELSE 'Weather' END AS title",
]
ENTRIES_SQL = f"entries AS ({_select(['page_id'] + ENTRY, 'pages')})"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", *ENTRY)


# --- coordinates as text, bulletins -------------------------------------------------

LAT_CENTS = "((event_id*37)%12000-6000)"
LON_CENTS = "((event_id*91)%36000-18000)"


def signed_text(cents: str) -> str:
    return (
        f"concat(CASE WHEN {cents}<0 THEN '-' ELSE '+' END, CAST(CAST(floor(abs({cents})/100) AS BIGINT) AS STRING), "
        f"'.', lpad(CAST(abs({cents})%100 AS STRING), 2, '0'))"
    )


def plain_text(cents: str) -> str:
    return (
        f"concat(CASE WHEN {cents}<0 THEN '-' ELSE '' END, CAST(CAST(floor(abs({cents})/100) AS BIGINT) AS STRING), "
        f"'.', lpad(CAST(abs({cents})%100 AS STRING), 2, '0'))"
    )


INFO = (
    "concat('<MeteorologicalInfo>', "
    "CASE WHEN event_id%11=5 THEN '' ELSE concat('<DateTime>', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), '</DateTime>') END, "
    "'<Item><Kind><Property><Type>T</Type></Property></Kind>', "
    "CASE WHEN event_id%3=1 THEN concat('<TropicalCyclonePart><Name>N', CAST(user_id%40 AS STRING), "
    "'</Name><InternationalNumber>', CAST(user_id AS STRING), '</InternationalNumber></TropicalCyclonePart>') ELSE '' END, "
    f"CASE WHEN event_id%7=3 THEN '' ELSE concat('<CenterPart><Coordinate>', {signed_text(LAT_CENTS)}, {signed_text(LON_CENTS)}, "
    "'/</Coordinate></CenterPart>') END, "
    "CASE WHEN event_id%4=0 THEN '' ELSE concat('<IntensityPart><CentralPressure unit=\"hPa\">', CAST(900+event_id%100 AS STRING), "
    "'</CentralPressure><MaximumWindSpeed unit=\"kt\">', CAST(event_id%150 AS STRING), '</MaximumWindSpeed></IntensityPart>') END, "
    "'</Item></MeteorologicalInfo>')"
)


def joined(order: str, text: str):
    """Aggregate: texts of a small, fixed-size group put together in order."""
    pair = F.struct(F.expr(order).alias("o"), F.expr(text).alias("t"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["t"]), "")


def texts_of(groups, columns: list[str], text: str, name: str) -> DataFrame:
    """Texts of a small, fixed-size group put together in the order of the first column.

    Only ``columns`` travel; the text is made from them after the shuffle.
    """
    item = re.sub(rf"\b({'|'.join(columns)})\b", r"e.\1", text)
    rows = groups.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_rows"))
    return rows.withColumn(name, F.expr(f"array_join(transform(_rows, e -> {item}), '')")).drop("_rows")


def bulletins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML reports of six events each."""
    events = table(spark, sf_dir, "events")
    groups = events.groupBy(F.floor(F.col("event_id") / 6).cast("long").alias("bulletin"))
    bodies = texts_of(groups, ["event_id", "user_id", "ts"], INFO, "body")
    return bodies.select(
        "bulletin",
        F.concat(
            F.lit('<Report xmlns="http://xml.kishou.go.jp/jmaxml1/"><Head><Title>Typhoon Information</Title></Head><Body>'),
            "body", F.lit("</Body></Report>"),
        ).alias("xml"),
    )


BULLETIN_SQL = (
    "b AS (SELECT *, CAST(floor(event_id/6) AS BIGINT) AS bulletin, CAST(event_id%6 AS INT) AS seq FROM events), "
    "h AS (SELECT bulletin, coalesce(arg_min(CAST(user_id AS VARCHAR), event_id) FILTER (event_id%3=1 AND event_id%11<>5), 'unknown') AS storm_id, "
    "coalesce(arg_min(concat('N', user_id%40), event_id) FILTER (event_id%3=1 AND event_id%11<>5), 'Unknown') AS storm_name FROM b GROUP BY 1), "
    "bp AS (SELECT b.bulletin, storm_id, storm_name, seq, epoch_us(ts)//1000000 AS advisory_s, "
    f"{LAT_CENTS}/1e2 AS lat, {LON_CENTS}/1e2 AS lon, CASE WHEN seq=0 THEN 'current' ELSE 'forecast' END AS type, "
    "CASE WHEN event_id%4<>0 THEN (event_id%150)*1e0 END AS wind_kts, CASE WHEN event_id%4<>0 THEN 900e0+event_id%100 END AS pressure_hpa "
    "FROM b JOIN h USING (bulletin) WHERE event_id%11<>5 AND event_id%7<>3)"
)


# --- placemarks -----------------------------------------------------------------------

MARK_LAT = "((conv_id*37+turn*500)%12000-6000)"
MARK_LON = "((conv_id*91+turn*700)%36000-18000)"
MARK = [
    "conv_id*100000+CAST(floor(turn/8) AS BIGINT) AS doc_id",
    "CASE role WHEN 'system' THEN 0 WHEN 'user' THEN CASE WHEN turn%8<4 THEN 1 ELSE 2 END ELSE 3 END AS grp",
    "turn",
    "CASE role WHEN 'user' THEN 'Forecast' WHEN 'assistant' THEN 'Previous Best Track Posits' ELSE '' END AS folder",
    "CASE WHEN turn%2=0 THEN concat('2604', lpad(CAST(1+conv_id%28 AS STRING), 2, '0'), lpad(CAST((turn*6)%24 AS STRING), 2, '0'), 'Z') "
    "ELSE concat('P', CAST(turn AS STRING)) END AS name",
    "CASE turn%4 WHEN 0 THEN '#initial_point' WHEN 1 THEN '#BestTrack' WHEN 2 THEN CASE conv_id%3 WHEN 0 THEN '#WindRadii34' "
    "WHEN 1 THEN '#WindRadii50' ELSE '#msn_ylw-pushpin' END ELSE '' END AS style",
    "CASE WHEN turn%4 IN (0, 3) THEN 'Point' WHEN turn%4=1 THEN 'LineString' ELSE 'Polygon' END AS geometry",
    "CASE WHEN turn%3=0 THEN 'ANALYSIS' ELSE concat('TAU ', CAST(turn*12 AS STRING)) END AS time_text",
    "concat(lpad(CAST(length(text)%150 AS STRING), 3, '0'), ' KTS') AS wind_text",
    f"concat({plain_text(MARK_LON)}, ',', {plain_text(MARK_LAT)}) AS first_coord",
    f"concat({plain_text(MARK_LON)}, ',', {plain_text(MARK_LAT)}, ',0 ', {plain_text('(' + MARK_LON + '+100)')}, ',', "
    f"{plain_text(MARK_LAT)}, ',0 ', {plain_text('(' + MARK_LON + '+100)')}, ',', {plain_text('(' + MARK_LAT + '+100)')}) AS three_coords",
    f"{MARK_LAT}/1e2 AS mark_lat",
    f"{MARK_LON}/1e2 AS mark_lon",
    "conv_id%20 AS storm_no",
]
MARKS_SQL = (
    f"pm0 AS ({_select(MARK, 'conversations')}), "
    "pm AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp, turn)-1 AS INT) AS seq FROM pm0)"
)
TABLE_HTML = (
    "concat('<table><tr><td><b>NAME</b></td><td>N', CAST(storm_no AS STRING), '</td></tr><tr> <td>TIME</td><td><b>', time_text, "
    "'</b></td></tr>\n<TR><TD>WIND SPD</TD><TD>', wind_text, '</TD></TR></table>')"
)


def mark_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(*MARK)


def placemark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KML files of at most eight placemarks; later forecasts lie in a nested folder."""
    rows = mark_columns(spark, sf_dir)
    shape = (
        "CASE geometry WHEN 'Point' THEN concat('<Point><coordinates>', first_coord, '</coordinates></Point>') "
        "WHEN 'LineString' THEN concat('<LineString><coordinates>', three_coords, '</coordinates></LineString>') "
        "ELSE concat('<Polygon><outerBoundaryIs><LinearRing><coordinates>', three_coords, "
        "'</coordinates></LinearRing></outerBoundaryIs></Polygon>') END"
    )
    mark = (
        "concat('<Placemark><name>', name, '</name><styleUrl>', style, '</styleUrl><description><![CDATA[', "
        f"{TABLE_HTML}, ']]></description>', {shape}, '</Placemark>')"
    )
    part = lambda g: joined("turn", f"CASE WHEN grp={g} THEN {mark} ELSE '' END").alias(f"g{g}")
    docs = rows.groupBy("doc_id").agg(part(0), part(1), part(2), part(3))
    return docs.select(
        "doc_id",
        F.concat(
            F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>doc</name>'), "g0",
            F.lit("<Folder><name>Forecast</name>"), "g1", F.lit("<Folder>"), "g2", F.lit("</Folder></Folder>"),
            F.lit("<Folder><name>Previous Best Track Posits</name>"), "g3", F.lit("</Folder></Document></kml>"),
        ).alias("xml"),
    )


# --- advisories -------------------------------------------------------------------------

STORM_ADV = [
    "CAST(floor(event_id/60) AS BIGINT) AS storm_id",
    "CAST(floor(event_id/6)%10+1 AS INT) AS adv",
    "CAST(event_id%6 AS INT) AS seq",
]
ADV_EXT = {
    "fcstpd": "CASE WHEN event_id%6=5 THEN CASE WHEN floor(event_id/6)%2=0 THEN '120' ELSE '' END "
    "WHEN event_id%5=0 THEN CAST((event_id%6)*12 AS STRING) ELSE '' END",
    "stormName": "CASE WHEN event_id%6=5 OR event_id%4=0 THEN concat('NAME', CAST(user_id%30 AS STRING)) ELSE '' END",
    "stormType": "CASE WHEN event_id%6=5 THEN 'TS' ELSE ' ' END",
    "advisoryDate": "CASE WHEN event_id%6=5 THEN concat(CASE WHEN floor(event_id/6)%2=0 THEN '500 AM ' ELSE '11:00 PM ' END, "
    "CASE WHEN floor(event_id/60)%3=0 THEN 'AST ' ELSE 'UTC ' END, 'Sun Apr ', lpad(CAST(CAST(floor(event_id/6) AS BIGINT)%10+11 AS STRING), 2, '0'), ' 2026') ELSE '' END",
    "maxWindKnots": "CASE WHEN event_id%3=0 THEN CAST(event_id%150 AS STRING) WHEN event_id%6=5 THEN '35' ELSE '' END",
    "minimumPressureMb": "CASE WHEN event_id%6=5 THEN '990' ELSE '' END",
    "stormMovement": "CASE WHEN event_id%6=0 AND event_id%7=0 THEN 'NW AT 10' ELSE '' END",
    "advisoryNum": "CASE WHEN event_id%6=5 THEN CAST(CAST(floor(event_id/6) AS BIGINT)%10+1 AS STRING) ELSE '' END",
}
ADV_SQL = (
    f"adv AS (SELECT event_id, {', '.join(STORM_ADV)}, {LAT_CENTS}/1e2 AS lat, {LON_CENTS}/1e2 AS lon, "
    + ", ".join(f'nullif(trim({e}), \'\') AS "{k}"' for k, e in ADV_EXT.items())
    + " FROM events), ap AS (SELECT * FROM adv WHERE seq<5), al AS (SELECT * FROM adv WHERE seq=5)"
)


def advisory_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Points and metadata lines of advisories: five points and one line each."""
    ext = "map(" + ", ".join(f"'{k}', {e}" for k, e in ADV_EXT.items()) + ") AS ext"
    rows = table(spark, sf_dir, "events").selectExpr(
        *STORM_ADV, f"{LAT_CENTS}/1e2 AS lat", f"{LON_CENTS}/1e2 AS lon",
        "CASE WHEN event_id%6=0 THEN '#initial_point' ELSE '#p' END AS style", ext,
    )
    return rows.filter("seq < 5"), rows.filter("seq = 5").select("storm_id", "adv", "seq", "ext")


def advisory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track files in KML of the same advisories."""
    mark = (
        "concat('<Placemark><styleUrl>', CASE WHEN event_id%6=0 THEN '#initial_point' ELSE '#p' END, '</styleUrl><ExtendedData>', "
        + ", ".join(f"'<Data name=\"{k}\"><value>', {e}, '</value></Data>'" for k, e in ADV_EXT.items())
        + ", '</ExtendedData>', CASE WHEN event_id%6=5 THEN '<LineString><coordinates>0,0 1,1</coordinates></LineString>' ELSE "
        f"concat('<Point><coordinates>', {plain_text(LON_CENTS)}, ',', {plain_text(LAT_CENTS)}, ',0</coordinates></Point>') END, "
        "'</Placemark>')"
    )
    # Short rows become long texts, so their tasks are not merged by the size of the rows.
    rows = table(spark, sf_dir, "events").selectExpr(*STORM_ADV, "event_id", "user_id")
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "storm_id", "adv")
    docs = texts_of(dealt.groupBy("storm_id", "adv"), ["seq", "event_id", "user_id"], mark, "body")
    return docs.select(
        "storm_id", "adv",
        F.concat(F.lit("<kml><Document><Folder><name>t</name>"), "body", F.lit("</Folder></Document></kml>")).alias("xml"),
    )


def cone_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cone files: an empty polygon first, then a ring of six points."""
    rows = table(spark, sf_dir, "events").selectExpr(
        *STORM_ADV, f"concat({plain_text(LON_CENTS)}, ',', {plain_text(LAT_CENTS)}, ',0 ') AS coord"
    )
    ring = lambda c: F.concat(
        F.lit("<Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>"), c,
        F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"),
    )
    docs = rows.groupBy("storm_id", "adv").agg(joined("seq", "coord").alias("coords"))
    return docs.select(
        "storm_id", "adv",
        F.concat(
            F.lit("<kml><Document>"), ring(F.lit(" ")), ring(F.col("coords")), ring(F.lit("1,1,0")), F.lit("</Document></kml>")
        ).alias("xml"),
    )


# --- hourly series ----------------------------------------------------------------------

ZONES = ["UTC", "Asia/Ho_Chi_Minh", "Asia/Tokyo", "Asia/Kolkata"]
ZONE_MINUTES = {"UTC": 0, "Asia/Ho_Chi_Minh": 420, "Asia/Tokyo": 540, "Asia/Kolkata": 330}
HOURLY_SQL = (
    "hr AS (SELECT CAST(floor(event_id/24) AS BIGINT) AS location_id, event_id%24 AS i, "
    f"{pick(ZONES, 'CAST(floor(event_id/24) AS BIGINT)')} AS tz, "
    "epoch_us(TIMESTAMP '2026-04-06')+CAST(floor(event_id/24) AS BIGINT)%100*86400000000+(event_id%24)*3600000000 AS t_us, "
    "value AS temperature_2m, CASE WHEN event_id%9=0 THEN NULL ELSE (event_id%100)*1e0 END AS precipitation FROM events)"
)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations with start, end, interval and value arrays, 24 hours each."""
    gap = "CASE WHEN event_id%9=0 THEN CAST('NaN' AS DOUBLE) ELSE (event_id%100)*1e0 END"
    item = F.struct("event_id", F.col("value").alias("t"), F.expr(gap).alias("p"))
    rows = table(spark, sf_dir, "events").withColumn("location_id", F.expr("CAST(floor(event_id/24) AS BIGINT)"))
    packed = rows.groupBy("location_id").agg(F.array_sort(F.collect_list(item)).alias("v"))
    start = F.timestamp_micros(F.expr(
        "unix_micros(TIMESTAMP '2026-04-06 00:00:00')+location_id%100*86400000000"
    ))
    return packed.select(
        "location_id",
        F.expr(pick(ZONES, "location_id")).alias("tz"),
        start.alias("time_start"),
        F.timestamp_micros(F.unix_micros(start) + F.size("v").cast("long") * F.lit(3_600_000_000)).alias("time_end"),
        F.lit(3600).alias("interval_s"),
        F.col("v.t").alias("temperature_2m"),
        F.col("v.p").alias("precipitation"),
    )
