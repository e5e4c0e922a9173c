"""XML and JSON sources, documents, streams."""

import datetime as dt

from pyspark.sql import functions as F

from galeframe import sinks
from galeframe.operators import advisories, placemarks, tracks
from galeframe.sources import documents, markup
from galeframe.streaming import tracks as live

ENTRY = "<MeteorologicalInfo><DateTime>{t}</DateTime><Item>{body}</Item></MeteorologicalInfo>"
NAMED = "<TropicalCyclonePart><Name>Sinlaku</Name><InternationalNumber>0603</InternationalNumber></TropicalCyclonePart>"
PLACE = "<CenterPart><Coordinate>{c}</Coordinate></CenterPart>"
POWER = '<IntensityPart><CentralPressure unit="hPa">980</CentralPressure><MaximumWindSpeed unit="kt">65</MaximumWindSpeed></IntensityPart>'


def report(*entries):
    body = "".join(ENTRY.format(t=t, body=b) for t, b in entries)
    return f'<Report xmlns="http://xml.kishou.go.jp/jmaxml1/"><Head><Title>T</Title></Head><Body>{body}</Body></Report>'


SAMPLE = report(
    ("2026-07-10T12:00:00Z", NAMED + PLACE.format(c="+18.2+125.6/") + POWER),
    ("", PLACE.format(c="+1.0+1.0/")),
    ("2026-07-11T00:00:00Z", PLACE.format(c="")),
    ("2026-07-11T12:00:00Z", PLACE.format(c="+21.0+121.0/")),
)
POINTS = [(0, "0603", "Sinlaku", "current", 18.2, 65.0), (3, "0603", "Sinlaku", "forecast", 21.0, None)]


def seen(df):
    return sorted(tuple(r) for r in df.select("seq", "storm_id", "storm_name", "type", "lat", "wind_kts").collect())


def test_bulletin_text_and_files(spark, tmp_path):
    text = spark.createDataFrame([(1, SAMPLE)], "id int, xml string")
    assert seen(markup.parse_bulletins(text)) == POINTS
    (tmp_path / "a.xml").write_text(SAMPLE)
    assert seen(markup.read_bulletins(spark, str(tmp_path / "a.xml"))) == POINTS


def test_bulletin_without_names(spark):
    text = spark.createDataFrame([(1, report(("2026-07-10T12:00:00Z", PLACE.format(c="+1.0+2.0/"))))], "id int, xml string")
    row = markup.parse_bulletins(text).first()
    assert (row["storm_id"], row["storm_name"], row["basin"], row["source"]) == ("unknown", "Unknown", "WP", "JMA")


def test_atom_file(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><id> u1 </id><link href="http://x/a.xml"/><updated>2026</updated></entry>'
        "<entry><id>u2</id></entry></feed>"
    )
    got = {tuple(r) for r in markup.read_atom(spark, str(tmp_path / "feed.xml")).collect()}
    assert got == {("u1", "http://x/a.xml", "2026", "A"), ("u2", "", "", "")}


KML = """<kml xmlns="http://www.opengis.net/kml/2.2"><Document>
<Placemark><name>root</name><Point><coordinates>1,2,0</coordinates></Point></Placemark>
<Folder><name>Forecast</name>
 <Placemark><name>p</name><styleUrl>#a</styleUrl><Point><coordinates> 120.5,10.5,0 </coordinates></Point>
  <description><![CDATA[<tr><td>TIME</td><td>TAU 12</td></tr><tr><td>WIND SPD</td><td>065 KTS</td></tr>]]></description></Placemark>
 <Folder><Placemark><LineString><coordinates>1,2 3,4</coordinates></LineString></Placemark></Folder>
 <Folder><name>Inner</name><Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>1,2 3,4 5,6</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Folder>
</Folder></Document></kml>"""


def test_placemarks(spark):
    marks = markup.parse_placemarks(spark.createDataFrame([("d", KML)], "doc_id string, xml string"))
    got = [tuple(r) for r in marks.orderBy("seq").select("folder", "name", "geometry", F.size("coords"), "lat", "lon").collect()]
    assert got == [
        ("", "root", "Point", 1, 2.0, 1.0), ("Forecast", "p", "Point", 1, 10.5, 120.5),
        ("Forecast", "", "LineString", 2, None, None), ("Inner", "", "Polygon", 3, None, None),
    ]
    row = placemarks.with_warning_values(marks).filter("name = 'p'").first()
    assert (row["tau"], row["wind_kt"]) == (12, 65)


def test_advisory_hours(spark):
    points = [("s", a, i, 1.0, 1.0, "", {"fcstpd": ""}) for a in (1, 2) for i in range(5)]
    df = spark.createDataFrame(points, "storm_id string, adv int, seq int, lat double, lon double, style string, ext map<string,string>")
    lines = spark.createDataFrame([("s", 1, 9, {"fcstpd": "120", "stormName": "X"})], "storm_id string, adv int, seq int, ext map<string,string>")
    out = advisories.impute_hours(df, lines).orderBy("adv", "seq").collect()
    assert [r["hour"] for r in out] == [0, 30, 60, 90, 120, 0, 6, 12, 18, 24]
    named = advisories.fill_metadata(df, lines).filter("adv = 1").first()
    assert (named["storm_name"], named["movement"]) == ("X", "")


def test_missing_storm_folder_is_empty(spark, tmp_path):
    assert documents.read_storm_docs(spark, str(tmp_path / "none")).count() == 0


def test_storm_documents_replace_their_storm_only(spark, tmp_path):
    schema = "storm_id string, storm_name string, basin string, seq long, advisory_time timestamp, lat double, lon double, type string, wind_kts double, pressure_hpa double"
    at = dt.datetime(2026, 4, 21)
    make = lambda s, lat: tracks.enrich_track(spark.createDataFrame([(s, "N", "WP", 0, at, lat, 1.0, "current", 45.0, 990.0)], schema))
    path = str(tmp_path / "docs")
    for points in (make("a", 1.0).unionByName(make("b", 2.0)), make("a", 3.0)):
        docs = sinks.storm_documents(points).withColumn("storm", F.col("metadata.storm_id"))
        sinks.write_json(docs, path, ["storm"])
    got = {(r["storm_id"], r["lat"], r["wind_kmh"]) for r in documents.read_storm_docs(spark, path).collect()}
    assert got == {("a", 3.0, 83.3), ("b", 2.0, 83.3)}


def test_availability_text(spark):
    docs = [
        (1, '{"map_info": {"union_fff": [6, 3, 3]}}'), (2, "{oops"), (3, '{"map_types": {"m": {"union_fff": [1]}}}'),
        (4, '{"map_info": {"products": {"p": {"fff_available": [1], "segments": [[1, 1, 1]]}}}}'),
    ]
    parsed = documents.parse_availability(spark.createDataFrame(docs, "id int, json string"))
    got = {r["id"]: r["h"] for r in parsed.select("id", documents.listed_hours(F.lit("m")).alias("h")).collect()}
    assert got == {1: [3, 6], 2: None, 3: [1], 4: []}


def test_hourly_rows_leave_the_end_out(spark):
    start = dt.datetime(2026, 4, 6)
    data = [("l", "Asia/Tokyo", start, start + dt.timedelta(hours=3), 3600, [1.0, 2.0, 3.0]), ("none", "UTC", start, start, 3600, [])]
    df = spark.createDataFrame(data, "location_id string, tz string, time_start timestamp, time_end timestamp, interval_s int, v array<double>")
    out = documents.hourly_rows(df, ["v"]).orderBy("pos")
    assert [(r["time_utc"].hour, r["time_local"].hour, r["v"]) for r in out.collect()] == [(0, 9, 1.0), (1, 10, 2.0), (2, 11, 3.0)]


def test_stream_equals_batch_and_replay_is_harmless(spark, tmp_path):
    schema = "storm_id string, storm_name string, basin string, seq long, advisory_time timestamp, lat double, lon double, type string, wind_kts double, pressure_hpa double"
    at = lambda h: dt.datetime(2026, 7, 10) + dt.timedelta(hours=h)
    bulletin = lambda k: spark.createDataFrame(
        [("s", "N", "WP", i, at(6 * k + 6 * i), float(k), float(i), "current" if i == 0 else "forecast", 40.0, 990.0) for i in range(3)], schema
    )
    log, inbox, check = (str(tmp_path / n) for n in ("log", "in", "check"))
    for k in range(3):
        bulletin(k).coalesce(1).write.mode("append").parquet(inbox)
        live.log_bulletins(spark.readStream.schema(schema).parquet(inbox), log, check).awaitTermination()
    state = lambda df: sorted((r["advisory_time"], r["lat"], r["type"]) for r in df.collect())
    streamed = state(live.current_tracks(spark, log))
    merged = bulletin(0)
    for k in (1, 2):
        merged = tracks.merge_track(merged.select(*bulletin(0).columns), bulletin(k))
    assert streamed == state(merged)
    assert [k for *_, k in streamed].count("current") == 1
    # Writing the last batch again replaces its partition.
    run = spark.read.parquet(log).first()["run"]
    (bulletin(2).withColumn("run", F.lit(run)).withColumn("batch_seq", F.lit(2)).write.mode("overwrite").partitionBy("run", "batch_seq")
     .option("partitionOverwriteMode", "dynamic").parquet(log))
    assert state(live.current_tracks(spark, log)) == streamed


def test_advisory_files_are_parsed_where_they_lie(spark):
    """Folders do not matter for them, so no file is shuffled or sorted."""
    mark = '<Placemark><ExtendedData><Data name="a"><value>{}</value></Data></ExtendedData>{}</Placemark>'
    point = "<Point><coordinates>5,6,0</coordinates></Point>"
    body = "<name>n</name><Folder>" + mark.format(1, point) + "</Folder><Placemark/>" + mark.format(2, point)
    docs = spark.createDataFrame([(1, f"<kml><Document>{body}</Document></kml>"), (2, "<kml/>"), (3, None)], "k int, xml string")
    rows = markup.parse_advisory_tracks(docs)
    assert sorted((r["k"], r["seq"], r["kind"], r["lat"], r["ext"]["a"]) for r in rows.collect()) == [(1, 0, "point", 6.0, "1"), (1, 2, "point", 6.0, "2")]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
