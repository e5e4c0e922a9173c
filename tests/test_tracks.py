"""Tracks: enrichment, merging, interpolation, cones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from galeframe.functions import classify
from galeframe.operators import tracks

SCHEMA = (
    "storm_id string, storm_name string, basin string, seq long, advisory_time timestamp, lat double, lon double, "
    "type string, wind_kts double, pressure_hpa double"
)
T0 = dt.datetime(2026, 7, 10, 12)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def points(spark, entries, storm="2603"):
    """Entries (hour, lat, lon, type, wind, pressure) of one storm."""
    data = [(storm, "Sinlaku", "WP", i, at(h), la, lo, k, w, p) for i, (h, la, lo, k, w, p) in enumerate(entries)]
    return spark.createDataFrame(data, SCHEMA)


BULLETIN = [
    (0, 18.2, 125.6, "current", 65.0, 980.0),
    (12, 19.5, 123.0, "forecast", None, None),
    (24, 21.0, 121.0, "forecast", None, None),
    (48, 23.5, 118.5, "forecast", None, None),
    (72, 26.0, 116.0, "forecast", None, None),
    (96, 28.0, 114.0, "forecast", None, None),
]
EXPECTED = [
    (120.4, 735.0, "TY.png", 0.0, "N", 0.0),
    (None, None, "LOW.png", 25.8, "WNW", 45.0),
    (None, None, "LOW.png", 22.3, "NW", 80.0),
    (None, None, "LOW.png", 15.8, "NW", 150.0),
    (None, None, "LOW.png", 15.6, "NW", 225.0),
    (None, None, "LOW.png", 12.4, "NW", 325.0),
]
COLUMNS = ["wind_kmh", "pressure_mmhg", "icon_tag", "forward_speed", "direction", "cone_radius_km"]


def enriched(spark):
    return [tuple(r) for r in tracks.enrich_track(points(spark, BULLETIN)).orderBy("advisory_time").select(*COLUMNS).collect()]


def test_sample_bulletin(spark):
    assert enriched(spark) == EXPECTED


def test_sample_bulletin_cut_into_pieces(spark, hot):
    assert enriched(spark) == EXPECTED


def test_no_time_step_gives_no_speed(spark):
    df = points(spark, [(0, 1.0, 1.0, "past", 1.0, 1.0), (0, 2.0, 2.0, "past", 1.0, 1.0)])
    assert [r["forward_speed"] for r in tracks.enrich_track(df).collect()] == [0.0, 0.0]


OLD = [(0, 1.0, 1.0, "past", 30.0, 1000.0), (6, 2.0, 2.0, "current", 30.0, 1000.0), (12, 3.0, 3.0, "forecast", 30.0, 1000.0), (18, 4.0, 4.0, "forecast", 30.0, 1000.0)]
NEW = [(12, 3.1, 3.1, "current", 40.0, 990.0), (18, 4.1, 4.1, "forecast", 40.0, 990.0), (24, 5.1, 5.1, "forecast", 40.0, 990.0)]


def state(df):
    return [(r["advisory_time"], r["lat"], r["type"]) for r in df.orderBy("storm_id", "advisory_time").collect()]


MERGED = [(at(0), 1.0, "past"), (at(6), 2.0, "past"), (at(12), 3.1, "current"), (at(18), 4.1, "forecast"), (at(24), 5.1, "forecast")]


def test_merge(spark):
    assert state(tracks.merge_track(points(spark, OLD), points(spark, NEW))) == MERGED


def test_merging_again_changes_nothing(spark):
    keep = [f.strip().split(" ")[0] for f in SCHEMA.split(",")]
    once = tracks.merge_track(points(spark, OLD), points(spark, NEW)).select(*keep)
    assert state(tracks.merge_track(once, points(spark, NEW))) == MERGED


def test_new_row_wins_for_the_same_place_and_time(spark):
    old = points(spark, [(0, 1.00001, 1.0, "current", 30.0, 1000.0)])
    new = points(spark, [(0, 1.00002, 1.0, "current", 50.0, 990.0)])
    assert [r["wind_kts"] for r in tracks.merge_track(old, new).collect()] == [50.0]


def test_storm_without_news_stays_as_it_is(spark):
    other = points(spark, OLD, "2604")
    merged = tracks.merge_track(points(spark, OLD).unionByName(other), points(spark, NEW))
    kept = [r["type"] for r in merged.filter("storm_id = '2604'").orderBy("advisory_time").collect()]
    assert kept == ["past", "current", "forecast", "forecast"]


def test_late_older_bulletin(spark):
    issued = lambda e, h: points(spark, e).withColumn("issue_time", F.lit(at(h)))
    late = issued(OLD, 6).unionByName(issued(NEW, 12)).withColumn("batch_seq", F.when(F.col("issue_time") == F.lit(at(12)), 0).otherwise(1))
    assert state(tracks.latest_issue(late)) == MERGED
    # By arrival the old forecasts replace the newer ones.
    by_arrival = {(lat, kind) for _, lat, kind in state(tracks.fold_batches(late))}
    assert by_arrival == {(1.0, "past"), (2.0, "current"), (3.1, "past"), (3.0, "forecast"), (4.0, "forecast")}


def test_batches_one_by_one_equal_all_at_once(spark):
    third = [(18, 4.2, 4.2, "current", 45.0, 985.0), (30, 6.0, 6.0, "forecast", 45.0, 985.0)]
    keep = [f.strip().split(" ")[0] for f in SCHEMA.split(",")]
    two = tracks.merge_track(points(spark, OLD), points(spark, NEW)).select(*keep)
    stepwise = tracks.merge_track(two, points(spark, third))
    tag = lambda e, b: points(spark, e).withColumn("batch_seq", F.lit(b))
    at_once = tracks.fold_batches(tag(OLD, 0).unionByName(tag(NEW, 1)).unionByName(tag(third, 2)))
    assert state(stepwise) == state(at_once)
    assert [k for _, _, k in state(at_once)].count("current") == 1


def test_point_types(spark):
    df = points(spark, [(0, 1.0, 1.0, None, 1.0, 1.0), (6, 1.0, 1.0, None, 1.0, 1.0), (12, 1.0, 1.0, None, 1.0, 1.0)])
    typed = tracks.point_type(df, F.lit(at(9)).cast("timestamp")).orderBy("advisory_time")
    assert [r["type"] for r in typed.collect()] == ["past", "current", "forecast"]


@pytest.mark.parametrize("cut", [False, True])
def test_interpolation(spark, cut):
    if cut:
        spark.conf.set("galeframe.hot.rows", "2")
    try:
        start = dt.datetime(2017, 9, 1)
        data = [("irma", 0, start, 10.0), ("irma", 1, start + dt.timedelta(hours=6), None), ("irma", 2, start + dt.timedelta(hours=24), 40.0)]
        df = spark.createDataFrame(data, "storm_id string, seq long, advisory_time timestamp, vmax double")
        cutoff = F.lit(start - dt.timedelta(hours=24)).cast("timestamp")
        out = tracks.time_interpolate(df, cutoff, [0, 24, 27, 36, 72], ["vmax"]).orderBy("fhr")
        assert [r["vmax"] for r in out.collect()] == [None, 10.0, 13.75, 25.0, 40.0]
    finally:
        spark.conf.unset("galeframe.hot.rows")


def test_cone_ring(spark):
    data = [("s", h, 10.0, 120.0 + i) for i, h in enumerate([0, 12, 24])]
    df = spark.createDataFrame(data, "storm_id string, fhr int, lat double, lon double")
    edges = tracks.cone_edges(df.withColumn("cone_error_km", classify.cone_error(F.col("fhr"))))
    ring = [tuple(r) for r in tracks.cone_ring(edges).orderBy("ring_seq").select("ring_seq", "lat", "lon").collect()]
    assert [s for s, _, _ in ring] == [1, 2, 3, 4, 5, 6]
    # The track heads east, so the left edge lies north and the ring closes at the start.
    assert ring[2][1] > 10.0 > ring[3][1]
    assert ring[0][1:] == pytest.approx(ring[5][1:])


def test_icons_need_their_file(spark):
    df = spark.createDataFrame([("TS", -5.0), ("HU", -5.0), ("LO", 5.0)], "storm_type string, lat double")
    icons = tracks.icon_table(spark, ["TS", "TY", "TYSH", "LOW"])
    got = {(r["storm_type"], r["icon_file"]) for r in tracks.with_icons(df, icons).collect()}
    assert got == {("TS", "TS.png"), ("HU", "TYSH.png"), ("LO", "LOW.png")}
