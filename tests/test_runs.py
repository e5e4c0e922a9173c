"""Hours, availability, plans, files."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galeframe import sinks
from galeframe.operators import availability as av
from galeframe.operators import files
from galeframe.sources import listings
from galeframe.sources.catalog import map_catalog


def segments(spark, hours):
    df = spark.createDataFrame([(h,) for h in hours] or [], "fff int").withColumn("k", F.lit(0))
    out = av.infer_segments(df, ["k"]).orderBy("start", "end").collect()
    return [(r["start"], r["end"], r["step"]) for r in out]


@pytest.mark.parametrize(
    "hours, expected",
    [
        ([], []),
        ([7], [(7, 7, 1)]),
        ([0, 1, 5], [(0, 1, 1), (1, 5, 4)]),
        ([0, 3, 6, 7, 8, 20], [(0, 6, 3), (6, 8, 1), (8, 20, 12)]),
        ([*range(0, 121), *range(123, 385, 3)], [(0, 120, 1), (120, 384, 3)]),
        ([*range(1, 121), *range(123, 385, 3)], [(1, 120, 1), (120, 384, 3)]),
    ],
)
def test_segments(spark, hours, expected):
    assert segments(spark, hours) == expected


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(0, 384), min_size=1, max_size=30))
def test_expanding_segments_gives_the_hours_back(spark, hours):
    df = spark.createDataFrame([(h,) for h in hours], "fff int").withColumn("k", F.lit(0))
    packed = av.infer_segments(df, ["k"]).groupBy("k").agg(F.collect_list(F.struct("start", "end", "step")).alias("s"))
    assert packed.select(av.expand_segments(F.col("s")).alias("h")).first()["h"] == sorted(hours)


def test_catalogue(spark):
    catalog = map_catalog(spark)
    assert catalog.count() == 15 and catalog.select("map_type").distinct().count() == 7
    snow = catalog.filter("map_type = 'snow_depth'").select(F.size(av.expand_segments(F.col("segments"))).alias("n"))
    assert snow.first()["n"] == 33


def idx(spark, entries):
    data = [(dt.date(2026, 4, 6), 0, fff, line) for fff, line in entries]
    return listings.index_lines(spark.createDataFrame(data, "run_date date, run_hour int, fff int, line string"))


def test_loose_and_strict_matching(spark):
    lines = idx(spark, [
        (0, "1:0:d=2026040600:UGRD:100 m above ground:anl:"), (0, "2:9:d=2026040600:VGRD:50 m above ground:anl:"),
        (3, "1:0:d=2026040600:UGRD:330 m above ground:anl:"), (3, "2:9:d=2026040600:VGRD:330 m above ground:anl:"),
        (6, "1:0:d=2026040600:UGRD:50 m above ground:anl:"), (6, "2:9:d=2026040600:VGRD:50 m above ground:anl:"),
        (9, "1:0:d=2026040600:ugrd:50 m above ground:anl:"), (9, "2:9:d=2026040600:VGRD:50 m above ground:anl:"),
    ])
    found = lambda mode: {(r["product"], r["fff"]) for r in av.product_availability(lines, map_catalog(spark), mode).collect()}
    assert found("strict") == {("wind_50m", 6)}
    # Loose: variable and level on different lines, and a level inside a longer one.
    assert found("loose") == {("wind_50m", 0), ("wind_100m", 0), ("wind_30m", 3), ("wind_50m", 6)}


def test_resolving_hours(spark):
    day = dt.date(2026, 4, 6)
    modes = ["full", "available_only", "init_only", "f00_only", "segments"]
    data = [(day, h, "rain_basic", m) for h in (0, 6) for m in modes]
    requests = spark.createDataFrame(data, "run_date date, run_hour int, map_type string, mode string")
    available = spark.createDataFrame([(day, 0, "rain_basic", [3, 9])], "run_date date, run_hour int, map_type string, union_fff array<int>")
    out = av.resolve_hours(requests, available, map_catalog(spark)).collect()
    got = {(r["run_hour"], r["mode"]): (r["hours"], r["fff_source"], r["valid"]) for r in out}
    listed = list(range(0, 25, 3))
    assert got[0, "full"] == ([3, 9], "available", True)
    assert got[6, "full"] == (listed, "segments", True)
    assert got[0, "available_only"] == ([3, 9], "available", True)
    assert got[6, "available_only"] == (None, None, False)
    assert got[0, "init_only"] == got[6, "f00_only"] == ([0], "segments", True)
    assert got[0, "segments"] == (listed, "segments", True)


def test_request_checks(spark):
    data = [(0, "full", 60, 384), (23, "init_only", 1, 0), (24, "full", 60, 384), (-1, "full", 60, 1), (0, "hourly", 60, 1), (0, "full", 0, 1), (0, "full", 1, -1), (None, "full", 1, 1)]
    out = av.valid_requests(spark.createDataFrame(data, "run_hour int, mode string, rpm_limit int, max_fff int"))
    assert [r["valid"] for r in out.collect()] == [True, True, False, False, False, False, False, False]


def test_file_summary(spark):
    data = [("m", "gfs.t00z.f003.p.grib2", 1048576), ("m", "gfs.t00z.f000.p.grib2", 524288), ("m", "x.grib2", 0), ("m", "notes.txt", 5)]
    row = files.file_summary(spark.createDataFrame(data, "map_type string, file string, size_bytes long")).first()
    assert (row["file_count"], row["total_size_mb"], row["fff_available"]) == (3, 1.5, [0, 3])


def test_first_candidate_with_hours(spark):
    data = [(1, 0, []), (1, 1, [3, 6]), (2, 0, [0]), (2, 1, [9]), (3, 0, None)]
    out = av.first_availability(spark.createDataFrame(data, "run int, candidate int, hours array<int>"), ["run"])
    assert {r["run"]: r["hours"] for r in out.collect()} == {1: [3, 6], 2: [0]}


def test_index_files(spark, tmp_path):
    folder = tmp_path / "gfs.20260406" / "00" / "atmos"
    folder.mkdir(parents=True)
    (folder / "gfs.t00z.pgrb2.0p25.f012.idx").write_text("1:0:d=2026040600:TMP:2 m above ground:anl:\n\n")
    row = listings.read_index(spark, str(folder)).first()
    assert (str(row["run_date"]), row["run_hour"], row["fff"], row["var"], row["level"]) == ("2026-04-06", 0, 12, "TMP", "2 m above ground")


def test_listing_files(spark, tmp_path):
    for name in ("ep012026_005adv_TRACK.kmz", "ep012026_5day_005.zip", "readme.txt"):
        (tmp_path / name).write_bytes(b"abc")
    out = listings.advisory_files(listings.list_files(spark, str(tmp_path))).collect()
    assert {(r["file"], r["kind"], r["adv"], r["size_bytes"]) for r in out} == {
        ("ep012026_005adv_TRACK.kmz", "track", 5, 3), ("ep012026_5day_005.zip", "five_day", 5, 3), ("readme.txt", "other", -1, 3),
    }


def test_tasks_of_a_summary_follow_its_files(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("CONCAT('m', id % 2) AS map_type", "CONCAT('gfs.f003.', id, '.grib2') AS file", "id AS size_bytes")
    monkeypatch.setattr(sinks, "TASK_FILES", 100)
    docs = sinks.summary_documents(files.file_entries(rows), files.file_summary(rows), 50)
    assert docs.rdd.getNumPartitions() == 40
    assert docs.selectExpr("SUM(SIZE(files))").first()[0] == 4000
