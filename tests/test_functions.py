"""Truth tables of the column rules."""

import math

import pytest
from pyspark.sql import functions as F

from galeframe.functions import classify, field, geo, text, times, units


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def table(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_no int, " + schema)
    return [r["x"] for r in df.select("row_no", column.alias("x")).orderBy("row_no").collect()]


def test_precipitation_classes(spark):
    cases = [
        (0.0, 0.0, 0.0), (1.0, 1.0, 0.0), (1.5, 1.0, 0.0), (1.0, 0.0, 1.0),
        (2.0, 0.0, 1.0), (1.0, 1.0, 1.0), (None, 1.0, 0.0), (1.0, None, None),
    ]
    got = table(spark, cases, "r double, a double, b double", classify.precip_class(F.col("r"), F.col("a"), F.col("b")))
    assert got == [0, 1, 2, 3, 4, 5, 2, 0]


@pytest.mark.parametrize(
    "lead, km", [(6, 45.0), (12, 45.0), (18, 62.5), (24, 80.0), (36, 115.0), (60, 187.5), (108, 387.5), (120, 450.0), (130, 450.0)]
)
def test_cone_radius(spark, lead, km):
    assert one(spark, classify.cone_radius(F.lit(float(lead)))) == km


def test_cone_radius_of_points(spark):
    assert one(spark, classify.point_cone_radius(F.lit("past"), F.lit(40.0))) == 0.0
    assert one(spark, classify.point_cone_radius(F.lit("forecast"), F.lit(None).cast("double"))) == 45.0
    assert one(spark, classify.point_cone_radius(F.lit("forecast"), F.lit(24.0), F.lit(99.0))) == 99.0


def test_icons(spark):
    cases = [(None, "past"), (33.9, "past"), (33.9, "current"), (34.0, "forecast"), (63.9, "past"), (64.0, "past"), (64.0, "current")]
    got = table(spark, cases, "w double, t string", classify.icon_by_wind(F.col("w"), F.col("t")))
    assert got == ["LOW.png", "TDgray.png", "TD.png", "TS.png", "TSgray.png", "TYgray.png", "TY.png"]
    cases = [(None, False), (None, True), (0, True), (10, True), (34, False), (64, True)]
    got = table(spark, cases, "w int, g boolean", classify.icon_by_warning(F.col("w"), F.col("g")))
    assert got == ["TD.png", "TDgray.png", "LOW.png", "TDgray.png", "TS.png", "TYgray.png"]


def test_type_by_wind(spark):
    assert table(spark, [(None,), (33.0,), (34.0,), (64.0,)], "w double", classify.type_by_wind(F.col("w"))) == ["TD", "TD", "TS", "HU"]


def test_compass(spark):
    cases = [(0.0,), (11.24,), (11.25,), (90.0,), (348.74,), (348.75,), (359.9,)]
    assert table(spark, cases, "d double", geo.compass16(F.col("d"))) == ["N", "N", "NNE", "E", "NNW", "N", "N"]


def test_distance_bearing_and_destination_agree(spark):
    at = (F.lit(10.0), F.lit(170.0))
    to_lat = one(spark, geo.destination_lat(at[0], F.lit(75.0), F.lit(2500.0)))
    to_lon = one(spark, geo.destination_lon(*at, F.lit(75.0), F.lit(2500.0)))
    assert -180 <= to_lon < 180
    there = (F.lit(to_lat), F.lit(to_lon))
    assert one(spark, geo.haversine_km(*at, *there)) == pytest.approx(2500.0, abs=1e-6)
    assert one(spark, geo.bearing_deg(*at, *there)) == pytest.approx(75.0, abs=1e-9)


def test_course_over_the_pole_is_north(spark):
    """Due north but for the last bit, where the longitudes lie half a turn apart."""
    spot = lambda n: (F.lit(((n * 37) % 12000) / 1e2 - 60), F.lit(((n * 91) % 36000) / 1e2 - 180))
    pairs = [(12965, 30965), (20710, 2710), (935, 18935), (14195, 32195), (13237, 31237)]
    assert [one(spark, geo.bearing_deg(*spot(a), *spot(b))) for a, b in pairs] == [0.0] * 5
    assert one(spark, geo.wrap_longitude(F.lit(179.99999999999997))) == -180.0


def test_units(spark):
    assert one(spark, units.kelvin_to_celsius(F.lit(300.0))) == 26.9
    assert one(spark, units.knots_to_kmh(F.lit(65.0))) == 120.4
    assert one(spark, units.hpa_to_mmhg(F.lit(980.0))) == 735.0
    assert one(spark, units.hpa_to_whole_mmhg(F.lit(990.0))) == 742
    assert one(spark, units.knots_to_kmh(F.lit(None).cast("double"))) is None
    assert one(spark, units.missing_to_null(F.lit(float("nan")))) is None


def test_cloud_scaling_branches(spark):
    cases = [(0.5, 0.0, 1.0), (40.0, 0.0, 80.0), (125.0, 0.0, 250.0), (200.0, 200.0, 200.0), (None, 0.0, 80.0), (-3.0, -3.0, 1.0)]
    got = table(spark, cases, "v double, a double, b double", field.scaled_cloud(F.col("v"), F.col("a"), F.col("b")))
    assert got == [0.5, 0.4, 0.5, 0.0, 0.0, 0.0]


def test_opacity_drops_fraction(spark):
    assert one(spark, field.opacity(F.lit(1.0), 0.55)) == 140
    assert one(spark, field.opacity(F.lit(2.0), 0.95)) == math.floor(255 * 0.95)


def test_file_names(spark):
    names = [("gfs.t00z.pgrb2.0p25.f003.apcp_surface.grib2",), ("x.grib2",), ("a.f012.idx",)]
    assert table(spark, names, "n string", text.grid_file_hour(F.col("n"))) == [3, None, None]
    assert table(spark, names, "n string", text.grid_file_product(F.col("n"))) == ["apcp_surface", None, None]
    assert table(spark, names, "n string", text.forecast_hour(F.col("n"))) == [3, None, 12]
    files = [("ep012026_005adv_TRACK.kmz",), ("ep012026_5day_005.zip",), ("readme.txt",)]
    assert table(spark, files, "n string", text.advisory_number(F.col("n"))) == [5, 5, -1]
    assert table(spark, files, "n string", text.advisory_number(F.col("n"), five_day=False)) == [5, -1, -1]


def test_signed_pair(spark):
    cases = [("+18.2+125.6/",), (" -18.25-125/ ",), ("nowhere",), ("",)]
    assert table(spark, cases, "c string", text.signed_pair_lat(F.col("c"))) == [18.2, -18.25, None, None]
    assert table(spark, cases, "c string", text.signed_pair_lon(F.col("c"))) == [125.6, -125.0, None, None]


def test_html_table(spark):
    html = (
        "<table><tr><td><b>NAME</b></td><td>SINLAKU</td></tr>\n<TR><TD> WIND  SPD </TD> <TD><b>065&nbsp;KTS</b></TD></TR>"
        "<tr><td><i></i></td><td>dropped</td></tr><tr><td>NAME</td><td>LAST &amp; WINS</td></tr></table>"
    )
    assert one(spark, text.html_table(F.lit(html))) == {"NAME": "LAST & WINS", "WIND SPD": "065 KTS"}
    assert one(spark, text.html_table(F.lit(None).cast("string"))) == {}


def test_times(spark):
    cases = [
        ("500 AM UTC Sun Apr 19 2026",), ("11:30 PM Sun Apr 19 2026",), ("1200 AM GMT Mon Apr 20 2026",),
        ("500 AM AST Sun Apr 19 2026",), ("1300 AM Sun Apr 19 2026",), ("",),
    ]
    got = table(spark, cases, "t string", text.advisory_time(F.col("t")).cast("string"))
    assert got == ["2026-04-19 05:00:00", "2026-04-19 23:30:00", "2026-04-20 00:00:00", None, None, None]
    cases = [("26041912Z",), ("26041332Z",), ("P1",), (None,)]
    got = table(spark, cases, "t string", text.best_track_time(F.col("t")).cast("string"))
    assert got == ["2026-04-19 12:00:00", None, None, None]


def test_iso_local(spark):
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    assert one(spark, times.iso_local(at, F.lit("Asia/Kolkata"))) == "2026-01-01T05:30:00+05:30"
    assert one(spark, times.iso_local(at, F.lit("America/St_Johns"))) == "2025-12-31T20:30:00-03:30"


def test_feed_scores(spark):
    cases = [("VPTW60", "a.xml"), ("VPWW54", "b.XML"), ("VPWW53", "c"), ("other", "d.xml")]
    score = classify.feed_score(F.col("i"), F.col("l"))
    assert table(spark, cases, "i string, l string", score) == [5, 4, 2, 1]
    kept = classify.is_bulletin(F.col("i"), F.col("l"))
    assert table(spark, cases, "i string, l string", kept) == [True, True, True, False]


def test_icon_stems(spark):
    cases = [("TS", -5.0), ("ts", 5.0), ("HU", -1.0), ("EX", -1.0), ("EX", 1.0), ("??", -1.0), (None, None)]
    wanted, fallback = classify.icon_stem(F.col("t"), F.col("lat"))
    assert table(spark, cases, "t string, lat double", wanted) == ["TSSH", "TS", "TYSH", "TSgraySH", "TDgray", "TDgray", "TDgray"]
    assert table(spark, cases, "t string, lat double", fallback) == ["TS", "TS", "TY", "TDgray", "TDgray", "TD", "TD"]


def test_request_url(spark):
    query = F.create_map(F.lit("lev_surface"), F.lit("on"), F.lit("var_APCP"), F.lit("on"))
    day = F.lit("2026-04-06").cast("date")
    assert one(spark, text.request_url(day, F.lit(0), F.lit(3), query)) == (
        "https://nomads.ncep.noaa.gov/cgi-bin/filter_gfs_0p25.pl?file=gfs.t00z.pgrb2.0p25.f003"
        "&lev_surface=on&var_APCP=on&leftlon=0&rightlon=360&toplat=90&bottomlat=-90&dir=%2Fgfs.20260406%2F00%2Fatmos"
    )
    assert one(spark, text.required_names(query)) == ["APCP"]
    assert one(spark, text.required_levels(query)) == ["surface"]
