"""One meaning whatever the physical form, the depth of a file or the order of arrival."""

import math

import pytest
from pyspark.sql import functions as F

from galeframe.functions import text
from galeframe.operators import resample, stencil
from galeframe.operators.ordered import running_sum, with_ordered
from galeframe.operators.tracks import latest_issue, merge_track
from galeframe.session import scratch_dir
from galeframe.sources import markup
from galeframe.streaming import tracks as live

SHAPE = (7, 6)


@pytest.fixture(scope="module")
def sparse(spark):
    """Two frames: absent cells in one; null, NaN and infinity in the other."""
    odd = {(6, 5): math.nan, (1, 1): None, (3, 0): math.inf}
    rows = [
        (k, i, j, odd.get((i, j), 1.0 + i * 0.7 + j * j) if k == "b" else i - 0.3 * j)
        for k in "ab" for i in range(SHAPE[0]) for j in range(SHAPE[1])
        if k == "b" or (i, j) not in ((2, 3), (0, 0))
    ]
    return spark.createDataFrame(rows, "k string, lat_idx int, lon_idx int, value double")


@pytest.mark.parametrize(
    "change",
    [
        lambda df, s, **t: stencil.gaussian(df, ["k"], 1.2, SHAPE, s, **t),
        lambda df, s, **t: stencil.box_blur(df, ["k"], SHAPE, 2, s, **t),
        lambda df, s, **t: resample.bicubic_upsample(df, ["k"], SHAPE, 1, s, **t),
        lambda df, s, **t: resample.bicubic_upsample(df, ["k"], SHAPE, 3, s, **t),
    ],
)
@pytest.mark.parametrize("tile", [2, 5, 256])
def test_both_forms_agree_on_sparse_frames(sparse, change, tile):
    one, two = ({tuple(r[:3]): r[3] for r in out.collect()} for out in (change(sparse, "scatter"), change(sparse, "tile", tile=tile)))
    assert set(one) == set(two) and len(one) % (2 * SHAPE[0] * SHAPE[1]) == 0
    for cell, value in one.items():
        assert (value is None) == (two[cell] is None)
        assert value is None or value == pytest.approx(two[cell], abs=1e-9)


def test_entities_and_signed_pairs(spark):
    rows = [("N&ecirc;m 12&#176;N &ndash; &#x1F600; &amp;lt; &unknown; a&b; c & d",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.unescape(F.col("t"))).collect()]
    assert got == ["Nêm 12°N – 😀 &lt; &unknown; a&b; c & d", None, ""]
    pairs = spark.createDataFrame([("+12.5+130.2/",), ("-5-170/",), (" +1.0-2.0 ",), ("12",), (None,)], "t string")
    got = [tuple(r) for r in pairs.select(text.signed_pair_lat(F.col("t")), text.signed_pair_lon(F.col("t"))).collect()]
    assert got == [(12.5, 130.2), (-5.0, -170.0), (1.0, -2.0), (None, None), (None, None)]


def test_placemarks_at_any_depth_in_order(spark):
    def mark(name):
        return f"<Placemark><name>{name}</name><Point><coordinates>1,2</coordinates></Point></Placemark>"

    deep = (
        "<?xml version='1.0'?><kml xmlns='x'><Document><name>Doc</name><Folder><name>A</name><Folder><name>B</name>"
        f"<Folder><name>C</name>{mark('deep')}</Folder>{mark('b')}</Folder>{mark('a')}</Folder>{mark('root')}"
        f"<!-- {mark('no')} --><Folder>{mark('unnamed')}<Document><name>dd</name>{mark('nested')}</Document></Folder></Document></kml>"
    )
    flat = f"<kml:kml><kml:Folder><kml:name>Only</kml:name>{mark('x')}</kml:Folder></kml:kml>"
    docs = spark.createDataFrame([(1, deep), (2, flat), (3, None), (4, "junk")], "f int, xml string")
    got = [tuple(r) for r in markup.parse_placemarks(docs).orderBy("f", "seq").select("f", "seq", "folder", "name", "lat", "lon").collect()]
    names = [("C", "deep"), ("B", "b"), ("A", "a"), ("", "root"), ("", "unnamed"), ("", "nested")]
    assert got == [*((1, k, f, n, 2.0, 1.0) for k, (f, n) in enumerate(names)), (2, 0, "Only", "x", 2.0, 1.0)]


def test_first_item_of_a_block(spark):
    def item(name, place):
        return f"<Item><TropicalCyclonePart><Name>{name}</Name></TropicalCyclonePart><CenterPart><Coordinate>{place}</Coordinate></CenterPart></Item>"

    xml = (
        "<Report><Head><ReportDateTime>2024-01-01T00:00:00Z</ReportDateTime></Head><Body><MeteorologicalInfo><DateTime>2024-01-01T00:00:00Z</DateTime>"
        f"{item('One', '+10+120/')}{item('Two', '+20+140/')}</MeteorologicalInfo></Body></Report>"
    )
    row = markup.parse_bulletins(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (row["storm_name"], row["lat"], row["lon"]) == ("One", 10.0, 120.0)


POINT = "storm_id string, storm_name string, basin string, source string, issue_time timestamp, seq int, advisory_time timestamp, lat double, lon double, type string, wind_kts double, pressure_hpa double"


def bulletin(spark, day, name="Sinlaku", issued=True, shift=0.0):
    """One current and two forecast points, issued on a day of January."""
    rows = [
        ("s1", name, "WP", "JMA", f"2024-01-{day:02d} 00:00:00" if issued else None, k, f"2024-01-{day + k:02d} 00:00:00", 10.0 + day + k + shift, 120.0, "forecast" if k else "current", 50.0, 990.0)
        for k in range(3)
    ]
    text_times = POINT.replace("timestamp", "string")
    return spark.createDataFrame(rows, text_times).withColumns({c: F.to_timestamp(c) for c in ("issue_time", "advisory_time")})


def points(df):
    return sorted((str(r["advisory_time"]), r["type"], r["lat"], r["storm_name"]) for r in df.collect())


def test_missing_name_comes_from_the_stored_one(spark):
    got = points(merge_track(bulletin(spark, 1), bulletin(spark, 2, name=None, shift=0.5)))
    assert {name for *_, name in got} == {"Sinlaku"} and len(got) == 4


def test_bulletin_without_issue_time_keeps_its_forecasts(spark):
    got = points(latest_issue(bulletin(spark, 1, issued=False)))
    assert [kind for _, kind, *_ in got] == ["current", "forecast", "forecast"]


def test_any_split_into_micro_batches_gives_the_same_tracks(spark):
    parts = [bulletin(spark, 1), bulletin(spark, 2, shift=0.5), bulletin(spark, 3, name=None, shift=0.25)]
    results = []
    for split in ([[0], [1], [2]], [[0, 1, 2]], [[2], [0, 1]], [[1, 2], [0]]):
        path = scratch_dir(spark, "split")
        for group in split:
            whole = parts[group[0]]
            for k in group[1:]:
                whole = whole.union(parts[k])
            whole.coalesce(1).write.mode("append").parquet(f"{path}/in")
            stream = spark.readStream.schema(whole.schema).parquet(f"{path}/in")
            live.log_bulletins(stream, f"{path}/log", f"{path}/checkpoint").awaitTermination()
        results.append(points(live.current_tracks(spark, f"{path}/log")))
    assert all(r == results[0] for r in results) and len(results[0]) == 5
    # A new checkpoint folder reads everything again and loses nothing.
    live.log_bulletins(stream, f"{path}/log", f"{path}/checkpoint2").awaitTermination()
    assert points(live.current_tracks(spark, f"{path}/log")) == results[0]


def test_old_entries_come_through(spark):
    path = scratch_dir(spark, "entries")
    schema = "id string, link string, updated timestamp, title string"
    for day in (20, 21, 2, 3, 20):
        row = [(f"urn:{day}_VPTW60_", "l", "t")]
        spark.createDataFrame(row, "id string, link string, title string").select("id", "link", F.to_timestamp(F.lit(f"2024-01-{day:02d}")).alias("updated"), "title").write.mode("append").parquet(f"{path}/in")
        stream = live.new_entries(spark.readStream.schema(schema).parquet(f"{path}/in"))
        live.write_stream(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{path}/out").collect()) == sorted(f"urn:{d}_VPTW60_" for d in (20, 21, 2, 3))


def test_null_keys_and_null_sums_in_cut_plans(spark, request):
    rows = [(None, i, 1.0) for i in range(20)] + [("x", i, None) for i in range(9)] + [("y", i, 2.0 if i % 2 else None) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    plain = sorted(map(tuple, with_ordered(df, ["k"], ["t"], {"s": running_sum(F.col("v"))}).collect()), key=repr)
    request.getfixturevalue("hot")
    assert sorted(map(tuple, with_ordered(df, ["k"], ["t"], {"s": running_sum(F.col("v"))}).collect()), key=repr) == plain


@pytest.mark.parametrize("sigma", [1.0, 1.2, 2.6, 3.2])
def test_gaussian_weights(sigma):
    """Against the density of the normal distribution, cut at four sigma."""
    from statistics import NormalDist

    from galeframe.plans import sqlkit

    weights = stencil.gaussian_weights(sigma)
    radius = len(weights) // 2
    assert radius == int(4 * sigma + 0.5)
    density = [NormalDist(0, sigma).pdf(d) for d in range(-radius, radius + 1)]
    assert weights == pytest.approx([d / sum(density) for d in density], rel=1e-12)
    assert sqlkit.gauss_weights(sigma) == pytest.approx(weights, rel=1e-12)
