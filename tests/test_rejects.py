"""Rejects with reasons, placemark files of any size, snapshots, atomic documents."""

import datetime as dt
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from galeframe import sinks, versions
from galeframe.functions import text
from galeframe.plans import views
from galeframe.session import scratch_dir
from galeframe.sources import documents, grids, markup, rejects
from galeframe.streaming import tracks as live
from tests.test_meaning import bulletin, points
from tests.test_sources import NAMED, PLACE, SAMPLE, report


def test_bulletin_files_with_damage(spark, tmp_path):
    bad_place = report(("2026-07-10T12:00:00Z", NAMED + PLACE.format(c="18.2N 125.6E")), ("soon", PLACE.format(c="+1.0+1.0/")))
    files = {"good": SAMPLE, "cut": SAMPLE[: len(SAMPLE) // 2], "wrong": SAMPLE.replace("</Body>", ""), "blank": " ", "place": bad_place, "other": "<Report><Head/></Report>"}
    for name, xml in files.items():
        (tmp_path / f"{name}.xml").write_text(xml)
    metrics = Observation("bulletins")
    found = rejects.read_bulletins(spark, str(tmp_path), metrics)
    assert {(r["file"].split("/")[-1], r["lat"]) for r in found.rows.collect()} == {("good.xml", 18.2), ("good.xml", 21.0)}
    assert metrics.get == {"documents": 6, "rejected_documents": 4}
    got = {(r["file"].split("/")[-1], r["seq"], r["reason"], r["value"]) for r in found.rejects.collect()}
    assert got == {
        ("cut.xml", None, "malformed", None), ("wrong.xml", None, "malformed", None), ("blank.xml", None, "empty", None), ("other.xml", None, "no report", None),
        ("good.xml", 1, "no time", None), ("good.xml", 2, "no coordinate", None),
        ("place.xml", 0, "coordinate", "18.2N 125.6E"), ("place.xml", 1, "time", "soon"),
    }


def test_cells_with_damaged_files(spark, tmp_path):
    folder = tmp_path / "cells" / "map_type=rain" / "product=prate"
    folder.mkdir(parents=True)
    rows = pa.table({"fff": pa.array([3, 3], pa.int32()), "lat_idx": pa.array([0, 1], pa.int32()), "lon_idx": pa.array([0, 0], pa.int32()), "value": [1.0, 2.0]})
    pq.write_table(rows, folder / "good.parquet")
    pq.write_table(rows.slice(0, 0), folder / "none.parquet")
    whole = (folder / "good.parquet").read_bytes()
    (folder / "cut.parquet").write_bytes(whole[: len(whole) // 2])
    (folder / "text.parquet").write_text("no columns here, just text")
    (folder / "empty.parquet").write_bytes(b"")
    found = grids.checked_series(spark, str(tmp_path / "cells"), "rain", downsample=1)
    assert sorted(r["value"] for r in found.rows.collect()) == [1.0, 2.0]
    assert {(r["file"].split("/")[-1], r["reason"]) for r in found.rejects.collect()} == {("cut.parquet", "cut off"), ("text.parquet", "no Parquet file")}
    assert grids.read_series(spark, str(tmp_path / "cells"), "rain", downsample=1).count() == 2
    # A page that is damaged behind a good footer is an error, not a gap.
    big = pa.table({c: pa.array(range(5000), pa.int32()) for c in ("fff", "lat_idx", "lon_idx")} | {"value": [float(k) for k in range(5000)]})
    pq.write_table(big, folder / "page.parquet", compression="snappy")
    data = bytearray((folder / "page.parquet").read_bytes())
    data[20:2000] = b"\xff" * 1980
    (folder / "page.parquet").write_bytes(bytes(data))
    with pytest.raises(Exception):
        grids.read_series(spark, str(tmp_path / "cells"), "rain", downsample=1).agg(F.sum("value"), F.sum("fff")).collect()


def test_accepted_coordinates(spark):
    """Two numbers with a sign each, blanks between and a closing slash allowed; nothing else."""
    cases = ["+18.2+125.6/", "+18.2 +125.6", "-5-170/", "center +1.0+2.0/", "18.2+125.6", "+18.2", "+1.0+2.0x", ""]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [tuple(r) for r in df.select(text.signed_pair_lat(F.col("t")), text.signed_pair_lon(F.col("t"))).collect()]
    both = [None if None in g else g for g in got]
    assert both == [(18.2, 125.6), (18.2, 125.6), (-5.0, -170.0), None, None, None, None, None]


def mark(name, description="d"):
    return f"<Placemark><name>{name}</name><description>{description}</description><Point><coordinates>1,2</coordinates></Point></Placemark>"


def test_placemark_texts_are_untouched(spark):
    odd = "Winds gale:force = 35 and <b:x> </Placemark> & more"
    tail = "<x:Folder/><Folder/></Folder></Folder></Folder>" + mark("after") + "</Document></kml>"
    xml = f"<kml xmlns:x='u'><Document><x:Folder x:id='1'><x:name>A &amp; B</x:name>{mark('one', f'<![CDATA[{odd}]]>')}<Folder>{mark('two', 'a:b = c')}<name><![CDATA[late]]></name>{mark('three')}{tail}"
    got = markup.parse_placemarks(spark.createDataFrame([("f", xml)], "a string, xml string")).orderBy("seq").select("folder", "name", "description").collect()
    assert [tuple(r) for r in got] == [("A & B", "one", odd), ("A & B", "two", "a:b = c"), ("late", "three", "d"), ("", "after", "d")]


def test_placemarks_of_a_large_file_take_linear_time(spark):
    def seconds(n):
        body = "".join(f"<Folder><name>F{k}</name>{mark(k)}</Folder>" for k in range(n))
        docs = spark.createDataFrame([(1, f"<kml><Document>{body}</Document></kml>")], "f int, xml string")
        start = time.monotonic()
        row = markup.parse_placemarks(docs).agg(F.count("*"), F.countDistinct("folder"), F.max("seq")).collect()[0]
        assert tuple(row) == (n, n, n - 1)
        return time.monotonic() - start

    seconds(1000)
    few, many = seconds(5_000), seconds(50_000)
    assert many < 10 * few + 5


def test_snapshots_touch_only_what_changed(spark):
    path = scratch_dir(spark, "snapshots")
    log = live.tracks_log(f"{path}/log")
    start = bulletin(spark, 1)
    storms = start.drop("storm_id").crossJoin(spark.range(40).selectExpr("concat('s', id) AS storm_id")).select(*start.columns)
    live._append(storms, 0, f"{path}/log")
    first = log.compact(spark)
    assert first.version == 1 and len(first.at) > 10 and first.marks == {"run": 0}
    assert live.compact_tracks(spark, f"{path}/log").version == 1  # nothing new
    live._append(bulletin(spark, 2, shift=0.5), 1, f"{path}/log")
    # Read with the second batch in the log alone: folded rows and one newer folder.
    opened = {r[0].split("snapshots")[1].split("/")[1] + "/" + r[0].split("/")[-2] for r in log.rows(spark).select(F.input_file_name()).distinct().collect()}
    assert {o for o in opened if o.startswith("log/")} == {"log/batch_seq=1"}
    loose = points(live.current_tracks(spark, f"{path}/log"))
    second = log.compact(spark)
    changed = versions.changed_buckets(bulletin(spark, 2), ["storm_id"], second.buckets)
    assert {b for b, v in second.at.items() if v == 2} == set(changed) and len(changed) == 1
    assert {b: v for b, v in second.at.items() if b not in changed} == {b: v for b, v in first.at.items() if b not in changed}
    assert points(live.current_tracks(spark, f"{path}/log")) == loose
    # The batch comes again, and a late old bulletin after it.
    live._append(bulletin(spark, 2, shift=0.5), 1, f"{path}/log")
    live._append(bulletin(spark, 1, shift=0.25), 2, f"{path}/log")
    late = points(live.current_tracks(spark, f"{path}/log"))
    log.compact(spark)
    log.compact(spark)
    assert points(live.current_tracks(spark, f"{path}/log")) == late
    whole = spark.read.parquet(f"{path}/log").drop("run")
    assert late == points(live.latest_issue(whole)) and len(late) > len(loose)


def test_a_batch_being_written_stays_out_of_the_snapshot(spark):
    path = scratch_dir(spark, "snapshots")
    for k in range(3):
        live._append(bulletin(spark, k + 1), k, f"{path}/log")
    known = live.compact_tracks(spark, f"{path}/log", before=("run", 2))
    assert known.marks == {"run": 1}


def entries(spark, *ids):
    day = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(f"urn:{i}_VPTW60_", "l", day + dt.timedelta(days=k), "t") for k, i in enumerate(ids)], "id string, link string, updated timestamp, title string")


@pytest.mark.parametrize("at_once", [1_000_000, 0])
def test_ids_are_seen_for_good(spark, at_once):
    path = scratch_dir(spark, "ids")
    source = entries(spark, 0)
    for batch, check in ((entries(spark, 1, 2, 1), "a"), (entries(spark, 2, 3), "a"), (entries(spark, 1, 4), "a"), (entries(spark, 5), "b")):
        batch.coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(source.schema).parquet(f"{path}/in")
        # A new checkpoint folder reads the whole feed again.
        live.take_new(stream, f"{path}/taken", f"{path}/check-{check}", compact_every=2, at_once=at_once).awaitTermination()
    taken = [(r["id"], r["run"], r["batch_seq"]) for r in spark.read.parquet(f"{path}/taken").collect()]
    assert sorted(i for i, *_ in taken) == [f"urn:{k}_VPTW60_" for k in range(1, 6)]
    assert versions.manifest(spark, f"{path}/taken.ids").version == 1


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "storm string, part int, body string")


def test_documents_switch_at_once(spark, monkeypatch):
    path = scratch_dir(spark, "docs")
    rows = lambda: sorted(tuple(r) for r in sinks.read_documents(spark, path, docs_of(spark, []).schema).collect())
    assert rows() == []
    sinks.replace_documents(docs_of(spark, [(f"s{k}", p, None) for k in range(200) for p in (0, 1)]), path, ["storm"])
    before = rows()
    assert len(before) == 400
    broken = docs_of(spark, [("s1", 0, "new"), ("s2", 0, "new")]).withColumn("body", F.when(F.col("storm") == "s2", F.raise_error(F.lit("stop"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="stop"):
        sinks.replace_documents(broken, path, ["storm"])
    assert rows() == before
    # The next write goes over the rest of the failed one; part 1 of s1 is gone with its storm.
    after = sinks.replace_documents(docs_of(spark, [("s1", 0, "new"), ("x", 0, "y")]), path, ["storm"])
    assert after.version == 2 and list(after.at.values()).count(2) == 2
    assert rows() == sorted([r for r in before if r[0] != "s1"] + [("s1", 0, "new"), ("x", 0, "y")], key=lambda r: r)
    assert versions.expire(spark, path, keep=1) == 2
    assert len(rows()) == 400
    folders = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/data").select("path").collect()
    assert all("storm=" not in r["path"] for r in folders)


def test_storm_documents_by_bucket(spark):
    from galeframe.operators.tracks import enrich_track

    path = scratch_dir(spark, "docs")
    sinks.replace_storm_docs(sinks.storm_documents(enrich_track(bulletin(spark, 1))), path)
    sinks.replace_storm_docs(sinks.storm_documents(enrich_track(bulletin(spark, 2).withColumn("storm_id", F.lit("other")))), path)
    back = documents.storm_doc_points(sinks.read_documents(spark, path, documents.STORM_DOC_KEYED))
    assert sorted((r["storm_id"], r["pos"]) for r in back.collect()) == [(s, k) for s in ("other", "s1") for k in range(3)]


def test_rejects_of_bulletins_parse_once(spark):
    """One parser in the plan, whatever a document is rejected for."""
    made = views.bulletins(spark, "/root/testdata/sf0.001").selectExpr("bulletin", "xml")
    plan = rejects.bulletins(made).rejects._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_xml") == 1
