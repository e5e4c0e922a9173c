"""JSON products. Documents are built as rows and written by Spark's writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from galeframe import versions
from galeframe.functions import times, units
from galeframe.operators.ordered import in_parts
from galeframe.session import checkpointed

PART_ROWS = 10_000
# Files of a summary that one task puts together and sorts.
TASK_FILES = 200_000


def grid_documents(cells: DataFrame, frame: Sequence[str]) -> DataFrame:
    """One ``{lat, lon, data}`` row per frame; a frame has a fixed number of cells.

    Grid rows are put together first, so the last step moves one row per latitude.
    """
    frame = list(frame)
    value = F.struct(F.col("lon_idx"), F.bround("value", 1).alias("v"), F.bround("lon", 2).alias("lon"))
    rows = cells.groupBy(*frame, "lat_idx").agg(
        F.bround(F.first("lat"), 2).alias("lat"), F.array_sort(F.collect_list(value)).alias("row")
    )
    whole = F.array_sort(F.collect_list(F.struct("lat_idx", "lat", "row")))
    return rows.groupBy(*frame).agg(whole.alias("_g")).select(
        *frame,
        F.transform("_g", lambda g: g["lat"]).alias("lat"),
        F.transform(F.get("_g", F.lit(0))["row"], lambda c: c["lon"]).alias("lon"),
        F.transform("_g", lambda g: F.transform(g["row"], lambda c: c["v"])).alias("data"),
    )


def availability_by_map(combined: DataFrame) -> DataFrame:
    """Combined availability documents to one per map type, with the run fields."""
    return combined.select(
        "run_date", "run_hour", "max_fff",
        F.coalesce("fff_existing", F.array().cast("array<int>")).alias("fff_existing"),
        F.coalesce("fff_existing_segments", F.array().cast("array<array<int>>")).alias("fff_existing_segments"),
        F.explode("map_types").alias("map_type", "map_info"),
    )


def summary_documents(entries: DataFrame, summary: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Folder summaries with their file lists, about ``part_rows`` files to a document.

    Files are dealt over the documents of a map by a hash of their name, so however many
    share a map and an hour, they never meet in one task.  The number of tasks follows the
    number of files, so that what a task holds does not grow with it.
    """
    # A row per map; a join by map would put all files of a map into one task.
    kept = checkpointed(summary)
    summary = F.broadcast(kept)
    count = kept.agg(F.sum("file_count")).first()[0] or 0
    tasks = max(-(-count // TASK_FILES), int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = F.ceil(F.col("file_count") / F.lit(part_rows))
    placed = entries.join(summary.select("map_type", "file_count"), "map_type").withColumn(
        "part", F.pmod(F.xxhash64("file"), F.greatest(F.lit(1), parts)).cast("int")
    )
    listed = placed.repartition(tasks, "map_type", "part").groupBy("map_type", "part").agg(
        F.array_sort(F.collect_list(F.struct("file", "size_bytes", "fff"))).alias("files")
    )
    return listed.join(summary, "map_type")


def manifest_documents(plan: DataFrame, requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Request with its hours and the status of each file (a request has few thousand).

    All columns of ``requests`` stay, such as its hour segments; the time of writing is
    added as ``generated_at_epoch``.
    """
    keys = list(keys)
    files = plan.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("fff", "product", "file", "status", "url"))).alias("downloads")
    )
    return requests.join(files, keys, "left").withColumn(
        "downloads",
        F.coalesce("downloads", F.array().cast(
            "array<struct<fff:int,product:string,file:string,status:string,url:string>>"
        )),
    ).withColumn("generated_at_epoch", F.unix_timestamp())


def storm_documents(points: DataFrame, part_rows: int = PART_ROWS, agency: str = "JMA + GFS") -> DataFrame:
    """Enriched points to storm documents; long tracks are written in parts."""
    placed = in_parts(
        points, ["storm_id"], ["advisory_time", "seq"], part_rows, F.unix_micros("advisory_time")
    )
    entry = F.struct(
        F.col("pos"),
        F.struct(
            "type",
            times.iso_utc(F.col("advisory_time")).alias("timestamp"),
            F.struct("lat", F.col("lon").alias("lng")).alias("location"),
            F.col("wind_kmh").alias("wind_speed"),
            "pressure_hpa",
            units.hpa_to_whole_mmhg(F.col("pressure_hpa")).alias("pressure_mmHg"),
            "forward_speed",
            "direction",
            F.lit(None).cast("string").alias("status_text"),
            "icon_tag",
            "cone_radius_km",
        ).alias("t"),
    )
    docs = placed.groupBy("storm_id", "part").agg(
        F.array_sort(F.collect_list(entry), lambda a, b: (a["pos"] - b["pos"]).cast("int")).alias("_e"),
        F.max_by("storm_name", "pos").alias("name"),
        F.max_by("basin", "pos").alias("basin"),
        F.max("advisory_time").alias("_last"),
    )
    return docs.select(
        F.struct(
            F.col("storm_id").cast("string").alias("storm_id"),
            "name",
            "basin",
            F.lit(agency).alias("agency_source"),
            times.iso_utc(F.col("_last")).alias("last_updated"),
        ).alias("metadata"),
        "part",
        F.transform("_e", lambda e: e["t"]).alias("track"),
    )


def series_payloads(
    rows: DataFrame, keys: Sequence[str], fields: Sequence[str], source: str = "open-meteo", part_rows: int = PART_ROWS
) -> DataFrame:
    """Time series rows to ``{source, timezone, count, fields, values}`` documents.

    ``rows`` carry the key columns, ``tz``, ``time_utc`` and the value fields.
    """
    keys, fields = list(keys), list(fields)
    timed = rows.withColumns(
        {
            "date_local": times.iso_local(F.col("time_utc"), F.col("tz")),
            "date_utc": times.iso_local(F.col("time_utc"), F.lit("UTC")),
        }
    )
    placed = in_parts(timed, keys, ["time_utc"], part_rows, F.unix_micros("time_utc"))
    value = lambda c: units.missing_to_null(F.col(c)).alias(c)
    record = F.struct("date_local", "date_utc", *[value(c) for c in fields])
    docs = placed.groupBy(*keys, "part").agg(
        F.first("tz").alias("timezone"),
        F.count(F.lit(1)).alias("count"),
        F.array_sort(F.collect_list(F.struct("pos", record.alias("r"))), lambda a, b: (a["pos"] - b["pos"]).cast("int")).alias("_v"),
    )
    return docs.select(
        *keys, "part", F.lit(source).alias("source"), "timezone", "count",
        F.lit(["date_local", "date_utc", *fields]).alias("fields"),
        F.transform("_v", lambda v: v["r"]).alias("values"),
    )


def replace_documents(documents: DataFrame, path: str, key: Sequence[str]) -> versions.Manifest:
    """Put JSON documents in place of those with the same key, all at once.

    A reader sees the documents as they were until every one is written, and a write that
    fails leaves them so.  Documents lie in a fixed number of buckets by a hash of their
    key, so there is no folder for each; nulls are written out.
    """
    known = versions.manifest(documents.sparkSession, path)
    return versions.commit(documents, path, key, known, kind="json", options={"ignoreNullFields": "false"}, carry=True)


def replace_storm_docs(documents: DataFrame, path: str) -> versions.Manifest:
    """``replace_documents`` by storm: all parts of a storm are replaced together."""
    return replace_documents(documents.withColumn("storm", F.col("metadata.storm_id")), path, ["storm"])


def read_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The documents that ``replace_documents`` last switched to."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = versions.read(spark, path, versions.manifest(spark, path), kind="json", schema=schema)
    return spark.createDataFrame([], schema) if rows is None else rows


def write_json(documents: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """One document per line, nulls written out; ``by`` names partition folders.

    With ``by``, only the folders that occur in ``documents`` are replaced.
    """
    writer = documents.write.mode("overwrite").option("ignoreNullFields", "false")
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    writer.json(path)
