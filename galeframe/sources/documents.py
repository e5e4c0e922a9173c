"""JSON documents and tables with one array per value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions import times

_PRODUCT = (
    "struct<required_vars:array<string>,required_levels:array<string>,"
    "fff_available:array<int>,segments:array<array<int>>>"
)
MAP_INFO = f"struct<products:map<string,{_PRODUCT}>,union_fff:array<int>,union_segments:array<array<int>>>"
AVAILABILITY = (
    "run_date string, run_hour int, max_fff int, fff_existing array<int>, "
    "fff_existing_segments array<array<int>>, map_type string, "
    f"map_info {MAP_INFO}, map_types map<string,{MAP_INFO}>"
)


def read_availability(spark: SparkSession, path: str) -> DataFrame:
    """Availability files, one document per file."""
    return spark.read.schema(AVAILABILITY).option("multiLine", "true").json(path)


def parse_availability(documents: DataFrame, json: str = "json") -> DataFrame:
    """Availability text to columns; unreadable text gives nulls."""
    keys = [c for c in documents.columns if c != json]
    return documents.select(*keys, F.from_json(F.col(json), AVAILABILITY).alias("_d")).select(*keys, "_d.*")


def listed_hours(map_type: Column) -> Column:
    """Sorted distinct hours a per-map or combined document lists for a map."""
    of_map = F.when(
        F.col("map_info").isNotNull(), F.coalesce("map_info.union_fff", F.array().cast("array<int>"))
    ).otherwise(F.try_element_at(F.col("map_types"), map_type)["union_fff"])
    return F.array_sort(F.array_distinct(of_map))


STORM_DOC = (
    "metadata struct<storm_id:string,name:string,basin:string,agency_source:string,last_updated:string>, "
    "part int, track array<struct<type:string,timestamp:string,location:struct<lat:double,lng:double>,"
    "wind_speed:double,pressure_hpa:double,pressure_mmHg:int,forward_speed:double,direction:string,"
    "status_text:string,icon_tag:string,cone_radius_km:double>>"
)
# As ``sinks.replace_storm_docs`` keeps them.
STORM_DOC_KEYED = f"{STORM_DOC}, storm string"


def read_storm_docs(spark: SparkSession, path: str) -> DataFrame:
    """Storm documents to track points; a path without files gives no rows."""
    reader = spark.read.schema(STORM_DOC).option("recursiveFileLookup", "true")
    try:
        files = reader.json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], STORM_DOC)
    return storm_doc_points(files)


def storm_doc_points(documents: DataFrame) -> DataFrame:
    rows = documents.select("metadata", "part", F.posexplode("track").alias("pos", "t"))
    return rows.select(
        F.col("metadata.storm_id").alias("storm_id"),
        F.col("metadata.name").alias("storm_name"),
        F.col("metadata.basin").alias("basin"),
        "part", "pos",
        F.to_timestamp("t.timestamp").alias("advisory_time"),
        F.col("t.location.lat").alias("lat"),
        F.col("t.location.lng").alias("lon"),
        F.col("t.type").alias("type"),
        F.col("t.wind_speed").alias("wind_kmh"),
        F.col("t.pressure_hpa").alias("pressure_hpa"),
        F.col("t.icon_tag").alias("icon_tag"),
        F.col("t.forward_speed").alias("forward_speed"),
        F.col("t.direction").alias("direction"),
        F.col("t.cone_radius_km").alias("cone_radius_km"),
    )


def array_rows(table: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Parallel arrays to one row per position (``pos`` from 0); other columns stay."""
    keys = [c for c in table.columns if c not in arrays]
    zipped = F.arrays_zip(*arrays)
    return table.select(*keys, F.posexplode(zipped).alias("pos", "r")).select(*keys, "pos", "r.*")


def preview(table: DataFrame, arrays: Sequence[str], n: int = 5) -> DataFrame:
    """Length and first ``n`` elements of each array column."""
    keys = [c for c in table.columns if c not in arrays]
    shown = [x for a in arrays for x in (F.size(a).alias(f"{a}_len"), F.slice(a, 1, n).alias(a))]
    return table.select(*keys, *shown)


def hourly_times(start: Column, end: Column, interval_s: Column) -> Column:
    """Time grid from ``start`` (included) to ``end`` (excluded)."""
    count = F.ceil((F.unix_micros(end) - F.unix_micros(start)) / (interval_s * F.lit(1e6)))
    steps = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    return F.transform(
        steps, lambda i: F.timestamp_micros(F.unix_micros(start) + i * interval_s.cast("long") * F.lit(1_000_000))
    )


def hourly_rows(table: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Series with start, end, interval and value arrays to one row per time."""
    timed = table.withColumn(
        "time_utc", hourly_times(F.col("time_start"), F.col("time_end"), F.col("interval_s"))
    ).drop("time_start", "time_end", "interval_s")
    rows = array_rows(timed, ["time_utc", *arrays]).filter(F.col("time_utc").isNotNull())
    return rows.withColumn("time_local", F.from_utc_timestamp("time_utc", F.col("tz")))


def with_iso_times(rows: DataFrame) -> DataFrame:
    return rows.withColumn("iso_local", times.iso_local(F.col("time_utc"), F.col("tz"))).withColumn(
        "iso_utc", times.iso_local(F.col("time_utc"), F.lit("UTC"))
    )
