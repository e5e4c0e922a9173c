"""File inventories and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.functions import text, units


def file_entries(files: DataFrame) -> DataFrame:
    """Grid files with forecast hour and size in MB."""
    return files.filter(F.col("file").endswith(".grib2")).withColumns(
        {
            "fff": text.forecast_hour(F.col("file")),
            "size_mb": units.bytes_to_mb(F.col("size_bytes")),
        }
    )


def file_summary(files: DataFrame) -> DataFrame:
    """Per map type: files, total MB, sorted forecast hours (three digits each)."""
    return file_entries(files).groupBy("map_type").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.bround(F.sum("size_bytes") / F.lit(1048576.0), 3).alias("total_size_mb"),
        F.array_sort(F.collect_set("fff")).alias("fff_available"),
    )


def run_summary(log: DataFrame, files: DataFrame) -> DataFrame:
    """Per map type: files asked for, fetched and present, with total MB."""
    asked = log.groupBy("map_type").agg(
        F.count(F.lit(1)).alias("requested"),
        F.count_if(F.col("status") == "downloaded").alias("downloaded"),
    )
    present = file_summary(files).select(
        "map_type", F.col("file_count").alias("files_present"), "total_size_mb"
    )
    return asked.join(present, "map_type", "left").fillna(0, ["files_present"]).fillna(0.0, ["total_size_mb"])
