"""File listings and index text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions import text


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Names and sizes below ``path``; file content is not read."""
    found = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").load(path)
    )
    return found.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size_bytes")
    )


def advisory_files(files: DataFrame, five_day: bool = True) -> DataFrame:
    """Track, cone and five-day files with their advisory number (-1 if none)."""
    name = F.col("file")
    return files.withColumns(
        {
            "kind": F.when(name.endswith("adv_TRACK.kmz"), "track")
            .when(name.endswith("adv_CONE.kmz"), "cone")
            .when(name.rlike(r"5day_.*\.zip$"), "five_day")
            .otherwise("other"),
            "adv": text.advisory_number(name, five_day),
        }
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index files as lines; run and hour come from folder and file name."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    source = F.col("_metadata.file_path")
    return index_lines(
        lines.select(
            "line",
            F.to_date(text.found(source, r"gfs\.(\d{8})/"), "yyyyMMdd").alias("run_date"),
            text.found(source, r"\.t(\d{2})z\.").cast("int").alias("run_hour"),
            text.found(source, r"\.f(\d{3})(?:\.idx)?$").cast("int").alias("fff"),
        )
    )


def index_lines(lines: DataFrame) -> DataFrame:
    """Add ``var`` and ``level`` from ``n:offset:date:VAR:level:...`` lines."""
    part = F.split("line", ":")
    return lines.filter(F.length(F.trim("line")) > 0).withColumns(
        {"var": F.get(part, F.lit(3)), "level": F.get(part, F.lit(4))}
    )
