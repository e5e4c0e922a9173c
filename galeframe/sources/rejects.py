"""Sources read with their rejects: what could not be used, and why, as a table.

Nothing is dropped silently.  A text that does not parse, an entry without readable time
or place, and a file that is no whole Parquet file each become a row with a reason; an
``Observation`` given to a check counts them while the rows are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from galeframe.functions import text
from galeframe.sources import markup

# Unreadable files whose names a reader leaves out of its scan; more are an error.
MOST_FILES = 10_000


@dataclass(frozen=True)
class Checked:
    """Usable rows, and one row with ``reason`` to everything that is none."""

    rows: DataFrame
    rejects: DataFrame


def xml_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, xml): every file whole, so that a cut-off one is seen as such."""
    whole = spark.read.option("wholetext", "true").text(path)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("xml"))


def _parsed(documents: DataFrame, xml: str, schema: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    keys = [c for c in documents.columns if c != xml]
    parsed = F.from_xml(F.col(xml), f"{schema}, _corrupt string", options).alias("_d")
    return documents.select(*keys, (F.trim(F.coalesce(F.col(xml), F.lit(""))) == "").alias("_blank"), parsed)


def _document_reason(body: str) -> Column:
    return (
        F.when(F.col("_blank"), "empty").when(F.col("_d").isNull() | F.col("_d._corrupt").isNotNull(), "malformed")
        .when(F.col(f"_d.{body}").isNull(), "no report")
    )


def bulletins(documents: DataFrame, xml: str = "xml", metrics: Observation | None = None) -> Checked:
    """Storm bulletins to points, and rejects (keys, seq, reason, value).

    A document is ``empty``, ``malformed`` or has ``no report``; an entry of a good one has
    ``no time``, a ``time`` that is none, ``no coordinate``, or a ``coordinate`` that is
    none, with the text in ``value``.  ``metrics`` receives ``documents`` and
    ``rejected_documents`` when the points are used.  Use ``checkpointed`` documents, or
    cached ones, to parse only once for both.
    """
    keys = [c for c in documents.columns if c != xml]
    parsed = _parsed(documents, xml, markup.BULLETIN).withColumn("_reason", _document_reason("Body.MeteorologicalInfo"))
    if metrics is not None:
        parsed = parsed.observe(metrics, F.count(F.lit(1)).alias("documents"), F.count("_reason").alias("rejected_documents"))
    good = parsed.where("_reason IS NULL")
    points = markup.bulletin_points(good.select(*keys, "_d.Head", "_d.Body"))

    def entry(i: Column, seq: Column) -> Column:
        time, place = text.blank_to_null(i["DateTime"]), text.blank_to_null(F.get(i["Item"], F.lit(0))["CenterPart"]["Coordinate"])
        unplaced = text.signed_pair_lat(place).isNull() | text.signed_pair_lon(place).isNull()
        reason = (
            F.when(time.isNull(), "no time").when(F.try_to_timestamp(time).isNull(), "time")
            .when(place.isNull(), "no coordinate").when(unplaced, "coordinate")
        )
        value = F.when(reason == "time", time).when(reason == "coordinate", place)
        return F.struct(seq.cast("int").alias("seq"), reason.alias("reason"), value.alias("value"))

    none = F.lit(None)
    whole = F.array(F.struct(none.cast("int").alias("seq"), F.col("_reason").alias("reason"), none.cast("string").alias("value")))
    entries = F.filter(F.transform("_d.Body.MeteorologicalInfo", entry), lambda r: r["reason"].isNotNull())
    # Documents and entries in one pass, and an outer explode with the condition after it:
    # others are pushed below the parser and make it run again.
    rejected = parsed.select(*keys, F.explode_outer(F.when(F.col("_reason").isNotNull(), whole).otherwise(entries)).alias("_r"))
    return Checked(points, rejected.where("_r.reason IS NOT NULL").select(*keys, "_r.seq", "_r.reason", "_r.value"))


def read_bulletins(spark: SparkSession, path: str, metrics: Observation | None = None) -> Checked:
    """``bulletins`` of all files of a folder."""
    return bulletins(xml_files(spark, path), metrics=metrics)


def placemark_files(documents: DataFrame, xml: str = "xml") -> Checked:
    """Placemarks, and rejects (keys, reason) for files that are ``empty``, ``malformed``
    or hold ``no placemark``."""
    keys = [c for c in documents.columns if c != xml]
    shape = "Document struct<name:string>, Folder struct<name:string>, Placemark struct<name:string>"
    keyed = documents.withColumn("_marks", F.coalesce(F.col(xml).rlike(r"<(?:\w+:)?Placemark\b"), F.lit(False)))
    malformed = F.col("_d").isNull() | F.col("_d._corrupt").isNotNull()
    reason = F.when(F.col("_blank"), "empty").when(malformed, "malformed").when(~F.col("_marks"), "no placemark")
    rejected = _parsed(keyed, xml, shape).withColumn("reason", reason)
    rejected = rejected.where("reason IS NOT NULL").select(*keys, "reason")
    return Checked(markup.parse_placemarks(documents, xml), rejected)


def parquet_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, reason) of files in a folder that are no whole Parquet files.

    Every file is listed and every readable one counted by its footer, without reading a
    column.  Files that gave no row are looked at: ``no Parquet file`` or ``cut off``.  A
    whole file without rows is no reject; a file without any byte is seen by none of
    Spark's readers and is in neither.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = listed.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), "path")
    # Only here are unreadable files passed over, to find out which they are.
    counted = spark.read.schema("gf_none int").option("ignoreCorruptFiles", "true").parquet(path)
    counted = counted.select(F.col("_metadata.file_path").alias("file")).distinct()
    odd = listed.join(counted, "file", "left_anti").limit(MOST_FILES + 1).collect()
    if len(odd) > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} files of {path} are unreadable")
    schema = "file string, size long, reason string"
    if not odd:
        return spark.createDataFrame([], schema)
    ends = spark.read.format("binaryFile").load([r["path"] for r in odd])
    head, tail = F.substring("content", 1, 4), F.substring("content", -4, 4)
    mark = F.lit("PAR1").cast("binary")  # how a Parquet file begins and ends
    reason = F.when(head != mark, "no Parquet file").when((tail != mark) | (F.col("length") < 12), "cut off")
    return ends.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), reason.alias("reason")).where("reason IS NOT NULL")


def read_parquet(spark: SparkSession, path: str) -> Checked:
    """A Parquet table without its unreadable files, and these as rejects (file, size, reason).

    Unreadable files are left out of the scan by name.  Whatever else goes wrong while
    reading, such as a damaged page in a file with a good footer, is an error.
    """
    bad = parquet_files(spark, path)
    names = [r["file"] for r in bad.select("file").collect()]  # MOST_FILES at most
    if not names:
        return Checked(spark.read.parquet(path), bad)
    # Columns from the footers of all files that have one, read by the executors.
    schema = spark.read.options(ignoreCorruptFiles="true", mergeSchema="true").parquet(path).schema
    rows = spark.read.schema(schema).parquet(path)
    return Checked(rows.where(~F.col("_metadata.file_path").isin(names)), bad)
