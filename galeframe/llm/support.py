"""Helpers shared by the operators: session settings, batches, shared tables."""

from __future__ import annotations

import gc
import os
import site
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from galeframe.session import prepare, scratch_dir

# Rows of a batch handed to Python.  Whole texts travel in it, so it is far below
# Spark's default of 10,000.
BATCH_ROWS = 1000
# Bytes of a batch; it may exceed them by one row.
BATCH_BYTES = 8 << 20


ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Let the executors import this package if it is not on their path already."""
    known = {*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd(), *site.getsitepackages()}
    if str(ROOT) in known or getattr(spark.sparkContext, "_galeframe_sent", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "galeframe.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((ROOT / "galeframe").rglob("*.py")):
            out.write(path, path.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._galeframe_sent = True


def ready(spark: SparkSession) -> SparkSession:
    """The session settings of the library, the batch size above, and the package sent."""
    prepare(spark)
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    Cuts lineage: every later reader sees the same rows, also after a lost executor.
    """
    path = scratch_dir(df.sparkSession, label)
    # Lets Spark drop the shuffle files of tables that were written before.
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """Partitions for a shuffle that AQE must not merge."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mapped(df: DataFrame, step: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """``step`` on every Arrow batch; it returns columns by name, or None for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None:
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def extended(df: DataFrame, column: str, step: Callable[[pa.Array], dict], schema: str) -> DataFrame:
    """``df`` with the columns that ``step`` makes of one of its columns, without a shuffle."""
    at, own = df.columns.index(column), len(df.columns)
    numbered = df.toDF(*(f"c{k}" for k in range(own)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                new = {n: pa.array(v) if not isinstance(v, pa.Array) else v for n, v in step(batch.column(at)).items()}
                yield pa.RecordBatch.from_arrays([*batch.columns, *new.values()], [*batch.schema.names, *new])

    extra = StructType.fromDDL(schema)
    out = numbered.mapInArrow(run, StructType([*numbered.schema.fields, *extra.fields]))
    return out.toDF(*df.columns, *extra.names)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and the offsets of the rows (null: empty)."""
    column = column.fill_null("") if column.null_count else column
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]
