"""Session settings the library relies on, and its scratch space."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings. They may be set on a running session, so a caller that
# brings its own session gets the same results.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join input even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM does not compile methods over 8000 bytes; wide projections run faster
    # when such a stage falls back to separately compiled expressions.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings above to ``spark`` and return it."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    The library never makes up a folder: one on the driver's disk would not be seen by
    the executors of a cluster.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return shared


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, unused folder name for intermediate files.

    It lies in the shared folder named by ``spark.checkpoint.dir``.
    """
    return f"{shared_dir(spark).rstrip('/')}/galeframe/{label}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> bool:
    """Delete a folder or file in whatever store its path names; whether it was there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return bool(store.delete(place, True))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the reliable checkpoint folder.

    Used for small results that two branches of a plan must agree on, also after an
    executor is lost.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
