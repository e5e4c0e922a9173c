"""Tables kept in buckets, of which a manifest names the valid version of each.

A write puts the buckets it changes under a new version, beside the old ones, and then
writes the manifest of that version, one small file.  Readers take the newest manifest
that is there and nothing it does not name, so a write that fails half-way changes
nothing for them, and its rest is overwritten by the next write.  Buckets that a write
does not touch are not copied: the manifest goes on naming their older version.

A manifest has one row to a bucket and one to a mark (a source and how far it was read),
so it does not grow with the data.  One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from galeframe.session import removed

BUCKETS = 64
_ENTRY = "bucket int, at long, mark string, reached long, buckets int, gf_version long"


@dataclass(frozen=True)
class Manifest:
    version: int = 0  # 0: nothing was written yet
    at: dict[int, int] = field(default_factory=dict)  # bucket -> its version
    marks: dict[str, int] = field(default_factory=dict)
    buckets: int = BUCKETS


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The newest manifest, or that of a version."""
    try:
        entries = spark.read.schema(_ENTRY).option("basePath", f"{path}/manifest").json(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return Manifest()
        raise
    if version is None:
        version = entries.agg(F.max("gf_version")).collect()[0][0]
    rows = entries.where(F.col("gf_version") == version).collect() if version else []
    if not rows:
        return Manifest()
    return Manifest(
        version,
        {r["bucket"]: r["at"] for r in rows if r["bucket"] is not None},
        {r["mark"]: r["reached"] for r in rows if r["mark"] is not None},
        rows[0]["buckets"],
    )


def bucket_of(key: Sequence[str], buckets: int):
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def changed_buckets(rows: DataFrame, key: Sequence[str], buckets: int) -> list[int]:
    """Buckets that ``rows`` fall into: as many numbers as there are buckets, at most."""
    return sorted(r[0] for r in rows.select(bucket_of(key, buckets).alias("b")).distinct().collect())


def read(spark: SparkSession, path: str, known: Manifest, only: Sequence[int] | None = None, kind: str = "parquet", schema: StructType | None = None) -> DataFrame | None:
    """Rows of the buckets a manifest names (or of those in ``only``);
    None where there are none.  Folders of other buckets and versions are pruned."""
    wanted: dict[int, list[int]] = {}
    for bucket, version in known.at.items():
        if only is None or bucket in set(only):
            wanted.setdefault(version, []).append(bucket)
    if not wanted:
        return None
    reader = spark.read.option("basePath", f"{path}/data")
    if schema:
        reader = reader.schema(StructType([*schema.fields, StructField("gf_version", LongType()), StructField("gf_bucket", IntegerType())]))
    rows = reader.format(kind).load([f"{path}/data/gf_version={v}" for v in sorted(wanted)])
    valid = F.lit(False)
    for version, buckets in wanted.items():
        valid = valid | ((F.col("gf_version") == version) & F.col("gf_bucket").isin(buckets))
    return rows.where(valid).drop("gf_version", "gf_bucket")


def commit(
    rows: DataFrame,
    path: str,
    key: Sequence[str],
    known: Manifest,
    marks: dict[str, int] | None = None,
    kind: str = "parquet",
    options: dict | None = None,
    touched: Sequence[int] = (),
    carry: bool = False,
) -> Manifest:
    """Write the buckets of ``rows`` as the next version and switch to it.

    ``rows`` are all rows of their buckets; with ``carry`` they replace the rows of their
    own keys only, and other rows of the buckets are copied.  Buckets without rows keep
    their version, but for those in ``touched``, whose rows have all gone.
    """
    spark, version = rows.sparkSession, known.version + 1
    target = f"{path}/data/gf_version={version}"

    def put(some: DataFrame, mode: str) -> None:
        # Rebalancing splits large buckets over tasks and merges small ones.
        placed = some.withColumn("gf_bucket", bucket_of(key, known.buckets)).hint("rebalance", "gf_bucket")
        placed.write.mode(mode).format(kind).options(**(options or {})).partitionBy("gf_bucket").save(target)

    put(rows, "overwrite")
    schema = StructType([*rows.schema.fields, StructField("gf_bucket", IntegerType())])
    written = spark.read.option("basePath", target).schema(schema).format(kind).load(target)
    new = {r[0]: version for r in written.select("gf_bucket").distinct().collect()}
    if carry and (old := read(spark, path, known, only=list(new), kind=kind, schema=rows.schema)) is not None:
        fresh = written.select(*(F.col(k).alias(f"gf_{k}") for k in key)).distinct()
        same = reduce(lambda a, b: a & b, (old[k].eqNullSafe(fresh[f"gf_{k}"]) for k in key))
        put(old.join(fresh, same, "left_anti"), "append")
    old_at = {b: v for b, v in known.at.items() if b not in set(touched)}
    after = Manifest(version, old_at | new, known.marks | (marks or {}), known.buckets)
    entries = [(b, v, None, None, known.buckets) for b, v in after.at.items()]
    entries += [(None, None, m, n, known.buckets) for m, n in after.marks.items()]
    entries = entries or [(None, None, None, None, known.buckets)]
    small = spark.createDataFrame(entries, _ENTRY.removesuffix(", gf_version long"))
    small.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/gf_version={version}")
    return after


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove what the last ``keep`` manifests do not name; how many folders went.

    Readers that took an older manifest must be done.
    """
    entries = spark.read.schema(_ENTRY).option("basePath", f"{path}/manifest").json(f"{path}/manifest")
    rows = entries.select("gf_version", "bucket", "at").collect()  # of few manifests
    versions = sorted({r[0] for r in rows}, reverse=True)
    named = {(r["at"], r["bucket"]) for r in rows if r["gf_version"] in versions[:keep]}
    old = {(r["at"], r["bucket"]) for r in rows if r["bucket"] is not None} - named
    gone = sum(removed(spark, f"{path}/data/gf_version={at}/gf_bucket={bucket}") for at, bucket in sorted(old))
    for version in versions[keep:]:
        removed(spark, f"{path}/manifest/gf_version={version}")
    return gone


@dataclass(frozen=True)
class Folded:
    """The fold of a log of arrivals, kept up to a batch and carried on from there.

    The log is a Parquet table in partitions ``run`` and ``batch_seq``.  ``fold`` must give
    the same for a log and for its folded part together with the rest, and keep the rows
    of one key apart from others; then so do readings at any state of compaction.
    """

    log: str
    state: str
    key: Sequence[str]
    fold: Callable[[DataFrame], DataFrame]
    buckets: int = BUCKETS

    def _known(self, spark: SparkSession) -> Manifest:
        known = manifest(spark, self.state)
        return known if known.version else Manifest(buckets=self.buckets)

    def _newer(self, spark: SparkSession, known: Manifest) -> DataFrame:
        """Arrivals behind the marks; folders of earlier batches are pruned."""
        rows = spark.read.parquet(self.log)
        for run, reached in known.marks.items():
            rows = rows.where((F.col("run") != run) | (F.col("batch_seq") > reached))
        return rows

    def rows(self, spark: SparkSession) -> DataFrame:
        """Folded rows and newer arrivals together, to be folded once more."""
        known = self._known(spark)
        newer = self._newer(spark, known)
        old = read(spark, self.state, known)
        return newer if old is None else old.unionByName(newer, allowMissingColumns=True)

    def compact(self, spark: SparkSession, before: tuple[str, int] | None = None, keep: int = 2) -> Manifest:
        """Fold what arrived since into the buckets it belongs to.

        Other buckets are neither read nor written.  Safe to repeat: arrivals count as
        folded only once the manifest says so.  ``before`` names a run and a batch of it
        that is still being written: this and later ones of the run stay out.
        """
        known = self._known(spark)
        newer = self._newer(spark, known)
        if before:
            newer = newer.where((F.col("run") != before[0]) | (F.col("batch_seq") < before[1]))
        marks = {r["run"]: r["b"] for r in newer.groupBy("run").agg(F.max("batch_seq").cast("long").alias("b")).collect()}
        if not marks:
            return known
        changed = changed_buckets(newer, self.key, known.buckets)
        old = read(spark, self.state, known, only=changed)
        rows = newer if old is None else old.unionByName(newer, allowMissingColumns=True)
        after = commit(self.fold(rows), self.state, self.key, known, marks, touched=changed)
        expire(spark, self.state, keep)
        return after
