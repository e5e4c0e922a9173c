"""Storm tracks kept up to date from a stream of bulletins.

Arrivals are appended to a point log, one partition per query run and micro-batch, and
the state of a storm is the fold of its log in the order of the bulletins' issue times.
A replayed batch overwrites its own partition, a new checkpoint folder begins a new run
beside the old ones, and equal points of several runs fold into one; so the state does
not depend on how arrivals fell into micro-batches.

The fold up to a batch is kept in buckets of storms (``versions``).  A read folds the
snapshot together with what arrived since; ``compact_tracks`` carries the snapshot on and
touches only the buckets of storms that arrivals belong to.  Ids of feed entries are kept
the same way, for good.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.operators import feeds
from galeframe.operators.tracks import dedupe_track, fold_batches, latest_issue
from galeframe.versions import Folded, Manifest

# Batches between two compactions.
COMPACT_EVERY = 16
# Ids of a micro-batch that are broadcast to look for them among those seen.
IDS_AT_ONCE = 1_000_000


def new_entries(entries: DataFrame, delay: str = "7 days") -> DataFrame:
    """Bulletin entries of a feed stream that were not seen before, with scores.

    An id is remembered for ``delay`` after it arrived. Time is counted by arrival, so an
    entry comes through however old its ``updated`` is.
    """
    arrived = entries.withColumn("_arrived", F.current_timestamp())
    fresh = arrived.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(["id"])
    return feeds.bulletin_entries(fresh.drop("_arrived"))


def write_stream(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None):
    """Append a stream to parquet; by default take what is there and stop."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def _run(batch: DataFrame) -> str:
    """The id of a streaming query; it lives in its checkpoint folder."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "run"


def _append(batch: DataFrame, batch_id: int, log: str) -> None:
    """A micro-batch as its own partition of a log, which a replay overwrites."""
    (
        batch.withColumn("run", F.lit(_run(batch))).withColumn("batch_seq", F.lit(batch_id))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run", "batch_seq").parquet(log)
    )


def _start(stream: DataFrame, each, checkpoint: str, trigger: dict | None):
    return (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def log_bulletins(points: DataFrame, log: str, checkpoint: str, trigger: dict | None = None, compact_every: int = COMPACT_EVERY):
    """Append each micro-batch of bulletin points to the log as its own partition, and
    carry the snapshot of tracks on after every ``compact_every`` of them (0: never)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        if compact_every and batch_id and batch_id % compact_every == 0:
            compact_tracks(batch.sparkSession, log, before=(_run(batch), batch_id))
        _append(batch, batch_id, log)

    return _start(points, each, checkpoint, trigger)


def _order(late_safe: bool, columns: list[str]) -> str:
    return "issue" if late_safe and "issue_time" in columns else "arrival"


def _turns(points: DataFrame) -> DataFrame:
    """Points with ``_turn``: their micro-batch, then their issue time if they have one."""
    issue = F.to_timestamp(F.lit("0001-01-01"))
    if "issue_time" in points.columns:
        issue = F.coalesce("issue_time", issue)
    return points.withColumn("_turn", F.struct("batch_seq", issue.alias("issue")))


def _newest(points: DataFrame, order: str) -> DataFrame:
    """The log reduced to one row for each point of a storm.

    Of equal points the latest wins however often this is done, and every row that is
    dropped would be dropped by a later fold as well.
    """
    if order == "arrival":
        return dedupe_track(_turns(points), ("_turn", "seq")).drop("_turn")
    dated = points.withColumn("_issue", F.coalesce("issue_time", F.to_timestamp(F.lit("0001-01-01"))))
    return dedupe_track(dated, ("_issue", "seq")).drop("_issue")


def tracks_log(log: str, order: str = "issue") -> Folded:
    """The log of bulletins and its snapshot, in one of the two orders of a fold."""
    return Folded(log, f"{log.rstrip('/')}.{order}", ["storm_id"], lambda points: _newest(points, order))


def compact_tracks(spark: SparkSession, log: str, late_safe: bool = True, before: tuple[str, int] | None = None) -> Manifest:
    """Carry the snapshot on to the end of the log, or to a batch that may be replayed."""
    order = _order(late_safe, spark.read.parquet(log).columns)
    return tracks_log(log, order).compact(spark, before)


def current_tracks(spark: SparkSession, log: str, late_safe: bool = True) -> DataFrame:
    """Merged and enriched tracks from the log, by issue time.

    Without ``late_safe`` by arrival: micro-batches in their order, and the bulletins of
    one by issue time. Points that carry no issue time can only be taken by arrival.
    What a snapshot holds already is read from there.
    """
    order = _order(late_safe, spark.read.parquet(log).columns)
    points = tracks_log(log, order).rows(spark).drop("run")
    if order == "issue":
        return latest_issue(points)
    return fold_batches(_turns(points), "_turn").drop("_turn")


def ids_log(taken: str) -> Folded:
    """Taken entries and the snapshot of their ids."""
    return Folded(taken, f"{taken.rstrip('/')}.ids", ["id"], lambda rows: rows.select("id").distinct())


def take_new(entries: DataFrame, taken: str, checkpoint: str, trigger: dict | None = None, compact_every: int = COMPACT_EVERY, at_once: int = IDS_AT_ONCE):
    """Append the bulletin entries of a feed stream whose id was never taken before.

    An id is remembered for good, also by later runs with another checkpoint folder.  Of
    several entries of one id in a micro-batch the one updated first is taken.  A replayed
    batch does not see itself, and writes the same rows again.

    Ids seen are looked up from the side of the batch: its ids are broadcast up to
    ``at_once`` of them, so the table of seen ids is scanned in place; beyond that Spark
    joins the two, with a Bloom filter of the batch's ids in front of the scan.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, run = batch.sparkSession, _run(batch)
        if compact_every and batch_id and batch_id % compact_every == 0:
            ids_log(taken).compact(spark, before=(run, batch_id))
        coded = feeds.bulletin_entries(batch)
        first = F.min_by(F.struct(*coded.columns), F.struct("updated", F.xxhash64(*coded.columns))).alias("e")
        fresh = coded.groupBy("id").agg(first).select("e.*").persist()
        try:
            seen = _taken_before(spark, taken, run, batch_id)
            if seen is not None:
                ids = fresh.select("id")
                ids = F.broadcast(ids) if ids.count() <= at_once else ids
                again = seen.join(ids, "id", "left_semi").distinct()
                fresh_rows = fresh.join(again, "id", "left_anti")
            else:
                fresh_rows = fresh
            _append(fresh_rows, batch_id, taken)
        finally:
            fresh.unpersist()

    return _start(entries, each, checkpoint, trigger)


def _taken_before(spark: SparkSession, taken: str, run: str, batch_id: int) -> DataFrame | None:
    """Ids of all batches but this one, None before the first."""
    try:
        rows = ids_log(taken).rows(spark)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    own = (F.col("run") == run) & (F.col("batch_seq") >= batch_id)
    return rows.where(~F.coalesce(own, F.lit(False))).select("id")
