"""Streaming queries: the given tables arrive as files, the result is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.plans import views
from galeframe.plans.registry import query
from galeframe.plans.run_queries import CODED, FEED_SQL
from galeframe.plans.track_queries import enriched_columns, folded_sql
from galeframe.plans.views import ENTRIES_SQL
from galeframe.session import scratch_dir
from galeframe.operators import feeds
from galeframe.streaming import tracks as live


def arriving(spark, sf, name):
    """A given table as a stream of files."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")


def landed(spark, stream, label):
    """Run a stream over what is there and read what it wrote."""
    path = scratch_dir(spark, label)
    live.write_stream(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("stream_feed", f"WITH {FEED_SQL} SELECT id, score, updated FROM sc WHERE {CODED}")
def _(spark, sf):
    entries = arriving(spark, sf, "pages").selectExpr("page_id", *views.ENTRY)
    return landed(spark, feeds.bulletin_entries(entries), "feed").select("id", "score", "updated")


SEEN = [c if not c.endswith("AS id") else "concat('urn:', CAST(page_id%97 AS STRING), '_VPTW60_') AS id" for c in views.ENTRY]


@query("stream_skip_processed", f"WITH {ENTRIES_SQL} SELECT DISTINCT concat('urn:', page_id%97, '_VPTW60_') AS id FROM entries")
def _(spark, sf):
    """Many entries share an id; each id is taken once, also by a second run over the feed
    that knows nothing but the ids that were taken."""
    path = scratch_dir(spark, "fresh")
    for run in "ab":
        entries = arriving(spark, sf, "pages").selectExpr("page_id", *SEEN)
        timed = entries.withColumn("updated", F.to_timestamp("updated"))
        live.take_new(timed, f"{path}/taken", f"{path}/checkpoint-{run}").awaitTermination()
        live.ids_log(f"{path}/taken").compact(spark)
    return spark.read.parquet(f"{path}/taken").select("id")


def bulletin_log(spark, sf, late):
    """Two arrivals per storm, streamed one after the other into a point log.

    With ``late`` the older bulletin arrives second.  The first is in the snapshot when
    the tracks are read, the second is not.
    """
    stored, arrived = views.stored_points(spark, sf), views.arrived_points(spark, sf)
    path = scratch_dir(spark, "bulletins")
    for k, points in enumerate((arrived, stored) if late else (stored, arrived)):
        points.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(points.schema).parquet(f"{path}/in")
        live.log_bulletins(stream, f"{path}/log", f"{path}/checkpoint").awaitTermination()
        if k == 0:
            live.compact_tracks(spark, f"{path}/log", late_safe=late)
    return live.current_tracks(spark, f"{path}/log", late_safe=late)


@query("stream_merge_tracks", folded_sql("batch_seq"))
def _(spark, sf):
    return enriched_columns(bulletin_log(spark, sf, late=False))


@query("stream_late_bulletin", folded_sql("issue_time"))
def _(spark, sf):
    return enriched_columns(bulletin_log(spark, sf, late=True))
