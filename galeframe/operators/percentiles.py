"""Exact percentiles of keys that are too large for one task.

``percentile`` keeps the distinct values of a key in one task.  Here a key with more
than ``galeframe.hot.rows`` values is searched instead: a pass counts the values of the
span that holds a wanted rank in ``BINS`` equal bins, and the bin with the rank, cut to
the smallest and largest value in it, is the span of the next pass.  Counts combine
map-side; a pass shuffles ``BINS`` rows a span and task at most.  Spans end as one value or
with so few values that one task sorts them.  Bounds of a span are values of the data, so every
pass leaves values behind; evenly spread values need one pass for each factor of ``BINS``,
values over many powers of ten one for each three of these at worst.

Keys under the limit take ``percentile`` in one aggregate, with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.operators.ordered import hot_limits, joined
from galeframe.session import checkpointed

BINS = 1024


def percentiles(df: DataFrame, keys: Sequence[str], value: Column, probs: Sequence[float]) -> DataFrame:
    """``keys``, ``_q`` (percentiles between neighbours, in the order of ``probs``), ``_lo``, ``_hi``.

    Null and NaN are missing; a key without values has nulls.  Null keys are keys like
    others.  The sizes of keys are counted while the plan is built.
    """
    v = value.cast("double")
    source = df.select(*keys, F.when(~F.isnan(v), v).alias("_v"))
    limit, _ = hot_limits(df)
    sizes = source.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    hot = checkpointed(sizes.where(F.col("_n") > limit))
    if hot.isEmpty():
        return _plain(source, keys, probs)
    named = hot.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    searched = _searched(joined(source, hot.select(*keys), keys), hot, keys, probs, limit)
    return _plain(source.join(named, same, "left_anti"), keys, probs).unionByName(searched)


def _plain(source: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    return source.groupBy(*keys).agg(
        F.percentile("_v", F.lit(list(probs))).alias("_q"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )


def _within(source: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values of the spans of ``wanted``, once for each different span."""
    spans = wanted.select(*keys, "_lo", "_hi").distinct()
    return joined(source, spans, keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def _searched(source: DataFrame, hot: DataFrame, keys: Sequence[str], probs: Sequence[float], limit: int) -> DataFrame:
    keys = list(keys)
    span = [*keys, "_lo", "_hi"]
    at = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    ranks = [
        F.struct(F.lit(i).alias("_i"), F.lit(side).alias("_side"), a.alias("_at"), end(a).cast("long").alias("_rank"))
        for i, a in enumerate(at)
        for side, end in enumerate((F.floor, F.ceil))
    ]
    wanted = hot.select(*keys, "_n", "_lo", "_hi", F.inline(F.array(*ranks)))
    is_open = (F.col("_n") > limit) & (F.col("_lo") < F.col("_hi"))
    while not (open_ := wanted.where(is_open)).isEmpty():
        width = F.col("_hi") - F.col("_lo")
        # Every step of the linear rule keeps the order of values; a width beyond doubles
        # has zero inside.
        bin_ = F.when(width == float("inf"), F.when(F.col("_v") < 0, 0).otherwise(BINS - 1)).otherwise(
            F.least(F.floor((F.col("_v") - F.col("_lo")) / width * BINS), F.lit(BINS - 1))
        )
        counts = (
            _within(source, open_, keys)
            .groupBy(*span, bin_.cast("int").alias("_bin"))
            .agg(F.count("_v").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        )
        before = Window.partitionBy(*span).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        found = joined(open_, counts, span).where(
            (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c"))
        )
        found = found.select(
            *keys, F.col("_c").alias("_n"), F.col("_a").alias("_lo"), F.col("_b").alias("_hi"),
            "_i", "_side", "_at", (F.col("_rank") - F.col("_before")).alias("_rank"),
        )
        wanted = checkpointed(found.unionByName(wanted.where(~is_open)))
    rest = wanted.where(F.col("_lo") < F.col("_hi"))
    placed = _within(source, rest, keys).withColumn(
        "_rank", (F.row_number().over(Window.partitionBy(*span).orderBy("_v")) - 1).cast("long")
    )
    values = joined(rest, placed, [*span, "_rank"]).select(*keys, "_i", "_side", "_at", "_v")
    values = values.unionByName(
        wanted.where(F.col("_lo") == F.col("_hi")).select(*keys, "_i", "_side", "_at", F.col("_lo").alias("_v"))
    )
    low, high = (F.max(F.when(F.col("_side") == side, F.col("_v"))) for side in (0, 1))
    part = F.max("_at") - F.floor(F.max("_at"))
    one = values.groupBy(*keys, "_i").agg(F.when(part == 0, low).otherwise((1 - part) * low + part * high).alias("_p"))
    # One element for each of ``probs``.
    every = F.sort_array(F.collect_list(F.struct("_i", "_p")))
    found = one.groupBy(*keys).agg(F.transform(every, lambda x: x["_p"]).alias("_q"))
    return joined(found, hot.drop("_n"), keys)
