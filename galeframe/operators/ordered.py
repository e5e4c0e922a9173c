"""Ordered per-key values that do not put a whole key into one task.

A plain ``Window.partitionBy(storm_id)`` sends every row of a storm to one task.
Most storms are short, but one key may hold a large share of the table.  Here a
key with more than ``galeframe.hot.rows`` rows is cut along its order column into
pieces of about that size; each piece is a window partition of its own, and what
a piece needs from its neighbours (the row before it, a total, a running sum)
travels through one small table with a row per piece of a hot key.

Keys under the limit take the ordinary path: one piece, one shuffle, no carry.

Sizes: only keys above the limit are broadcast.  There are at most rows/limit of
them, with at most 2 * rows/limit cut points in total, whatever the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.session import checkpointed

HOT_ROWS = 1_000_000
HOT_PIECES = 2048


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null keys meet, with the columns of a using join."""
    named = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(named, same, how).drop(*[f"_k_{k}" for k in keys])


def hot_limits(df: DataFrame) -> tuple[int, int]:
    """Rows per key above which it is cut, and the most pieces it is cut into."""
    conf = df.sparkSession.conf
    return (
        int(conf.get("galeframe.hot.rows", str(HOT_ROWS))),
        int(conf.get("galeframe.hot.pieces", str(HOT_PIECES))),
    )


@dataclass(frozen=True)
class HotKeys:
    """Keys with too many rows for one task (``rows`` is None if there is none)."""

    rows: DataFrame | None


def hot_keys(df: DataFrame, keys: Sequence[str]) -> HotKeys:
    """The size check behind the choice of plan.

    One count by key, which reads the key columns only and combines map-side. A table
    with at least as many rows per key may stand in for one that is dear to compute.
    """
    limit, _ = hot_limits(df)
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counted.filter(F.col("_n") > limit)
    return HotKeys(None if hot.isEmpty() else hot)


def cut_hot_keys(df: DataFrame, keys: Sequence[str], order: Column, hot: DataFrame) -> DataFrame:
    """Add ``_piece`` (0 for ordinary keys) and ``_hot``; ``order`` is numeric.

    ``_piece`` never decreases along ``order`` and rows with equal ``order`` share
    a piece, so ordering inside pieces and then by piece is the full ordering.
    """
    limit, pieces = hot_limits(df)
    keys = list(keys)
    fractions = ", ".join(repr(i / pieces) for i in range(1, pieces))
    # Keep about n/limit of the candidate cut points.
    stride = F.greatest(
        F.lit(1), F.floor(F.lit(pieces) / F.ceil(F.col("_n") / F.lit(limit)))
    )
    # Cut points lie in blocks, so that finding a piece looks at the head of every
    # block and then into one block.
    width = math.isqrt(pieces) + 1
    block = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_cuts") - 1) / width).cast("int")),
        lambda j: F.slice("_cuts", j * width + 1, F.lit(width)),
    )
    # Approximate percentiles may differ between two evaluations, and rows and carried
    # values must use the same pieces, so the cut points are computed once and kept.
    cuts = checkpointed(
        df.select(*keys, order.cast("double").alias("_o"))
        .transform(joined, hot, keys)
        .groupBy(*keys, "_n")
        .agg(F.expr(f"percentile_approx(_o, array({fractions}), {5 * pieces})").alias("_q"))
        .select(
            *keys,
            F.array_distinct(F.filter("_q", lambda q, i: (i + 1) % stride == 0)).alias("_cuts"),
        )
        .filter(F.size("_cuts") > 0)
        .select(*keys, block.alias("_blocks"))
        .withColumn("_heads", F.transform("_blocks", lambda b: b[0]))
    )
    at = order.cast("double")
    passed = lambda points: F.size(F.filter(points, lambda c: c < at))
    marked = joined(df, cuts, keys, "left").withColumn("_block", passed("_heads"))
    inside = passed(F.get("_blocks", F.col("_block") - 1))
    return (
        marked.withColumn("_hot", F.col("_heads").isNotNull())
        .withColumn(
            "_piece",
            F.when(F.col("_hot") & (F.col("_block") > 0), (F.col("_block") - 1) * width + inside)
            .otherwise(F.lit(0)),
        )
        .drop("_blocks", "_heads", "_block")
    )


@dataclass(frozen=True)
class Frame:
    """The windows a value may use: inside a piece, and across a key's pieces."""

    rows: Window  # ordered rows of one piece
    piece: Window  # all rows of one piece
    pieces: Window  # ordered pieces of one key
    order: Column  # struct of the order columns, for max_by / min_by


@dataclass(frozen=True)
class Value:
    """How to compute one value: within a piece, per piece, and from neighbours."""

    local: Callable[[Frame], Column]
    total: Callable[[Frame], Column]
    carried: Callable[[Frame, str], Column]
    combine: Callable[[Column, Column], Column]


def previous(*columns: str) -> Value:
    """Struct of ``columns`` in the row before, null for a key's first row."""
    return Value(
        lambda f: F.lag(F.struct(*columns)).over(f.rows),
        lambda f: F.max_by(F.struct(*columns), f.order),
        lambda f, t: F.lag(t).over(f.pieces),
        lambda a, b: F.coalesce(a, b),
    )


def following(*columns: str) -> Value:
    """Struct of ``columns`` in the next row, null for a key's last row."""
    return Value(
        lambda f: F.lead(F.struct(*columns)).over(f.rows),
        lambda f: F.min_by(F.struct(*columns), f.order),
        lambda f, t: F.lead(t).over(f.pieces),
        lambda a, b: F.coalesce(a, b),
    )


def whole(aggregate: Callable[[Column], Column], column: Column) -> Value:
    """An aggregate that composes with itself (min, max, sum) over the whole key."""
    return Value(
        lambda f: aggregate(column).over(f.piece),
        lambda f: aggregate(column),
        lambda f, t: aggregate(F.col(t)).over(
            f.pieces.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ),
        lambda a, b: F.coalesce(b, a),
    )


def running_sum(column: Column) -> Value:
    """Sum of ``column`` from a key's first row up to and including this one."""
    return Value(
        lambda f: F.sum(column).over(
            f.rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
        lambda f: F.sum(column),
        lambda f, t: F.sum(t).over(f.pieces.rowsBetween(Window.unboundedPreceding, -1)),
        lambda a, b: F.coalesce(a + b, a, b),
    )


def position() -> Value:
    """1-based position of the row in its key (order columns must be unique)."""
    return running_sum(F.lit(1).cast("long"))


def row_count() -> Value:
    """Number of rows of the key."""
    return whole(F.sum, F.lit(1).cast("long"))


def last_known(value: Column) -> Value:
    """Latest non-null ``value`` at or before this row."""
    return Value(
        lambda f: F.last(value, True).over(
            f.rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
        lambda f: F.max_by(value, F.when(value.isNotNull(), f.order)),
        lambda f, t: F.last(t, True).over(
            f.pieces.rowsBetween(Window.unboundedPreceding, -1)
        ),
        lambda a, b: F.coalesce(a, b),
    )


def next_known(value: Column) -> Value:
    """Earliest non-null ``value`` at or after this row."""
    return Value(
        lambda f: F.first(value, True).over(
            f.rows.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        ),
        lambda f: F.min_by(value, F.when(value.isNotNull(), f.order)),
        lambda f, t: F.first(t, True).over(
            f.pieces.rowsBetween(1, Window.unboundedFollowing)
        ),
        lambda a, b: F.coalesce(a, b),
    )


def with_ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Value],
    cut_by: Column | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add (or replace) a column per entry of ``values``; all share one shuffle.

    ``order`` must rank the rows of a key; ``cut_by`` is the numeric form of its
    first column (by default the column itself).  ``hot`` is the size check if it was
    made before, else it is made here.
    """
    keys = list(keys)
    kept = [c for c in df.columns if c not in values]
    hot = hot or hot_keys(df, keys)
    if hot.rows is None:
        frame = _frame(keys, order, "_piece")
        return df.select(*kept, *[v.local(frame).alias(n) for n, v in values.items()])

    cut = cut_hot_keys(df, keys, F.col(order[0]) if cut_by is None else cut_by, hot.rows)
    frame = _frame(keys + ["_piece"], order, "_piece", keys)
    totals = (
        cut.filter("_hot")
        .groupBy(*keys, "_piece")
        .agg(*[v.total(frame).alias(f"_t_{n}") for n, v in values.items()])
    )
    carried = totals.select(
        *keys,
        "_piece",
        *[v.carried(frame, f"_t_{n}").alias(f"_c_{n}") for n, v in values.items()],
    )
    local = cut.select(
        *kept,
        "_piece",
        *[v.local(frame).alias(f"_l_{n}") for n, v in values.items()],
    )
    return joined(local, carried, keys + ["_piece"], "left").select(
        *kept,
        *[
            v.combine(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n)
            for n, v in values.items()
        ],
    )


def _frame(part: list[str], order: Sequence[str], piece: str, keys: list[str] | None = None) -> Frame:
    rows = Window.partitionBy(*part)
    return Frame(
        rows=rows.orderBy(*order),
        piece=rows,
        pieces=Window.partitionBy(*(keys or part)).orderBy(piece),
        order=F.struct(*order),
    )


def in_parts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    part_rows: int,
    cut_by: Column | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add ``part`` and ``pos``: rows of a key in order, ``part_rows`` to a part.

    Documents that list a key's rows are written one per part, so that no array
    outgrows ``part_rows`` elements.
    """
    placed = with_ordered(df, keys, order, {"pos": position()}, cut_by, hot)
    return placed.withColumn(
        "part", F.floor((F.col("pos") - 1) / F.lit(part_rows)).cast("int")
    )
