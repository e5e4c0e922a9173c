"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.support import kept

# Edges a task contracts at a time.
AT_ONCE = 1 << 20


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    # The edge to the smallest one ties the node itself.
    return down.join(least, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct()


def _stars_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that tie every node of a small graph to the least of its component."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        for end in (label[a], label[b], a, b):
            np.minimum.at(label, end, least)
        label = label[label]
        if np.array_equal(before, label):
            break
    tied = np.flatnonzero(label < np.arange(len(nodes)))
    return nodes[tied], nodes[label[tied]]


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges of each task as stars of their own, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            u, v = _stars_of(*(np.concatenate(c) for c in zip(*held)))
            return pa.RecordBatch.from_pydict({"u": u, "v": v})

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= AT_ONCE:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return edges.mapInArrow(run, "u long, v long")


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge at most and is not the end of another's."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionAll(edges.select("v", F.lit(0)))
    loose = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 1 OR (up = 1 AND n > 1)")
    return loose.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for nodes with an edge (u, v); the component is its least node.

    Alternating stars, over edges that every task has contracted on its own; every round
    is written to the shared folder, and the rounds end when each component is one star.
    A node that is least of its component has no row.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    while True:
        edges = kept(_small_star(_large_star(_contracted(edges))), "edges")
        if _settled(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
