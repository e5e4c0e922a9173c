"""Nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; every vector is indexed in the leaf its path of
nearest centres leads to.  Vectors are lengthened by one component to a common norm, so
that the nearest centre by distance is also the best by inner product.  A query walks the
tree through a priority queue: the open node whose centre has the greatest inner product
comes next, and the leaves come out in the order in which they are worth a visit.  How
many are visited is calibrated: for a bounded number of the queries the true neighbours
are found among all rows, and visits widen until the wanted share of them is reached.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galeframe.llm.support import kept, mapped

# Bounds of the sample the tree is fitted on and of the calibrating queries.
SAMPLE = 16_384
CALIBRATORS = 256
BRANCHES = 8
LEAF_SAMPLE = 160
RECALL = 0.95
# Vectors and queries that meet in one task.
PART_VECTORS, PART_QUERIES = 4096, 2048


@dataclass
class Tree:
    centres: np.ndarray  # of all nodes, one component longer than the vectors
    children: list[list[int]]  # by node; empty for leaves
    leaf: np.ndarray  # number of the leaf, -1 for inner nodes
    norm: float  # that all vectors are lengthened to

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.column_stack([x, rest])

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector."""
        x, node = self.lengthened(x), np.zeros(len(x), np.int64)
        active = np.arange(len(x))
        while len(active):
            for n in np.unique(node[active]).tolist():
                mine = active[node[active] == n]
                if self.children[n]:
                    node[mine] = np.array(self.children[n])[_nearest(x[mine], self.centres[self.children[n]])]
            active = active[self.leaf[node[active]] < 0]
        return self.leaf[node]

    def order(self, q: np.ndarray, most: int) -> np.ndarray:
        """The first ``most`` leaves of each query's walk."""
        worth = q @ self.centres[:, :-1].T
        out = np.empty((len(q), most), np.int64)
        for k, row in enumerate(worth):
            heap, seen = [(-row[0], 0)], 0
            while seen < most:
                _, node = heapq.heappop(heap)
                if self.leaf[node] >= 0:
                    out[k, seen] = self.leaf[node]
                    seen += 1
                else:
                    for child in self.children[node]:
                        heapq.heappush(heap, (-row[child], child))
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * (x @ centres.T)).argmin(1)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        group = _nearest(x, centres)
        size = np.bincount(group, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, group, x)
        used = size > 0
        centres = np.where(used[:, None], sums / np.maximum(size, 1)[:, None], centres)
    return centres[np.unique(_nearest(x, centres))]


def fit(x: np.ndarray, norm: float, seed: int = 3) -> Tree:
    rng = np.random.default_rng(seed)
    tree = Tree(np.zeros((1, x.shape[1] + 1)), [[]], np.zeros(1, np.int64), norm)
    x = tree.lengthened(x)
    centres, leaf, todo, leaves = [x.mean(0)], [-1], [(0, x)], 0
    children: list[list[int]] = [[]]
    while todo:
        node, mine = todo.pop()
        parts = _k_means(mine, BRANCHES, rng) if len(mine) > max(LEAF_SAMPLE, BRANCHES) else mine[:1]
        if len(parts) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        group = _nearest(mine, parts)
        for k in range(len(parts)):
            children[node].append(len(centres))
            todo.append((len(centres), mine[group == k]))
            centres.append(parts[k])
            leaf.append(-1)
            children.append([])
    return Tree(np.array(centres), children, np.array(leaf), norm)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length, in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(column), -1)


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, norm2) of the vectors that take part: no nulls, no non-finite
    components, not all zero."""
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    out = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", norm2.alias("norm2"))
    return out.where("norm2 > 0 AND norm2 < double('Infinity')")


def _top(scores: np.ndarray, q: np.ndarray, v: np.ndarray, qid: np.ndarray, vid: np.ndarray, k: int):
    """(query, candidate, score) of each query's ``k`` best, ties to smaller ids.

    The matrix product only preselects: equal vectors may differ in its last bit, so what
    is near the limit is scored anew, every pair by the same operations.
    """
    scores = np.where(qid[:, None] == vid[None, :], -np.inf, scores)
    limit = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if scores.shape[1] > k else np.full(len(q), -np.inf)
    slack = 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(limit), limit, 0.0)))
    a, b = np.nonzero((scores >= (limit - slack)[:, None]) & np.isfinite(scores))
    exact = (q[a] * v[b]).sum(1)
    order = np.lexsort((vid[b], -exact, a))
    a, b, exact = a[order], b[order], exact[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    place = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    best = place < k
    return a[best], b[best], exact[best]


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


_FOUND = "query_id long, vec_id long, score double"


def exact(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """The true ``k`` nearest of a bounded number of queries among all ``vectors``."""

    def step(batch: pa.RecordBatch) -> dict:
        vid, v = batch.column(0).to_numpy(), matrix(batch.column(1))
        a, b, score = _top(q @ v.T, q, v, ids, vid, k)
        return {"query_id": ids[a], "vec_id": vid[b], "score": score}

    return _best(mapped(vectors.select("vec_id", "embedding"), step, _FOUND), k).drop("rank")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query.

    ``vectors`` and ``queries`` have vec_id and embedding.  Vectors that are null, zero,
    of another dimension than most, or hold null or non-finite components take no part;
    a query never finds its own id.  A repeated id counts once per row.  Empty tables
    give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    everything = valid(vectors)
    size = F.size("embedding")
    shape = everything.groupBy(size.alias("n")).agg(F.count("*").alias("rows"), F.max("norm2").alias("norm2"))
    shape = shape.orderBy(F.desc("rows"), "n").first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if shape is None:
        return none
    everything = everything.where(size == shape["n"]).select("vec_id", "embedding")
    asked = valid(queries).where(size == shape["n"]).select("vec_id", "embedding")
    spread = 1_000_000

    def drawn(df: DataFrame, rows: int, most: int, salt: str) -> pa.Table:
        share = int(spread * min(1.0, most / max(1, rows)))
        return df.where(F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(spread)) < share).orderBy("vec_id").toArrow()

    sample = drawn(everything, shape["rows"], SAMPLE, "tree")
    calibrators = drawn(asked, asked.count(), CALIBRATORS, "calibrate")
    if not sample.num_rows:
        sample = everything.limit(BRANCHES).toArrow()
    tree = fit(matrix(sample.column(1).combine_chunks()), float(np.sqrt(shape["norm2"])))
    shared = spark.sparkContext.broadcast(tree)

    def to_leaf(batch: pa.RecordBatch) -> dict:
        return {"leaf": shared.value.assign(matrix(batch.column(1))), "vec_id": batch.column(0), "embedding": batch.column(1)}

    kind = vectors.schema["embedding"].dataType.simpleString()
    index = kept(mapped(everything, to_leaf, f"leaf long, vec_id long, embedding {kind}"), "index")

    visits = tree.leaves
    if calibrators.num_rows:
        ids, q = calibrators.column(0).to_numpy(), matrix(calibrators.column(1).combine_chunks())
        true = exact(everything, ids, q, k).join(index.select("leaf", "vec_id"), "vec_id").select("query_id", "leaf").toArrow()
        rank = np.empty((len(ids), tree.leaves), np.int64)
        np.put_along_axis(rank, tree.order(q, tree.leaves), np.arange(tree.leaves)[None, :], 1)
        row = np.searchsorted(ids, true.column(0).to_numpy())
        needed = np.sort(rank[row, true.column(1).to_numpy()])
        if len(needed):
            visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1

    # One row for each leaf of the tree, whose size is bounded by the sample.
    held = {r[0]: r[1] for r in index.groupBy("leaf").count().collect()}
    # However few vectors some leaves hold, the leaves visited hold more than k.
    sizes = np.cumsum(sorted(held.get(leaf, 0) for leaf in range(tree.leaves)))
    visits = min(tree.leaves, max(visits, int(np.searchsorted(sizes, k + 1)) + 1))

    def walks(batch: pa.RecordBatch) -> dict:
        order = shared.value.order(matrix(batch.column(1)), visits)
        row = pa.array(np.repeat(np.arange(batch.num_rows), visits))
        return {"leaf": order.ravel(), "query_id": batch.column(0).take(row), "query": batch.column(1).take(row)}

    walked = mapped(asked.withColumnRenamed("embedding", "query"), walks, f"leaf long, query_id long, query {kind}")
    asked_rows = asked.count()
    vector_parts = {leaf: -(-n // PART_VECTORS) for leaf, n in held.items()}
    query_parts = max(1, -(-asked_rows * visits // (max(1, tree.leaves) * PART_QUERIES)))
    parts = F.create_map(*[x for leaf, n in vector_parts.items() for x in (F.lit(leaf), F.lit(n))])
    # Vectors of a leaf are dealt over its parts and meet each part of the queries there.
    left = index.select(
        "leaf", F.pmod(F.xxhash64("vec_id"), parts[F.col("leaf")]).alias("vp"), F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("qp"), "vec_id", "embedding"
    )
    right = walked.where(F.col("leaf").isin(list(held))).select(
        "leaf", F.explode(F.sequence(F.lit(0).cast("long"), (parts[F.col("leaf")] - 1).cast("long"))).alias("vp"), F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int").alias("qp"), "query_id", "query"
    )

    def meet(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        vid, v = vectors["vec_id"].to_numpy(), matrix(vectors["embedding"].combine_chunks())
        qid, q = queries["query_id"].to_numpy(), matrix(queries["query"].combine_chunks())
        out = []
        for a in range(0, len(q), 256):
            i, j, score = _top(q[a : a + 256] @ v.T, q[a : a + 256], v, qid[a : a + 256], vid, k)
            out.append((qid[a + i], vid[j], score))
        return pa.table({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), zip(*out))})

    keys = ["leaf", "vp", "qp"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, _FOUND)
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
