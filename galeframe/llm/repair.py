"""Token ids in files, compressed by a grammar (Re-Pair).

A file row is a block of whole documents.  Its ids are compressed by replacing frequent
pairs of symbols by new symbols, round after round; the rules and the length each symbol
expands to are stored beside the remaining symbols, so one document, or any range of its
ids, is decoded without reading the rest of the block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galeframe.llm.ranks import encoder, ragged
from galeframe.llm.support import mapped, tasks, utf8

# Ids of a block, from which the next document starts a new one.
BLOCK_IDS = 1 << 20
# A pair is replaced if it occurs so often in its block, and rounds go on while a round
# removes at least this share of the symbols.
LEAST_COUNT = 24
LEAST_GAIN = 0.04
# Symbols fit in 16 bits as long as a block has at most this many rules.
SYMBOLS = 1 << 16
_BINS = 1 << 20
_SPREAD = np.uint32(0x9E3779B1)

FILE = (
    "shard int, block int, first_id int, doc_ids binary, n_ids binary, n_symbols binary, "
    "rules binary, sizes binary, symbols binary, width int, total long"
)


def compress(ids: np.ndarray, counts: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols of each document, rules) for the ids of documents end to end.

    Symbols from ``first`` on are rules: rule k is the pair of symbols rules[k].  No pair
    spans two documents.
    """
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(counts)[counts > 0] - 1] = True
    rules: list[np.ndarray] = []
    known = first
    pair_of = np.zeros(_BINS, np.uint64)
    while len(symbols) > 1 and known < SYMBOLS:
        n = len(symbols)
        pair = symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:]
        slot = ((symbols[:-1] * _SPREAD + symbols[1:]) * _SPREAD) >> np.uint32(12)
        # A slot stands for one of its pairs; another may follow in a later round.
        pair_of[slot] = pair
        valid = (pair_of[slot] == pair) & ~last[:-1]
        often = np.bincount(slot[valid], minlength=_BINS)
        picked = np.flatnonzero(often >= LEAST_COUNT)
        room = min(SYMBOLS - known, len(picked))
        if not room:
            break
        if room < len(picked):
            picked = picked[np.argpartition(-often[picked], room - 1)[:room]]
        name = np.zeros(_BINS, np.int64)
        name[picked] = np.arange(len(picked)) + 1
        at = np.flatnonzero(valid & (name[slot] > 0))
        # Of overlapping occurrences every second one, from the left.
        run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        at = at[(at - np.repeat(at[run], np.diff(np.append(run, len(at))))) % 2 == 0]
        rules.append(np.stack([pair_of[picked] >> np.uint64(32), pair_of[picked] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        symbols[at] = name[slot[at]] - 1 + known
        last[at] = last[at + 1]
        keep = np.ones(n, bool)
        keep[at + 1] = False
        symbols, last = symbols[keep], last[keep]
        known += len(picked)
        if len(at) < LEAST_GAIN * n:
            break
    sizes = np.zeros(len(counts), np.int64)
    ends = np.flatnonzero(last) + 1
    sizes[counts > 0] = np.diff(np.append(0, ends))
    return symbols, sizes, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansion_sizes(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule stands for; a rule only uses rules before it."""
    sizes = np.ones(len(rules), np.int64)
    depth = np.zeros(len(rules), np.int64)
    pending = np.arange(len(rules))
    while len(pending):
        inner = rules[pending].astype(np.int64) - first
        ready = ((inner < 0) | (depth[np.maximum(inner, 0)] > 0)).all(1)
        now, parts = pending[ready], inner[ready]
        sizes[now] = np.where(parts < 0, 1, sizes[np.maximum(parts, 0)]).sum(1)
        depth[now] = 1
        pending = pending[~ready]
    return sizes


def expand(symbols: np.ndarray, rules: np.ndarray, sizes: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for."""
    table = np.zeros(int(sizes.sum()), np.uint32)
    at = np.cumsum(sizes) - sizes
    filled = np.zeros(len(rules), bool)
    pending = np.arange(len(rules))
    while len(pending):
        inner = rules[pending].astype(np.int64) - first
        ready = ((inner < 0) | filled[np.maximum(inner, 0)]).all(1)
        now, parts = pending[ready], inner[ready]
        to = at[now]
        for side in (0, 1):
            part = parts[:, side]
            plain = part < 0
            table[to[plain]] = rules[now[plain], side]
            size = np.where(plain, 1, sizes[np.maximum(part, 0)])
            deep = ~plain
            table[ragged(to[deep], size[deep])] = table[ragged(at[part[deep]], size[deep])]
            to = to + size
        filled[now] = True
        pending = pending[~ready]
    rule = symbols.astype(np.int64) - first
    plain = rule < 0
    size = np.where(plain, 1, sizes[np.maximum(rule, 0)]) if len(sizes) else np.ones(len(symbols), np.int64)
    start = np.where(plain, len(table), at[np.maximum(rule, 0)] if len(at) else 0)
    out = np.append(table, np.uint32(0))[ragged(start, size)]
    out[(np.cumsum(size) - size)[plain]] = symbols[plain]
    return out


def _row(shard: int, block: int, doc_ids: np.ndarray, ids: np.ndarray, counts: np.ndarray, first: int) -> dict:
    symbols, per_doc, rules = compress(ids, counts, first)
    width = 2 if first + len(rules) <= SYMBOLS else 4
    return {
        "shard": shard, "block": block, "first_id": first,
        "doc_ids": doc_ids.tobytes(), "n_ids": counts.astype("<u4").tobytes(), "n_symbols": per_doc.astype("<u4").tobytes(),
        "rules": rules.astype("<u4").tobytes(), "sizes": expansion_sizes(rules, first).astype("<u4").tobytes(),
        "symbols": symbols.astype(f"<u{width}").tobytes(), "width": width, "total": int(counts.sum()),
    }


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Encode every whole text, append ``end_id``, write in ascending doc_id order.

    One range shuffle by doc_id; a task writes one shard, block by block.  Null texts
    are empty (one id, the end), null doc_ids come first, equal ones stay together.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        first = int(max(max(coder.bytes_of), end_id)) + 1
        shard, block, pending, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal block, pending, size
            row = _row(shard, block, *(np.concatenate([p[k] for p in pending]) for k in range(3)), first)
            block, pending, size = block + 1, [], 0
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, counts = coder.encode(*utf8(batch.column(1)))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id)
            pending.append((_longs(batch.column(0)), ids, counts + 1))
            size += len(ids)
            if size >= BLOCK_IDS:
                yield flush()
        if pending:
            yield flush()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(tasks(spark), "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(run, FILE).write.option("compression", "zstd").parquet(path)


_ARROW = pa.schema(
    [(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (f.split(" ") for f in FILE.split(", "))]
)
_NULL_ID = -(2**63)


def _longs(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NULL_ID).to_numpy(zero_copy_only=False).astype("<i8")


class Block:
    """One row of a file; ``doc(k)`` reads one document, ``all()`` every one."""

    def __init__(self, row: dict):
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.counts = np.frombuffer(row["n_ids"], "<u4").astype(np.int64)
        self.per_doc = np.frombuffer(row["n_symbols"], "<u4").astype(np.int64)
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
        self.sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        self.symbols = np.frombuffer(row["symbols"], f"<u{row['width']}")
        self.first = row["first_id"]

    def doc(self, k: int) -> np.ndarray:
        end = int(self.per_doc[: k + 1].sum())
        return expand(self.symbols[end - int(self.per_doc[k]) : end], self.rules, self.sizes, self.first)

    def all(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.sizes, self.first)


def _starts(blocks: DataFrame) -> DataFrame:
    """(shard, block, before): the ids in all blocks before; the windows hold one row per
    block of a shard and one row per shard."""
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("total").alias("total"))
    shards = shards.select("shard", F.coalesce(F.sum("total").over(across), F.lit(0)).alias("earlier"))
    inner = blocks.select("shard", "block", F.coalesce(F.sum("total").over(within), F.lit(0)).alias("inner"))
    return inner.join(shards, "shard").select("shard", "block", (F.col("inner") + F.col("earlier")).alias("before"))


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; with ``digest`` the
    crc32 of the ids as little-endian 32-bit integers stands in their place."""
    files = spark.read.parquet(path)

    def step(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"shard": [], "block": [], "doc_id": [], "inner": [], "n_tokens": [], "ids": []}
        for row in batch.to_pylist():
            block = Block(row)
            ids, ends = block.all().astype("<u4"), np.cumsum(block.counts)
            n = len(ends)
            out["shard"] += [row["shard"]] * n
            out["block"] += [row["block"]] * n
            out["doc_id"] += [None if d == _NULL_ID else d for d in block.doc_ids.tolist()]
            out["inner"] += (ends - block.counts).tolist()
            out["n_tokens"] += block.counts.tolist()
            parts = (ids[a:b] for a, b in zip((ends - block.counts).tolist(), ends.tolist()))
            out["ids"] += [zlib.crc32(p) for p in parts] if digest else [p.view(np.int32) for p in parts]
        kinds = {"shard": pa.int32(), "block": pa.int32(), "ids": pa.int64() if digest else pa.list_(pa.int32())}
        return {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()}

    kind = "long" if digest else "array<int>"
    docs = mapped(files, step, f"shard int, block int, doc_id long, inner long, n_tokens long, ids {kind}")
    starts = _starts(files.select("shard", "block", "total"))
    out = docs.join(starts, ["shard", "block"]).select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids")
    return out.withColumnRenamed("ids", "ids_crc32") if digest else out
