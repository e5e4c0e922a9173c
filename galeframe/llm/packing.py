"""Packing token pieces into sequences of fixed length by a configuration LP.

A configuration is a multiset of piece lengths that fits one sequence.  The linear
program over the length histogram (use as few configurations as cover all pieces) is
solved by multiplicative weights: every round prices a length by its size and by how
little of it is covered so far, and one knapsack over the capacity, bounded by the pieces
that are left, gives for each length the configuration of greatest price that holds it.
Those near the best price take shares, none more than half of what is left of a length.
A share is rounded down to whole sequences when it is taken, so rounding frees its pieces
for later rounds.  Rounds go on until the pieces left fit one sequence; these, and the
room left in the configurations, go to best fit on the histogram, where equal bins move
together.  Everything on the driver is as large as the capacity squared, whatever the
number of pieces; rounds grow with the logarithm of it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galeframe.llm.ranks import encoder
from galeframe.llm.support import kept, mapped, tasks, utf8

# How sharply a covered length loses its price.
RATE = 0.05
# Prices grow with this power of the length: long pieces are the harder ones to place.
POWER = 1.4
# Configurations below this part of the best price take no share.
NEAR = 0.9


def _knapsack(prices: np.ndarray, lengths: np.ndarray, left: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greatest price for every room, and which lots of equal pieces it takes.

    A length is at hand ``left`` times, in lots of 1, 2, 4 ... pieces.
    """
    of, lot = [], []
    for i in range(len(lengths) - 1, -1, -1):
        most, size = min(int(left[i]), capacity // int(lengths[i])), 1
        while most:
            size = min(size, most)
            of.append(i)
            lot.append(size)
            most, size = most - size, 2 * size
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(of), capacity + 1), bool)
    weights = lengths[of] * np.array(lot)
    worth = prices[of] * np.array(lot)
    for k, (weight, price) in enumerate(zip(weights.tolist(), worth.tolist())):
        value = best[: capacity + 1 - weight] + price
        np.greater(value, best[weight:], out=taken[k, weight:])
        np.maximum(value, best[weight:], out=best[weight:])
    return best, taken, np.array(of), np.array(lot)


def _priced(prices: np.ndarray, lengths: np.ndarray, left: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For lengths that are left: the configuration of greatest price that holds the length,
    and this price in parts of the best one, greatest first."""
    best, taken, of, lot = _knapsack(prices, lengths, left, capacity)
    seeds = np.flatnonzero(left > 0)
    room = capacity - lengths[seeds]
    value = prices[seeds] + best[room]
    uses = np.zeros((len(seeds), len(lengths)), np.int32)
    uses[np.arange(len(seeds)), seeds] = 1
    for k in range(len(of) - 1, -1, -1):
        rows = np.flatnonzero(taken[k, room])
        uses[rows, of[k]] += lot[k]
        room[rows] -= lengths[of[k]] * lot[k]
    order = np.lexsort((-lengths[seeds], -value))
    uses, value = uses[order], value[order] / best[capacity]
    # The knapsack for the rest may take a piece more of the seed than there is.
    there = (uses <= left).all(1)
    return (uses[there], value[there]) if there.any() else (np.minimum(uses[:1], left), value[:1])


def configurations(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(configuration, whole share) pairs of the linear program, by multiplicative weights.

    They hold no piece twice, and all but the pieces that fit one last sequence.
    """
    lengths = np.array(sorted(counts), np.int64)
    need = np.array([counts[n] for n in lengths.tolist()], np.int64)
    left = need.copy()
    shares: dict[tuple[int, ...], int] = {}
    while int(left @ lengths) > capacity:
        prices = np.where(left > 0, lengths**POWER * np.exp(-RATE * (1 - left / need)), 0.0)
        most = -(-left // 2)
        uses, value = _priced(prices, lengths, left, capacity)
        for k in range(int(np.count_nonzero(value >= NEAR)) or 1):
            held = np.flatnonzero(uses[k])
            used = uses[k, held]
            share = int((most[held] // used).min())
            if k == 0:  # the best one always takes a share, so every round ends nearer
                share = max(share, 1)
            if share > 0:
                left[held] -= share * used
                most[held] -= share * used
                key = tuple(np.repeat(lengths[held], used).tolist())
                shares[key] = shares.get(key, 0) + share
    return [(list(c), n) for c, n in shares.items()]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, number of such sequences) that hold every piece once."""
    left = {n: c for n, c in counts.items() if 0 < n <= capacity and c}
    return _completed(left, configurations(left, capacity), capacity) if left else []


def _completed(left: dict[int, int], shares: list[tuple[list[int], int]], capacity: int) -> list[tuple[list[int], int]]:
    """``shares`` and, by best fit into their rooms and into new sequences, the other pieces."""
    left = dict(left)
    groups: dict[int, list[tuple[list[int], int]]] = {}  # by free room
    for lengths, times in shares:
        for n in lengths:
            left[n] -= times
        groups.setdefault(capacity - sum(lengths), []).append((lengths, times))
    rooms = sorted(groups)
    for n in sorted(left, reverse=True):
        rest = left[n]
        while rest:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                fit = capacity // n
                full, odd = divmod(rest, fit)
                new = [([n] * fit, full), ([n] * odd, 1 if odd else 0)]
                rest = 0
                for held, times in new:
                    if times:
                        _add(groups, rooms, capacity - n * len(held), held, times)
                break
            room = rooms[i]
            held, times = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[i]
            now = min(times, rest)
            if now < times:
                _add(groups, rooms, room, held, times - now)
            _add(groups, rooms, room - n, [*held, n], now)
            rest -= now
    return [g for room in sorted(groups) for g in groups[room]]


def _add(groups: dict, rooms: list[int], room: int, held: list[int], times: int) -> None:
    if room not in groups:
        groups[room] = []
        insort(rooms, room)
    groups[room].append((held, times))


def slots(packed: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank of each slot, its first sequence and its offset.

    The pieces of one length are ranked from 0; rank r belongs to the last slot that
    begins at or before r, in the sequence as far behind the slot's first one.
    """
    out: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    sequence = 0
    for held, times in packed:
        offset = 0
        for n in held:
            rank = seen.get(n, 0)
            out.setdefault(n, []).append((rank, sequence, offset))
            seen[n] = rank + times
            offset += n
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in out.items()}


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): whole texts cut into pieces.

    Only documents longer than ``capacity`` are cut.  Null texts are empty: one id.
    """

    def step(batch: pa.RecordBatch) -> dict:
        ids, counts = encoder(vocabulary).encode(*utf8(batch.column(1)))
        ids = np.insert(ids, np.cumsum(counts), end_id)
        counts = counts + 1
        number = -(-counts // capacity)
        row = np.repeat(np.arange(len(counts)), number)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
        start = piece * capacity
        length = np.minimum(counts[row] - start, capacity)
        at = (np.cumsum(counts) - counts)[row] + start
        crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist())]
        return {"doc_id": batch.column(0).take(pa.array(row)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": crc}

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(docs, step, "doc_id long, piece int, start long, length long, ids_crc32 long")


def ranked(cut: DataFrame) -> DataFrame:
    """``cut`` with the rank of every piece among those of its length.

    Pieces of a length are dealt over many groups and ranked within each; a group's
    first rank is the number of pieces in the groups before, so a length that a third of
    all pieces share is no single task.
    """
    parts = tasks(cut.sparkSession)
    dealt = cut.withColumn("_deal", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("length").orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("length", "_deal").count().select(
        "length", "_deal", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first")
    )
    own = Window.partitionBy("length", "_deal").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("_own", F.row_number().over(own) - 1)
    return numbered.join(first, ["length", "_deal"]).withColumn("rank", F.col("_first") + F.col("_own"))


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece.

    Repeated rows are packed each for itself, an empty table gives no rows, and other
    columns are not read.
    """
    cut = kept(pieces(docs, vocabulary, end_id, capacity), "pieces")
    # At most ``capacity`` rows come to the driver.
    histogram = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}
    table = slots(plan(histogram, capacity))

    def step(batch: pa.RecordBatch) -> dict:
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        out = {n: batch.column(n) for n in names}
        length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for n in np.unique(length).tolist():
            mine = np.flatnonzero(length == n)
            first, base, at = table[n]
            slot = np.searchsorted(first, rank[mine], "right") - 1
            sequence[mine] = base[slot] + rank[mine] - first[slot]
            offset[mine] = at[slot]
        return out | {"sequence_id": sequence, "offset": offset}

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return mapped(ranked(cut), step, schema)
