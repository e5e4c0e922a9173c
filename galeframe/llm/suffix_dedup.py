"""Removal of byte strings that repeat anywhere in a corpus, by external suffix sorting.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too.  Equal
strings choose equal anchors (see ``anchors``), so all starts of a repeated string lie in
the contexts of anchors with one k-gram.  K-grams that occur once are dropped, equal
contexts become one with a count, and what is left is dealt to shards by k-gram.  A shard
is a text on disk whose suffixes are sorted by external induction (see ``induced``); a start
repeats if a neighbour in that order shares ``length`` bytes with it, or if its context
was counted more than once.

A k-gram with very many different contexts (a common line) would be a shard of its own
that grows with the corpus; its starts are compared by a 128-bit hash of their strings
instead, dealt by that hash.  The queues of a shard lie on disk, its other arrays in
memory, so the shards are numbered by the measured bytes of the contexts.
"""

from __future__ import annotations

import hashlib
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.anchors import anchors
from galeframe.llm.induced import MEMORY, repeats
from galeframe.llm.ranks import mixed, ragged, word_hashes
from galeframe.llm.support import kept, mapped, tasks, utf8

LENGTH, GRAM = 200, 64
# Different contexts of a k-gram beyond which its starts are compared by hash.
HOT = 1 << 16
# Bytes of a shard, about; a shard takes some 70 bytes of memory for each.
SHARD = 2 << 20
# Contexts whose bytes are copied together.
SOME = 1000
# Stands for a null doc_id inside the operator.
_NO_ID = -(2**63)
# Ends every context in a shard; in no UTF-8 text.
_END = b"\xff"


def _rows(docs: DataFrame) -> DataFrame:
    """(id, key, text): rows with one doc_id and different texts are kept apart."""
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    return docs.select(doc_id.alias("id"), F.hash(F.coalesce("text", F.lit(""))).alias("key"), "text")


def _anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(gram, context, id, key, place) of all anchors; a place packs lo, span and off."""

    def step(batch: pa.RecordBatch) -> dict:
        text, offsets = utf8(batch.column(2))
        found = anchors(text, offsets, length, gram)
        at = pa.array(found["row"])
        place = found["lo"] << 24 | found["span"] << 12 | found["off"]
        return {"gram": found["gram"].view(np.int64), "context": found["context"].view(np.int64), "id": batch.column(0).take(at), "key": batch.column(1).take(at), "place": place}

    return mapped(rows, step, "gram long, context long, id long, key int, place long")


def _contexts(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(gram, context, n, span, bytes): the bytes of one context of each kind."""
    per_row = wanted.groupBy("id", "key").agg(F.collect_list(F.struct("gram", "context", "n", "place")).alias("all"))
    joined = rows.join(per_row, ["id", "key"]).select("text", "all")

    def step(batch: pa.RecordBatch) -> dict:
        text, offsets = utf8(batch.column(0))
        lists = batch.column(1)
        fields = lists.flatten()
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        gram, context, n, place = (fields.field(k).to_numpy() for k in range(4))
        lo, span = place >> 24, place >> 12 & 0xFFF
        begin = offsets[row] + lo
        size = span + length
        ends = np.append(0, np.cumsum(size)).astype(np.int32)
        data = np.empty(ends[-1], np.uint8)
        for a in range(0, len(size), SOME):
            b = min(len(size), a + SOME)
            data[ends[a] : ends[b]] = text[ragged(begin[a:b], size[a:b])]
        return {
            "gram": gram, "context": context, "n": n, "span": span,
            "bytes": pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data)]),
        }

    return mapped(joined, step, "gram long, context long, n long, span long, bytes binary")


def runs(flags: np.ndarray) -> np.ndarray:
    """(first, last) of every run of true flags, one pair after the other."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    edge[1::2] -= 1
    return edge.astype("<i4")


def _shards(contexts: DataFrame, length: int) -> int:
    """How many shards: about SHARD bytes to each, and at least one a task."""
    size = contexts.agg(F.sum(F.col("span") + length + len(_END))).first()[0] or 0
    return max(tasks(contexts.sparkSession), -(-size // SHARD))


_MARKS = "gram long, context long, spans binary"


def _sorted_marks(contexts: DataFrame, length: int, memory: int) -> DataFrame:
    """(gram, context, spans): starts that repeat, by sorting the shard of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = tempfile.mkdtemp(prefix="spark-suffix-")
        try:
            parts: list[list[np.ndarray]] = [[], [], [], [], []]
            seen: set[tuple[int, int]] = set()
            size = 0
            with open(f"{folder}/text", "wb") as file:
                for batch in batches:
                    new = []
                    for k, pair in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                        if pair not in seen:
                            seen.add(pair)
                            new.append(k)
                    batch = batch.take(pa.array(new, pa.int64()))
                    data = [b + _END for b in batch.column(4).to_pylist()]
                    lengths = np.array([len(d) for d in data], np.int64)
                    file.write(b"".join(data))
                    for part, values in zip(parts, (*(batch.column(c).to_numpy() for c in range(4)), size + np.cumsum(lengths) - lengths)):
                        part.append(values)
                    size += int(lengths.sum())
            seen.clear()
            if not size:
                return
            gram, context, n, span, start = map(np.concatenate, parts)
            text = np.memmap(f"{folder}/text", np.uint8, "r")
            flags = np.zeros(size, bool)
            for at in repeats(text, length, folder, memory):
                flags[at] = True
            for a in range(0, len(gram), 10_000):
                some = slice(a, a + 10_000)
                spans = [
                    runs(np.ones(s + 1, bool) if c > 1 else flags[b : b + s + 1])
                    for b, s, c in zip(start[some].tolist(), span[some].tolist(), n[some].tolist())
                ]
                has = np.array([len(s) > 0 for s in spans])
                yield pa.RecordBatch.from_pydict(
                    {"gram": gram[some][has], "context": context[some][has], "spans": pa.array([s.tobytes() for s in spans if len(s)], pa.binary())}
                )
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    dealt = contexts.repartition(_shards(contexts, length), "gram")
    return dealt.mapInArrow(run, _MARKS)


def _hashed_marks(contexts: DataFrame, length: int) -> DataFrame:
    """The same for k-grams with very many contexts: starts meet under their strings' hash."""

    def windows(batch: pa.RecordBatch) -> dict:
        data = batch.column(4).to_pylist()
        size = np.array([len(d) for d in data], np.int64)
        text = np.frombuffer(b"".join(data), np.uint8)
        count = size - length + 1
        begin = ragged(np.cumsum(size) - size, count)
        row = pa.array(np.repeat(np.arange(len(data)), count))
        first = word_hashes(text, begin, begin + length)
        second = word_hashes(255 - text, begin, begin + length)
        return {
            "a": first.view(np.int64), "b": mixed(second).view(np.int64), "rel": (begin - np.repeat(np.cumsum(size) - size, count)).astype(np.int32),
            "gram": batch.column(0).take(row), "context": batch.column(1).take(row), "n": batch.column(2).take(row),
        }

    starts = kept(mapped(contexts.dropDuplicates(["gram", "context"]), windows, "a long, b long, rel int, gram long, context long, n long"), "starts")
    twice = kept(starts.groupBy("a", "b").agg(F.sum("n").alias("all")).where("all > 1").select("a", "b"), "twice")
    # At most as many starts as a context has windows.
    hits = starts.join(twice, ["a", "b"]).groupBy("gram", "context").agg(F.collect_set("rel").alias("rel"))

    def step(batch: pa.RecordBatch) -> dict:
        spans = []
        for rel in batch.column(2).to_pylist():
            flags = np.zeros(max(rel) + 1, bool)
            flags[rel] = True
            spans.append(runs(flags).tobytes())
        return {"gram": batch.column(0), "context": batch.column(1), "spans": pa.array(spans, pa.binary())}

    return mapped(hits, step, _MARKS)


def _whole(batch: pa.RecordBatch) -> dict:
    spans = [np.array([0, s], "<i4").tobytes() for s in batch.column(2).to_pylist()]
    return {"gram": batch.column(0), "context": batch.column(1), "spans": pa.array(spans, pa.binary())}


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, memory: int = MEMORY) -> DataFrame:
    """(id, key, marks): for rows with repeated strings, pairs (place, spans of starts)."""
    rows = _rows(docs)
    found = _anchors(rows, length, gram)
    common = kept(found.groupBy("gram").count().where("count > 1").select("gram"), "grams")
    repeated = kept(found.join(common, "gram"), "anchors")
    kinds = kept(
        repeated.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("id", "key", "place")).alias("one"))
        .select("gram", "context", "n", "one.*"), "contexts",
    )
    spread = kept(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1"), "spread")
    # One context, counted more than once: there is nothing to sort.
    alone = kinds.join(spread, "gram", "left_anti").select("gram", "context", (F.shiftright("place", 12).bitwiseAND(F.lit(0xFFF))).alias("span"))
    marks = [mapped(alone, _whole, _MARKS)]
    bytes_ = kept(_contexts(rows, kinds.join(spread, "gram"), length), "bytes")
    many = spread.where(F.col("kinds") > hot).select("gram")
    if many.isEmpty():
        marks.append(_sorted_marks(bytes_, length, memory))
    else:
        marks.append(_sorted_marks(bytes_.join(many, "gram", "left_anti"), length, memory))
        marks.append(_hashed_marks(bytes_.join(many, "gram", "left_semi"), length))
    all_marks = marks[0]
    for more in marks[1:]:
        all_marks = all_marks.union(more)
    placed = repeated.join(kept(all_marks, "marks"), ["gram", "context"]).select("id", "key", "place", "spans").distinct()
    # As many as a text has anchors.
    return kept(placed.groupBy("id", "key").agg(F.collect_list(F.struct("place", "spans")).alias("marks")), "placed")


def _removed(size: int, marks: list[dict] | None, length: int) -> np.ndarray:
    """Flags of the bytes that go."""
    edge = np.zeros(size + 1, np.int32)
    for mark in marks or ():
        spans = np.frombuffer(mark["spans"], "<i4").reshape(-1, 2) + (mark["place"] >> 24)
        np.add.at(edge, spans[:, 0], 1)
        np.add.at(edge, spans[:, 1] + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _with_marks(docs: DataFrame, length: int, **options) -> DataFrame:
    marked = repeated_starts(docs, length, **options)
    key = F.hash(F.coalesce("text", F.lit(""))).alias("_gf_key")
    keyed = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_gf_id"), key)
    marked = marked.select(F.col("id").alias("_gf_id"), F.col("key").alias("_gf_key"), F.col("marks").alias("_gf_marks"))
    return keyed.join(marked, ["_gf_id", "_gf_key"], "left").drop("_gf_id", "_gf_key")


def digests(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row.

    Null texts are empty; equal rows remove each other's bytes like any others; texts
    shorter than ``length`` lose nothing.  Other columns are not read.
    """
    rows = _with_marks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length, **options)

    def step(batch: pa.RecordBatch) -> dict:
        text, offsets = utf8(batch.column(1))
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for a, b, marks in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(2).to_pylist()):
            mine = text[a:b]
            spans = 0
            if marks:
                gone = _removed(b - a, marks, length)
                spans = len(runs(gone)) // 2
                mine = mine[~gone]
            out["n_bytes"].append(b - a)
            out["n_removed"].append(b - a - len(mine))
            out["n_spans"].append(spans)
            out["kept_sha256"].append(hashlib.sha256(mine.tobytes()).hexdigest())
        return {"doc_id": batch.column(0)} | out

    return mapped(rows, step, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``, all rows and columns.

    A character that loses some of its bytes goes whole.  A null text stays null.
    """
    names = docs.columns
    rows = _with_marks(docs, length, **options)
    others = [c for c in names if c != "text"]

    def step(batch: pa.RecordBatch) -> dict:
        texts = []
        for text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text is not None and marks:
                raw = np.frombuffer(text.encode(), np.uint8)
                text = raw[~_removed(len(raw), marks, length)].tobytes().decode("utf-8", "ignore")
            texts.append(text)
        return {"text": pa.array(texts, pa.string())} | {f"c{k}": batch.column(2 + k) for k in range(len(others))}

    schema = ", ".join(["text string", *(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(others))])
    out = mapped(rows.select("text", "_gf_marks", *others), step, schema)
    return out.select(*(F.col("text") if c == "text" else F.col(f"c{others.index(c)}").alias(c) for c in names))

