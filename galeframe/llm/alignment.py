"""Alignment of the tokens of two tokenizers, by a monoid of fragments.

Both tokenizers cut the same bytes.  Offsets where a token of either ends are common cuts;
between two of them lies a group.  A byte range of a text is a fragment: an open prefix
(tokens up to its first common cut), closed groups, and an open suffix (tokens behind its
last one).  Two neighbouring fragments compose into one: suffix and prefix between them
close to a group.  This is associative, so the fragments of a very long text are made in
different tasks and composed in a tree; a short text is one fragment, closed at once.

Two overlapping tokens are linked.  What is kept of closed groups is their number, the
linked id pairs with how often each occurs, and the text that lists the groups.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galeframe.llm.ranks import Encoder, byte_letters, ragged
from galeframe.llm.support import kept, mapped

# Bytes of a fragment; texts of more are aligned in several tasks.
CHUNK_BYTES = 1 << 16
# Fragments composed by one task.
FAN = 8
# Bytes of text tokenized at a time.
BLOCK_BYTES = 1 << 20
# Pairs whose counts are broadcast (17 bytes each); beyond it they are joined.
PAIRS_AT_ONCE = 4_000_000
# Pairs a task holds before it hands their counts on.
PAIRS_HELD = 2_000_000


class Tokens:
    """The bytes of every token id of a vocabulary, end to end."""

    def __init__(self, pieces: list[bytes]):
        self.size = len(pieces)
        self.lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.starts[ids], self.lengths[ids])]


class PlainEncoder(Encoder):
    """An encoder for which the strings of special tokens are plain text."""

    def encode_one(self, text: str) -> np.ndarray:
        return np.array([i for word in self.splits.findall(text) for i in self.merge_one(word.encode())], np.int32)


class Pair:
    """A byte-level tokenizer file (A) and a piece model (B)."""

    def __init__(self, byte_level: str, pieces: str):
        from sentencepiece import SentencePieceProcessor

        self._a = PlainEncoder(byte_level)
        with open(byte_level, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        by_id = {i: bytes(letters[c] for c in token) for token, i in spec["model"]["vocab"].items() if all(c in letters for c in token)}
        by_id |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.a = Tokens([by_id.get(i, b"") for i in range(max(by_id) + 1)])
        self._b = SentencePieceProcessor(model_file=pieces)
        self.b = Tokens([self._piece(i) for i in range(self._b.get_piece_size())])
        # A pair of ids is one number.
        self.kind = np.dtype("<u4") if self.a.size * self.b.size < 1 << 32 else np.dtype("<u8")
        self.digits = _digits(max(self.a.size, self.b.size))

    def _piece(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A (of a space and the text) and how many each text has, and those of B."""
        spaced = [b" " + t.encode() for t in texts]
        offsets = np.append(0, np.cumsum([len(t) for t in spaced]))
        a, count_a = self._a.encode(np.frombuffer(b"".join(spaced), np.uint8), offsets)
        b = self._b.encode(texts, num_threads=1)
        count_b = np.fromiter(map(len, b), np.int64, len(b))
        return a.astype(np.int64), count_a, np.fromiter(chain.from_iterable(b), np.int64, int(count_b.sum())), count_b


def _digits(size: int) -> np.ndarray:
    """The decimal digits of every id as characters, 0 before the first."""
    width = len(str(size))
    ids = np.arange(size)
    out = np.zeros((size, width), np.uint8)
    for k in range(width):
        power = 10 ** (width - 1 - k)
        out[:, k] = np.where((ids >= power) | (k == width - 1), ids // power % 10 + 48, 0)
    return out


_open: dict[tuple[str, str], Pair] = {}


def tokenizers(byte_level: str, pieces: str) -> Pair:
    """One per Python worker and pair of files."""
    if (byte_level, pieces) not in _open:
        _open[byte_level, pieces] = Pair(byte_level, pieces)
    return _open[byte_level, pieces]


def group_of(ends: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, ends, "left")


def listed(pair: Pair, a: np.ndarray, b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text ``a1,a2|b1;a3|b2,b3;`` of whole groups, and where that of each group ends.

    ``a`` and ``b`` have a row (id, end offset) to a token; ``cuts`` are their common ends.
    """
    group_a, group_b = group_of(a[:, 1], cuts), group_of(b[:, 1], cuts)
    last_a = np.append(group_a[1:] != group_a[:-1], True) if len(a) else np.zeros(0, bool)
    last_b = np.append(group_b[1:] != group_b[:-1], True) if len(b) else np.zeros(0, bool)
    place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")
    place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
    width = pair.digits.shape[1]
    out = np.zeros((len(a) + len(b), width + 1), np.uint8)
    out[place_a, :width], out[place_b, :width] = pair.digits[a[:, 0]], pair.digits[b[:, 0]]
    out[place_a, width] = np.where(last_a, ord("|"), ord(","))
    out[place_b, width] = np.where(last_b, ord(";"), ord(","))
    used = out > 0
    ends = np.cumsum(used.sum(axis=1))
    return out[used], ends[place_b[last_b]]


def links(pair: Pair, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id pairs of all overlapping tokens of whole groups, and where each overlap ends.

    Every stretch between two ends of tokens is the overlap of one pair of tokens.
    """
    ends = np.concatenate([a[:, 1], b[:, 1]])
    ends.sort(kind="stable")  # two runs that are sorted already
    ends = ends[np.append(True, ends[1:] != ends[:-1])[: len(ends)]]
    left = a[np.searchsorted(a[:, 1], ends, "left"), 0]
    right = b[np.searchsorted(b[:, 1], ends, "left"), 0]
    return left * pair.b.size + right, ends


_NO_TOKENS = np.zeros((0, 2), np.int64)


@dataclass
class Fragment:
    """A byte range of a text, aligned as far as it can be on its own.

    Without a common cut (``cut`` is false) all its tokens are in ``head``.
    """

    cut: bool = False
    head_a: np.ndarray = field(default_factory=lambda: _NO_TOKENS)
    head_b: np.ndarray = field(default_factory=lambda: _NO_TOKENS)
    tail_a: np.ndarray = field(default_factory=lambda: _NO_TOKENS)
    tail_b: np.ndarray = field(default_factory=lambda: _NO_TOKENS)
    n_a: int = 0  # tokens in closed groups
    n_b: int = 0
    n_groups: int = 0
    text: bytes = b""
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


# The start of a text is a common cut.
START = Fragment(cut=True)


def fragment(pair: Pair, a: np.ndarray, b: np.ndarray) -> Fragment:
    """The tokens that end in a byte range."""
    cuts = np.intersect1d(a[:, 1], b[:, 1], assume_unique=True)
    if not len(cuts):
        return Fragment(head_a=a, head_b=b)
    first_a, first_b = (np.searchsorted(x[:, 1], cuts[0], "right") for x in (a, b))
    last_a, last_b = (np.searchsorted(x[:, 1], cuts[-1], "right") for x in (a, b))
    inner = _closed(pair, a[first_a:last_a], b[first_b:last_b])
    return Fragment(True, a[:first_a], b[:first_b], a[last_a:], b[last_b:], *inner)


def _closed(pair: Pair, a: np.ndarray, b: np.ndarray) -> tuple:
    if not len(a):
        return 0, 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.intersect1d(a[:, 1], b[:, 1], assume_unique=True)
    text, _ = listed(pair, a, b, cuts)
    return len(a), len(b), len(cuts), text.tobytes(), *np.unique(links(pair, a, b)[0], return_counts=True)


def compose(pair: Pair, x: Fragment, y: Fragment) -> Fragment:
    """Two neighbouring fragments as one; associative, with ``Fragment()`` as identity."""
    if not x.cut:
        return Fragment(y.cut, np.concatenate([x.head_a, y.head_a]), np.concatenate([x.head_b, y.head_b]), y.tail_a, y.tail_b, y.n_a, y.n_b, y.n_groups, y.text, y.keys, y.counts)
    open_a, open_b = np.concatenate([x.tail_a, y.head_a]), np.concatenate([x.tail_b, y.head_b])
    if not y.cut:
        return Fragment(True, x.head_a, x.head_b, open_a, open_b, x.n_a, x.n_b, x.n_groups, x.text, x.keys, x.counts)
    n_a, n_b, n_groups, text, keys, counts = _closed(pair, open_a, open_b)
    keys, at = np.unique(np.concatenate([x.keys, keys, y.keys]), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, np.concatenate([x.counts, counts, y.counts]))
    return Fragment(
        True, x.head_a, x.head_b, y.tail_a, y.tail_b, x.n_a + n_a + y.n_a, x.n_b + n_b + y.n_b,
        x.n_groups + n_groups + y.n_groups, x.text + text + y.text, keys, total,
    )


_DONE = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "keys", "counts"]
_DONE_SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, keys binary, counts binary"
_PART = ["head_a", "head_b", "tail_a", "tail_b", "keys", "counts"]
_PART_SCHEMA = "row long, doc_id long, at long, cut boolean, head_a binary, head_b binary, tail_a binary, tail_b binary, n_a long, n_b long, n_groups long, text binary, keys binary, counts binary"


def _whole(pair: Pair, texts: list[str], with_groups: bool, chunk_bytes: int) -> tuple[dict, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Results of texts (none empty) by column, and the tokens of those that are too long
    to be one fragment."""
    rows = len(texts)
    raw = [b" " + t.encode() for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, rows)
    expected = np.frombuffer(b"".join(raw), np.uint8)
    good = np.ones(rows, bool)
    ids_a, count_a, ids_b, count_b = pair.encode(texts)
    for tokens, ids, count in ((pair.a, ids_a, count_a), (pair.b, ids_b, count_b)):
        row = np.repeat(np.arange(rows), count)
        good &= np.bincount(row, tokens.lengths[ids], rows).astype(np.int64) == sizes
        held = good[row]
        differ = tokens.joined(ids[held]) != expected[np.repeat(good, sizes)]
        if differ.any():
            at = np.flatnonzero(good)
            good[at[np.searchsorted(np.cumsum(sizes[at]), np.flatnonzero(differ), "right")]] = False
    row_a, row_b = np.repeat(np.arange(rows), count_a), np.repeat(np.arange(rows), count_b)
    long = good & (sizes > chunk_bytes)
    apart = {}
    for i in np.flatnonzero(long).tolist():
        a, b = ids_a[row_a == i], ids_b[row_b == i]
        apart[i] = tuple(np.stack([ids, np.cumsum(t.lengths[ids])], 1) for t, ids in ((pair.a, a), (pair.b, b)))
    short = good & ~long
    a, b = ids_a[short[row_a]], ids_b[short[row_b]]
    row_a, row_b = row_a[short[row_a]], row_b[short[row_b]]
    # All short texts are one stretch of bytes; their ends are common cuts.
    a = np.stack([a, np.cumsum(pair.a.lengths[a])], 1)
    b = np.stack([b, np.cumsum(pair.b.lengths[b])], 1)
    cuts = np.intersect1d(a[:, 1], b[:, 1], assume_unique=True)
    stops = np.cumsum(np.where(short, sizes, 0))
    text, group_ends = listed(pair, a, b, cuts)
    keys, ends = links(pair, a, b)
    owner = np.searchsorted(stops, ends, "left")
    of_group = np.searchsorted(stops, cuts, "left")
    n_groups = np.bincount(of_group, minlength=rows)
    space = pair.a.size * pair.b.size
    both, times = np.unique(owner * space + keys, return_counts=True)
    pair_row, pair_key = divmod(both, space)
    bounds = np.searchsorted(pair_row, np.arange(rows + 1))
    text_end = np.append(0, group_ends)[np.cumsum(n_groups)]
    data = text.tobytes()
    out = {
        "n_a": np.bincount(row_a, minlength=rows), "n_b": np.bincount(row_b, minlength=rows),
        "n_groups": n_groups, "n_links": np.bincount(owner, minlength=rows),
        "groups_sha256": [], "groups": [], "keys": [], "counts": [],
    }
    begin = 0
    for i in range(rows):
        listing = data[begin : max(begin, int(text_end[i]) - 1)]
        begin = int(text_end[i])
        out["groups_sha256"].append(hashlib.sha256(listing).hexdigest() if short[i] else "")
        out["groups"].append((listing.decode() if short[i] else "") if with_groups else None)
        out["keys"].append(pair_key[bounds[i] : bounds[i + 1]].astype(pair.kind).tobytes())
        out["counts"].append(times[bounds[i] : bounds[i + 1]].astype("<u4").tobytes())
    return out, apart


def _blocks(texts: list[str | None]) -> Iterator[list[int]]:
    """Rows with text, in blocks of about BLOCK_BYTES."""
    held, size = [], 0
    for k, text in enumerate(texts):
        if text:
            if held and size + len(text) > BLOCK_BYTES:
                yield held
                held, size = [], 0
            held.append(k)
            size += len(text)
    if held:
        yield held


def _tokenized(docs: DataFrame, files: tuple[str, str], with_groups: bool, chunk_bytes: int) -> DataFrame:
    """Finished short texts, and the tokens of the byte ranges of long ones (``at``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(*files)
        for batch in batches:
            rows, ids, texts = (batch.column(k).to_pylist() for k in range(3))
            for block in _blocks(texts):
                done, apart = _whole(pair, [texts[k] for k in block], with_groups, chunk_bytes)
                stay = [i for i in range(len(block)) if i not in apart]
                columns = {c: [v[i] for i in stay] for c, v in done.items()}
                yield _batch(columns | {"row": [rows[block[i]] for i in stay], "doc_id": [ids[block[i]] for i in stay]})
                for i, (a, b) in apart.items():
                    edges = np.arange(0, int(a[-1, 1]) + chunk_bytes, chunk_bytes)
                    cut_a, cut_b = (np.searchsorted(x[:, 1], edges, "right") for x in (a, b))
                    for k in range(len(edges) - 1):
                        part = {"a": [a[cut_a[k] : cut_a[k + 1]].astype("<i8").tobytes()], "b": [b[cut_b[k] : cut_b[k + 1]].astype("<i8").tobytes()]}
                        yield _batch(part | {"row": [rows[block[i]]], "doc_id": [ids[block[i]]], "at": [k]})
            bare = [k for k, text in enumerate(texts) if not text]
            if bare:
                zero, empty = [0] * len(bare), [b""] * len(bare)
                columns = {"n_a": zero, "n_b": zero, "n_groups": zero, "n_links": zero, "groups_sha256": [""] * len(bare), "keys": empty, "counts": empty}
                yield _batch(columns | {"groups": [""] * len(bare) if with_groups else [None] * len(bare), "row": [rows[k] for k in bare], "doc_id": [ids[k] for k in bare]})

    return docs.mapInArrow(run, f"{_DONE_SCHEMA}, at long, a binary, b binary")


_TYPES = {"groups_sha256": pa.string(), "groups": pa.string(), "text": pa.binary(), "cut": pa.bool_()} | dict.fromkeys(["keys", "counts", "a", "b", "head_a", "head_b", "tail_a", "tail_b"], pa.binary())


def _batch(columns: dict, names: list[str] | None = None) -> pa.RecordBatch:
    """``columns`` in the order of ``names``, nulls for those that are missing."""
    names = names or ["row", "doc_id", *_DONE, "at", "a", "b"]
    rows = len(columns["row"])
    return pa.RecordBatch.from_pydict({n: pa.array(columns.get(n, [None] * rows), _TYPES.get(n, pa.int64())) for n in names})


_PART_NAMES = ["row", "doc_id", "at", "cut", "head_a", "head_b", "tail_a", "tail_b", "n_a", "n_b", "n_groups", "text", "keys", "counts"]


def _packed(row: int, doc_id: int | None, at: int, f: Fragment) -> pa.RecordBatch:
    own = {n: [getattr(f, n)] for n in ("cut", "n_a", "n_b", "n_groups", "text")}
    own |= {n: [getattr(f, n).astype("<i8").tobytes()] for n in _PART}
    return _batch(own | {"row": [row], "doc_id": [doc_id], "at": [at]}, _PART_NAMES)


def _unpacked(r: dict) -> Fragment:
    arrays = {n: np.frombuffer(r[n], "<i8") for n in _PART}
    tokens = {n: v.reshape(-1, 2) if n not in ("keys", "counts") else v for n, v in arrays.items()}
    return Fragment(r["cut"], n_a=r["n_a"], n_b=r["n_b"], n_groups=r["n_groups"], text=r["text"], **tokens)


def _long(parts: DataFrame, files: tuple[str, str], with_groups: bool) -> DataFrame:
    """Texts of several byte ranges, composed in a tree of tasks."""
    deepest = parts.agg(F.max("at")).collect()[0][0] or 0  # one number

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(*files)
        for batch in batches:
            for r in batch.to_pylist():
                a, b = (np.frombuffer(r[n], "<i8").reshape(-1, 2) for n in "ab")
                yield _packed(r["row"], r["doc_id"], r["at"], fragment(pair, a, b))

    def fold(table: pa.Table) -> pa.Table:
        pair = tokenizers(*files)
        found = sorted(table.to_pylist(), key=lambda r: r["at"])
        total = Fragment()
        for r in found:
            total = compose(pair, total, _unpacked(r))
        return pa.Table.from_batches([_packed(found[0]["row"], found[0]["doc_id"], found[0]["at"] // FAN, total)])

    def close(batch: pa.RecordBatch) -> dict:
        pair = tokenizers(*files)
        out = {n: [] for n in ["row", "doc_id", *_DONE]}
        for r in batch.to_pylist():
            f = compose(pair, START, _unpacked(r))
            listing = f.text[:-1]
            values = [r["row"], r["doc_id"], f.n_a, f.n_b, f.n_groups, f.n_a + f.n_b - f.n_groups, hashlib.sha256(listing).hexdigest()]
            values += [listing.decode() if with_groups else None, f.keys.astype(pair.kind).tobytes(), f.counts.astype("<u4").tobytes()]
            for n, v in zip(out, values):
                out[n].append(v)
        return {n: pa.array(v, _TYPES.get(n, pa.int64())) for n, v in out.items()}

    found = parts.select("row", "doc_id", "at", "a", "b").repartition("row", "at").mapInArrow(make, _PART_SCHEMA)
    while deepest > 0:
        found = found.groupBy("row", F.floor(F.col("at") / FAN).alias("up")).applyInArrow(fold, _PART_SCHEMA)
        deepest //= FAN
    return mapped(found, close, _DONE_SCHEMA)


def aligned(docs: DataFrame, byte_level: str, pieces: str, with_groups: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups, keys, counts) for
    every row of ``docs``; ``row`` is a number of its own.

    ``keys`` are its linked id pairs and ``counts`` how often each is linked; with
    ``with_groups`` the listing itself is in ``groups``.  Texts that are null, empty, or
    not the bytes that their tokens spell, have zeros.
    """
    files = (byte_level, pieces)
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = kept(_tokenized(own, files, with_groups, chunk_bytes), "tokens")
    short = first.where("at IS NULL").select("row", "doc_id", *_DONE)
    return short.unionByName(kept(_long(first.where("at IS NOT NULL"), files, with_groups), "composed"))


def pair_counts(found: DataFrame, kind: str, size_b: int) -> DataFrame:
    """(key, n, best): in how many rows a pair is linked, and whether no other pair of its
    A id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0

        def merged():
            keys = np.concatenate([held[0], *fresh])
            own, at = np.unique(keys, return_inverse=True)
            weight = np.ones(len(keys), np.int64)
            weight[: len(held[1])] = held[1]
            total = np.zeros(len(own), np.int64)
            np.add.at(total, at, weight)
            return own, total

        def rows(of):
            return pa.RecordBatch.from_pydict({"key": of[0], "n": of[1]})

        for batch in batches:
            for value in batch.column(0):
                fresh.append(np.frombuffer(value.as_buffer(), kind).astype(np.int64))
                size += len(fresh[-1])
                if size > PAIRS_HELD:
                    held, fresh, size = merged(), [], 0
                    if len(held[0]) > PAIRS_HELD:
                        yield rows(held)
                        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield rows(merged())

    pairs = found.select("keys").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.expr(f"key div {size_b}")))
    return pairs.select("key", "n", (F.col("n") == most).alias("best"))


def digests(docs: DataFrame, byte_level: str, pieces: str, at_once: int = PAIRS_AT_ONCE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every
    row of ``docs``.

    Null and empty texts, and texts that do not come back from the bytes of their tokens,
    have zeros and an empty hash.  Repeated rows count as documents of their own; rows
    without id count like others; an empty table gives no rows.  Other columns are not read.
    The counts of pairs are broadcast up to ``at_once`` of them and joined beyond.
    """
    pair = tokenizers(byte_level, pieces)
    kind, size_b = pair.kind.str, pair.b.size
    found = aligned(docs, byte_level, pieces, chunk_bytes=chunk_bytes)
    pairs = kept(pair_counts(found, kind, size_b), "pairs")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if pairs.count() > at_once:
        spread = _spread(found, kind).join(pairs, "key").groupBy("row")
        sums = spread.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        out = found.join(sums, "row", "left")
        return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")}).select(*names)
    table = pairs.toArrow()
    keys = table.column(0).to_numpy()
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], table.column(1).to_numpy()[order], table.column(2).to_numpy()[order]))
    del table, keys, order

    def step(batch: pa.RecordBatch) -> dict:
        known, n, best = shared.value
        own = [np.frombuffer(v.as_buffer(), kind) for v in batch.column(6)]
        times = np.concatenate([np.frombuffer(v.as_buffer(), "<u4") for v in batch.column(7)]).astype(np.int64)
        row = np.repeat(np.arange(len(own)), [len(k) for k in own])
        at = np.searchsorted(known, np.concatenate(own).astype(np.int64))
        out = {c: batch.column(k) for k, c in enumerate(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])}
        sums = [np.zeros(len(own), np.int64) for _ in range(2)]
        np.add.at(sums[0], row, times * best[at])
        np.add.at(sums[1], row, times * n[at])
        return {c: out.get(c) if c in out else sums[c == "count_sum"] for c in names}

    used = found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "counts")
    return mapped(used, step, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _spread(found: DataFrame, kind: str) -> DataFrame:
    """(row, key, times): a row to each pair of each text."""

    def step(batch: pa.RecordBatch) -> dict:
        keys = [np.frombuffer(v.as_buffer(), kind) for v in batch.column(1)]
        times = [np.frombuffer(v.as_buffer(), "<u4") for v in batch.column(2)]
        rows = np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])
        return {"row": rows, "key": np.concatenate(keys).astype(np.int64), "times": np.concatenate(times).astype(np.int64)}

    return mapped(found.select("row", "keys", "counts"), step, "row long, key long, times long")
