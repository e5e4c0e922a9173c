"""Toxicity by a chain of linear models.

The categories are predicted one after the other; each model sees the words of a text
and the log-odds that the models before it gave.  While fitting, those come from models
that had not seen the text (out-of-fold), so that later models learn how far earlier
ones can be trusted on new text.  Features are the distinct words of a text and their
first letters (3 to 7 bytes), hashed; only those that go with a category enter its model.

All labelled texts are learnt from.  They are dealt into groups of bounded size, a task
fits a chain to a group, and the chain that judges has the means of their weights.  Texts
are turned into features where they are read; only these are shuffled, and only those of
texts that may have a label, as a bitmap of hashes of the labelled ids tells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.llm.ranks import mixed
from galeframe.llm.support import extended, mapped, tasks, utf8
from galeframe.llm.words import distinct, doc_blocks, letter_words, lowered, ragged, word_hashes

# The chain, in its order: poor writing, toxic, and both at once.
CATEGORIES = ("junk", "toxic", "severe")
# Expected number of texts with and without the label in a group.
GROUP_TEXTS = 2500
# Bits of the bitmap for a labelled id, so that few other texts pass, and most bits of all
# (32 MiB); what passes is joined exactly, so fewer bits let more pass and change no result.
ID_BITS, MOST_BITS = 16, 1 << 28
# Bytes of text, texts of a group and entries (text, feature) of it that are looked at
# together: what a task holds beside its rows follows these.
TEXT_BYTES, SOME_TEXTS, PIECE = 1 << 18, 256, 1 << 18
# Weights are summed as whole numbers of this fraction, so that their order is all one.
FRACTION = 1e-9
FOLDS = 4
PREFIXES = range(3, 8)
SLOTS = 1 << 20
# A feature enters a model if its shares in the two classes differ by so many standard
# errors; at most this many do.  The limit is low, so that words of a language with few
# labelled texts enter too; noise among them is held down by the penalty.
LEAST_Z, MOST_FEATURES = 3.0, 3000
# Penalty on half a squared weight, against the sum of the losses of all texts: a weight
# that few texts speak for stays small.
SHRINK = 1.0
ROUNDS, RATE, PENALTY = 120, 0.3, 1e-3
REJECT = 0.4


def _kinds(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Feature slots of words: the word and its prefixes (words by features; -1: none)."""
    out = [word_hashes(text, begin, end)]
    for n in PREFIXES:
        whole = end - begin <= n
        out.append(np.where(whole, np.uint64(0), word_hashes(text, begin, np.where(whole, end, begin + n)) + np.uint64(n)))
    keys = np.stack(out, 1)
    return np.where(keys == 0, -1, (mixed(keys) % np.uint64(SLOTS)).astype(np.int64))


def features(text: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None):
    """(row, slot) of every distinct feature of every text; ``wanted`` limits the slots."""
    rows, slots = [], []
    for a, b in doc_blocks(offsets, TEXT_BYTES):
        block = lowered(text[offsets[a] : offsets[b]])
        heads = offsets[a:b] - offsets[a]
        begin, end = letter_words(block, heads[heads < len(block)])
        if not len(begin):
            continue
        owner = np.searchsorted(heads, begin, "right") - 1
        one, kind = distinct(block, begin, end)
        slot = _kinds(block, begin[one], end[one])
        use = slot >= 0
        if wanted is not None:
            use &= wanted[np.maximum(slot, 0)]
        per_word = use.sum(1)
        held = np.flatnonzero(per_word[kind])
        kind, owner = kind[held], owner[held]
        flat, first = slot[use], np.cumsum(per_word) - per_word
        pairs = np.repeat(owner, per_word[kind]) * SLOTS + flat[ragged(first[kind], per_word[kind])]
        pairs = np.unique(pairs)
        rows.append(pairs // SLOTS + a)
        slots.append(pairs % SLOTS)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(slots)


@dataclass
class Linear:
    slots: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray  # weights of the log-odds before it in the chain
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(SLOTS)
        out[self.slots] = self.weights
        return out

    def log_odds(self, sums: np.ndarray, before: np.ndarray) -> np.ndarray:
        """``sums``: of the weights of each text's features."""
        out = sums + self.bias
        return out + before @ self.earlier if len(self.earlier) else out


@dataclass
class _Runs:
    """Entries ordered by a number, so that sums by it are sums of runs."""

    order: np.ndarray
    start: np.ndarray
    number: np.ndarray

    def sums(self, values: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        if len(self.start):
            out[self.number] = np.add.reduceat(values, self.start)
        return out


def _runs_of(numbers: np.ndarray) -> _Runs:
    order = np.argsort(numbers, kind="stable").astype(np.int32)
    placed = numbers[order]
    start = np.flatnonzero(np.append(True, placed[1:] != placed[:-1])[: len(placed)])
    return _Runs(order, start, placed[start])


def _pieces(row: np.ndarray, slot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a in range(0, max(1, len(row)), PIECE):
        yield row[a : a + PIECE], slot[a : a + PIECE]


def _filled(n: int, pieces: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` entries of the pieces in which neither number is negative."""
    row, column, at = np.empty(n, np.int32), np.empty(n, np.int32), 0
    for r, c in pieces:
        use = (r >= 0) & (c >= 0)
        to = slice(at, at + int(use.sum()))
        row[to], column[to], at = r[use], c[use], to.stop
    return row, column


def _fit_one(row: np.ndarray, number: np.ndarray, names: np.ndarray, inside: np.ndarray, before: np.ndarray, label: np.ndarray) -> Linear:
    """A penalised logistic regression on the features that go with the label.

    Only texts ``inside`` are learnt from; feature ``number`` has the slot ``names[number]``.
    """
    n = int(inside.sum())
    chosen = inside & label
    count, with_label = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    for r, c in _pieces(row, number):
        count += np.bincount(c[inside[r]], minlength=len(names))
        with_label += np.bincount(c[chosen[r]], minlength=len(names))
    place = np.where(inside, np.cumsum(inside) - 1, -1).astype(np.int32)
    before, label = before[inside], label[inside]
    positive = max(1, int(label.sum()))
    negative = max(1, n - positive)
    p, q, all_ = with_label / positive, (count - with_label) / negative, count / max(1, n)
    z = np.abs(p - q) / np.sqrt(np.maximum(all_ * (1 - all_), 1e-12) * (1 / positive + 1 / negative))
    slots = np.flatnonzero((z >= LEAST_Z) & (count >= 3))
    slots = np.sort(slots[np.argsort(-z[slots], kind="stable")[:MOST_FEATURES]])
    index = np.full(len(names), -1, np.int32)
    index[slots] = np.arange(len(slots))
    row, column = _filled(int(count[slots].sum()), ((place[r], index[c]) for r, c in _pieces(row, number)))
    # Sums by text and by feature are sums of runs, as entries are in either order.
    by_text, by_feature = _runs_of(row), _runs_of(column)
    of_text, of_feature = column[by_text.order], row[by_feature.order]
    del row, column
    weights, earlier, bias = np.zeros(len(slots)), np.zeros(before.shape[1]), 0.0
    grown = [np.full(len(slots), 1e-8), np.full(before.shape[1], 1e-8), 1e-8]
    for _ in range(ROUNDS):
        odds = by_text.sums(weights[of_text], n) + before @ earlier + bias
        error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - label) / max(1, n)
        slopes = [by_feature.sums(error[of_feature], len(slots)) + SHRINK * weights / max(1, n), before.T @ error + PENALTY * earlier, error.sum()]
        grown = [g + s * s for g, s in zip(grown, slopes)]
        weights -= RATE * slopes[0] / np.sqrt(grown[0])
        earlier -= RATE * slopes[1] / np.sqrt(grown[1])
        bias -= RATE * slopes[2] / np.sqrt(grown[2])
    return Linear(names[slots], weights, earlier, float(bias))


@dataclass
class Chain:
    categories: tuple[str, ...]
    links: list[Linear]

    def wanted(self) -> np.ndarray:
        out = np.zeros(SLOTS, bool)
        for link in self.links:
            out[link.slots] = True
        return out

    def probabilities(self, row: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        """Texts by categories."""
        odds = np.zeros((n, 0))
        for link in self.links:
            odds = np.column_stack([odds, np.clip(link.log_odds(np.bincount(row, link.table()[slot], n), odds), -15, 15)])
        return 1 / (1 + np.exp(-odds))


def fit(texts: list[str], labels: dict[str, np.ndarray], folds: int = FOLDS) -> Chain:
    """A chain over ``labels`` (category -> booleans), in that order."""
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    row, slot = features(np.frombuffer(b"".join(raw), np.uint8), offsets)
    return _fit_chain(lambda: _pieces(row, slot), len(texts), labels, folds)


def _frequent(pieces: Callable[[], Iterable[tuple[np.ndarray, np.ndarray]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (row, number) of features of three texts or more, and the slots of the
    numbers; no model takes a feature of fewer."""
    count = np.zeros(SLOTS, np.int64)
    for _, slot in pieces():
        count += np.bincount(slot, minlength=SLOTS)
    names = np.flatnonzero(count >= 3)
    number = np.full(SLOTS, -1, np.int32)
    number[names] = np.arange(len(names))
    return *_filled(int(count[names].sum()), ((row, number[slot]) for row, slot in pieces())), names


def _fit_chain(pieces: Callable[[], Iterable[tuple[np.ndarray, np.ndarray]]], n: int, labels: dict[str, np.ndarray], folds: int = FOLDS) -> Chain:
    """``pieces`` gives the entries (row, slot) of ``n`` texts, rows in order, a piece at a time."""
    row, number, names = _frequent(pieces)
    starts = np.searchsorted(row, np.arange(0, n + SOME_TEXTS, SOME_TEXTS))
    fold, everyone = np.arange(n) % folds, np.ones(n, bool)
    odds, links = np.zeros((n, 0)), []
    for label in labels.values():
        label = label.astype(bool)
        links.append(_fit_one(row, number, names, everyone, odds, label))
        unseen = np.zeros(n)
        for k in range(folds if n >= 2 * folds else 0):
            inside = fold != k
            link = _fit_one(row, number, names, inside, odds, label)
            table, sums = link.table()[names], np.zeros(n)
            # All entries of a text are in one piece, so the order of its sum is that of the whole.
            for at, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                own = slice(at * SOME_TEXTS, min(n, (at + 1) * SOME_TEXTS))
                sums[own] = np.bincount(row[a:b] - own.start, table[number[a:b]], own.stop - own.start)
            unseen[~inside] = link.log_odds(sums, odds)[~inside]
        odds = np.column_stack([odds, np.clip(unseen, -15, 15)])
    return Chain(tuple(labels), links)


def packed_features(text: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The packed features of every text."""
    out = []
    for a, b in doc_blocks(offsets, TEXT_BYTES):
        out += packed(*features(text[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), b - a)
    return out


def packed(row: np.ndarray, slot: np.ndarray, n: int) -> list[bytes]:
    """The sorted slots of every text in two bytes each, after how many have each upper half."""
    upper = np.bincount(row * (SLOTS >> 16) + (slot >> 16), minlength=n * (SLOTS >> 16)).reshape(n, -1).astype("<u4")
    lower = (slot & 0xFFFF).astype("<u2")
    ends = np.append(0, np.cumsum(upper.sum(1, dtype=np.int64)))
    return [upper[k].tobytes() + lower[ends[k] : ends[k + 1]].tobytes() for k in range(n)]


def unpacked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) as ``features`` gives them."""
    head = (SLOTS >> 16) * 4
    upper = np.frombuffer(b"".join(t[:head] for t in texts), "<u4").astype(np.int64)
    lower = np.frombuffer(b"".join(t[head:] for t in texts), "<u2").astype(np.int64)
    at = np.repeat(np.arange(len(upper)), upper)
    return at // (SLOTS >> 16), at % (SLOTS >> 16) << 16 | lower


def _place(bits: int) -> Column:
    """The bit of a doc_id."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits))


def bitmap(known: DataFrame, n: int) -> np.ndarray:
    """Bytes with the bits of all doc_ids of ``known`` set; ``n`` is their number."""
    bits = min(MOST_BITS, 1 << max(15, (ID_BITS * n).bit_length()))
    place = _place(bits) + 1  # Spark's functions count from 1
    parts = known.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for part, held in parts.collect():
        out[part - 1] = np.frombuffer(held, np.uint8)
    return out.ravel()


def _candidates(docs: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """(doc_id, slots) of all texts with a label, and of few others."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(known, n))
    bits = len(shared.value) * 8

    def step(batch: pa.RecordBatch) -> dict | None:
        at = batch.column(2).to_numpy()
        batch = batch.filter(pa.array(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1))
        if not batch.num_rows:
            return None
        return {"doc_id": batch.column(0), "slots": packed_features(*utf8(batch.column(1)))}

    read = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    return mapped(read.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _place(bits)), step, "doc_id long, slots binary")


def dealt(docs: DataFrame, labels: DataFrame, texts: int = GROUP_TEXTS) -> tuple[DataFrame, int]:
    """Every labelled text (_group, doc_id, slots, toxic, quality), and the number of groups.

    Either class is dealt by a hash of doc_id into shares of about ``texts``; a group is a
    share of one and a share of the other.  The class with fewer shares takes turns, so
    groups are alike in size and in balance, whatever the labels.  Rows of ``labels`` with
    a null id or a null toxic are not used; a doc_id labelled twice counts once.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").alias("toxic"), F.min(F.coalesce("quality", F.lit(1))).alias("quality")
    )
    sizes = {int(r[0]): r[1] for r in known.groupBy(F.when(F.col("toxic") > 0, 1).otherwise(0)).count().collect()}
    shares = [max(1, -(-sizes.get(k, 0) // texts)) for k in (0, 1)]
    groups = max(shares)
    mine = F.when(F.col("toxic") > 0, shares[1]).otherwise(shares[0])
    first = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), mine)
    # One plan at every size: no labels are broadcast, however few.
    found = _candidates(docs, known, sum(sizes.values())).join(known.hint("merge"), "doc_id")
    return found.withColumn("_group", F.explode(F.sequence(first, F.lit(groups - 1).cast("long"), mine.cast("long")))), groups


def _fit_group(table: pa.Table) -> pa.Table:
    """The weights (link, slot, weight) of a chain fitted to a group; slots below 0 are the
    bias (-1) and the weights of earlier links (-2 and so on)."""
    # A doc_id stored twice counts once.
    texts = table["slots"].to_pylist()
    one = {i: k for k, i in sorted(enumerate(table["doc_id"].to_pylist()), key=lambda x: texts[x[0]], reverse=True)}
    order = [one[i] for i in sorted(one, key=lambda i: (hash_of(i), i))]
    toxic, junk = table["toxic"].to_numpy()[order] > 0, table["quality"].to_numpy()[order] == 0

    def pieces() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a in range(0, len(order), SOME_TEXTS):
            row, slot = unpacked([texts[k] for k in order[a : a + SOME_TEXTS]])
            yield row + a, slot

    chain = _fit_chain(pieces, len(order), dict(zip(CATEGORIES, (junk, toxic, toxic & junk))))
    link, slot, weight = [], [], []
    for k, model in enumerate(chain.links):
        slot += [model.slots, -2 - np.arange(len(model.earlier)), [-1]]
        weight += [model.weights, model.earlier, [model.bias]]
        link.append(np.full(len(model.slots) + len(model.earlier) + 1, k))
    columns = (np.concatenate(link), np.concatenate(slot).astype(np.int64), np.rint(np.concatenate(weight) / FRACTION).astype(np.int64))
    return pa.table(dict(zip(("link", "slot", "weight"), columns)))


def train(docs: DataFrame, labels: DataFrame, texts: int = GROUP_TEXTS) -> Chain:
    """Fitted on all labelled texts in groups of about ``texts`` of either class.

    The driver gets one row to each feature of the mean, however many groups there are.
    """
    rows, groups = dealt(docs, labels, texts)
    # One task to a group at a time; few groups would otherwise be merged into one task.
    fitted = rows.repartition(max(groups, tasks(docs.sparkSession)), "_group").groupBy("_group")
    fitted = fitted.applyInArrow(_fit_group, "link long, slot long, weight long")
    sums = fitted.groupBy("link", "slot").agg(F.sum("weight").alias("sum"), F.count(F.lit(1)).alias("n")).toArrow()
    if not sums.num_rows:
        return fit([], {c: np.zeros(0, bool) for c in CATEGORIES})
    link, slot, total, n = (sums.column(c).to_numpy() for c in ("link", "slot", "sum", "n"))
    order, number = np.lexsort((slot, link)), n[slot == -1].max()
    link, slot, mean = link[order], slot[order], total[order] * FRACTION / number
    links = []
    for k in range(len(CATEGORIES)):
        mine, weights = slot[link == k], mean[link == k]
        # In order the earlier links come last to first, then the bias, then the features.
        links.append(Linear(mine[k + 1 :], weights[k + 1 :], weights[:k][::-1].copy(), float(weights[k])))
    return Chain(CATEGORIES, links)


def hash_of(doc_id: int) -> int:
    return int(mixed(np.array([doc_id], np.int64).view(np.uint64))[0])


def _judged(chain: Chain, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the categories, and which texts are rejected."""
    n = len(offsets) - 1
    row, slot = features(text, offsets, chain.wanted())
    p = chain.probabilities(row, slot, n)
    some = np.zeros(n, bool)
    some[row] = True
    return p, (p[:, chain.categories.index("toxic")] >= REJECT) & some


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, junk, toxic, severe, rejected): probabilities for every whole text.

    ``rejected`` where the probability of toxic is at least ``REJECT``.  A null, empty
    or wordless text has the probabilities of a text without features and is never
    rejected.  Repeated rows are scored each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def step(batch: pa.RecordBatch) -> dict:
        p, rejected = _judged(shared.value, *utf8(batch.column(1)))
        return {"doc_id": batch.column(0)} | {c: p[:, k] for k, c in enumerate(shared.value.categories)} | {"rejected": rejected}

    columns = ", ".join(f"{c} double" for c in CATEGORIES)
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, f"doc_id long, {columns}, rejected boolean")


def accepted(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    marked = extended(docs, "text", lambda texts: {"_gf_rejected": _judged(shared.value, *utf8(texts))[1]}, "_gf_rejected boolean")
    return marked.where("NOT _gf_rejected").drop("_gf_rejected")
