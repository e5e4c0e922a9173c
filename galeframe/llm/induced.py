"""Suffix sorting by induction, with queues on disk.

The suffixes that start a descent after an ascent (leftmost S-type, LMS) are sorted
first: an induction over the text sorts the substrings between them, names replace the
substrings, and the shorter text of names is sorted by the same procedure, down to a text
that fits in memory.  Two further inductions carry that order to all suffixes.  Each reads a priority queue of suffix tuples
(symbol, turn, position, common prefix) and puts back the suffix one position earlier; the
common prefix of neighbours travels in the tuples, as one more than the least common
prefix met between their two origins.

A queue keeps its tuples by symbol range and spills them to a file when they exceed its
memory, so it is written and read in sequence.  Tuples are taken in batches: the longest
prefix of the queue that cannot put anything back before its own end.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

from galeframe.llm.ranks import ragged

# Tuples a queue holds in memory before it spills.
MEMORY = 1 << 21
# Symbols of a text that are looked at together.
PIECE = 1 << 18
# A shorter text of at most so many names is sorted in memory.
IN_MEMORY = 1 << 22
# Tuples of a symbol range of the shorter texts, about.
RANGE = 4096
_TUPLE = np.dtype([("at", "<i8"), ("common", "<i8")])


class Queue:
    """Tuples by symbol range, in the order they came; old ones lie in a file."""

    def __init__(self, ranges: int, folder: str, memory: int):
        self.memory, self.used = memory, 0
        self.held: list[list[np.ndarray]] = [[] for _ in range(ranges)]
        self.extents: list[list[tuple[int, int]]] = [[] for _ in range(ranges)]
        self.folder, self.file = folder, None

    def push(self, part: int, tuples: np.ndarray) -> None:
        self.held[part].append(tuples)
        self.used += len(tuples)
        if self.used > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            handle, path = tempfile.mkstemp(dir=self.folder)
            self.file = os.fdopen(handle, "w+b")
            os.unlink(path)  # goes with the last handle, whatever happens
        self.file.seek(0, os.SEEK_END)
        for part, held in enumerate(self.held):
            if held:
                data = np.concatenate(held)
                self.extents[part].append((self.file.tell(), len(data)))
                self.file.write(data.tobytes())
                held.clear()
        self.used = 0

    def pop(self, part: int) -> np.ndarray:
        """All tuples of a range, in the order they came."""
        out = []
        for start, count in self.extents[part]:
            self.file.seek(start)
            out.append(np.frombuffer(self.file.read(count * _TUPLE.itemsize), _TUPLE))
        self.extents[part] = []
        held, self.held[part] = self.held[part], []
        self.used -= sum(map(len, held))
        out += held
        return np.concatenate(out) if out else np.zeros(0, _TUPLE)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S-type)."""
    out = np.zeros(len(text), bool)
    behind = False  # type of what follows the piece
    for b in range(len(text), 0, -PIECE):
        a = max(0, b - PIECE)
        here = text[a:b].astype(np.int64)
        step = np.sign(np.diff(np.append(here, text[b] if b < len(text) else -1)))
        decided = np.where(step != 0, np.arange(b - a), b - a)
        decided = np.minimum.accumulate(decided[::-1])[::-1]
        out[a:b] = np.append(step > 0, behind)[decided]
        behind = out[a]
    return out


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix, up to ``cap``, of the suffixes at a and b; ``text`` goes on for
    ``cap`` + 8 bytes that are not part of it."""
    out = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    done = 0
    spread = np.arange(8)
    while len(active) and done < cap:
        differ = text[(a[active] + done)[:, None] + spread] != text[(b[active] + done)[:, None] + spread]
        some = differ.any(1)
        same = np.where(some, differ.argmax(1), 8)
        out[active] += same
        active = active[~some]
        done += 8
    return np.minimum(out, np.minimum(cap, len(text) - cap - 8 - np.maximum(a, b)))


def _induce(
    text: np.ndarray, want: np.ndarray, seeds: Queue, ranges: np.ndarray, up: bool, start: int, folder: str, memory: int, symbols: int,
    cap: int = 0, padded: np.ndarray | None = None,
) -> Queue:
    """One induction: the suffixes of type ``want`` in order, by range.

    ``seeds`` holds the sorted suffixes that begin it, by range; they come after the
    induced ones of their symbol.  ``up``: ascending (else descending).  ``start``: a
    position that comes before everything, or -1.  ``cap``: how far common prefixes are
    followed (0: not at all; a text of bytes only), in ``padded``, the text with some
    bytes behind it.  A first seed after induced suffixes of its symbol is compared
    outright.
    """
    parts = int(ranges[-1]) + 1
    queue, out = Queue(parts, folder, memory), Queue(parts, folder, memory)
    least = np.full(symbols if cap else 0, -1, np.int64)  # common prefix since a symbol was last put back

    def put_back(batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tuples one position earlier, where of the wanted type, and their symbols."""
        before = batch["at"] - 1
        hit = np.flatnonzero(before >= 0)
        hit = hit[want[before[hit]]]
        new = np.empty(len(hit), _TUPLE)
        new["at"] = before[hit]
        symbol = text[new["at"]]
        if symbols > 256:
            symbol = symbol.astype(np.int64)
        if cap:
            common = np.ascontiguousarray(batch["common"])
            order = np.argsort(symbol, kind="stable")
            cut = np.flatnonzero(np.r_[True, symbol[order[1:]] != symbol[order[:-1]]]) if len(hit) else []
            ends = np.append(cut[1:], len(hit)) if len(hit) else []
            touched = symbol[order[cut]] if len(hit) else np.zeros(0, np.int64)
            rest = np.ones(len(least), bool)
            rest[touched] = False
            tails = []
            for s, a, b in zip(touched.tolist(), cut, ends):
                mine = order[a:b]
                stops = hit[mine] + 1
                spans = np.minimum.reduceat(common, np.append(0, stops if stops[-1] < len(common) else stops[:-1]))
                spans = spans.astype(np.int64)
                spans[0] = min(spans[0], least[s])
                new["common"][mine] = np.minimum(spans[: len(mine)] + 1, cap)
                tails.append(spans[-1] if stops[-1] < len(common) else cap)
            if len(common):
                least[rest] = np.minimum(least[rest], int(common.min()))
            least[touched] = tails
        else:
            new["common"] = 0
        return new, symbol

    if start >= 0:
        first = np.zeros(1, _TUPLE)
        first["at"] = start
        queue.push(int(ranges[text[start]]), first)
        if cap:
            least[text[start]] = 0
    def push(new: np.ndarray, where: np.ndarray) -> None:
        if len(new):
            order = np.argsort(where, kind="stable")
            new, where = new[order], where[order]
            cut = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
            for part, piece in zip(where[cut].tolist(), np.split(new, cut[1:])):
                queue.push(part, piece)

    sequence = range(parts) if up else range(parts - 1, -1, -1)
    if symbols <= 256:
        # One symbol to a range: what is put back into it follows all that is there, and
        # comes before the seeds.
        for part in sequence:
            ready, last = queue.pop(part), -1
            while len(ready):
                out.push(part, ready)
                last = int(ready["at"][-1])
                new, symbol = put_back(ready)
                here = symbol == part
                push(new[~here], symbol[~here])
                ready = new[here]
            seed = seeds.pop(part)
            if len(seed):
                if cap and last >= 0:
                    seed = seed.copy()
                    seed["common"][0] = _common(padded, np.array([last]), seed["at"][:1], cap)[0]
                push(*put_back(seed))
        queue.close()
        return out
    for part in sequence:
        waiting, seed = queue.pop(part), seeds.pop(part)
        symbol = np.concatenate([text[waiting["at"]], text[seed["at"]]]).astype(np.int64)
        rank = (symbol if up else symbols - 1 - symbol) * 2
        rank[len(waiting) :] += 1
        batch = np.concatenate([waiting, seed])
        order = np.argsort(rank, kind="stable")
        batch, rank = batch[order], rank[order]
        while len(batch):
            # The longest prefix that puts nothing back before its end.
            before = batch["at"] - 1
            ok = before >= 0
            inner = np.full(len(batch), np.iinfo(np.int64).max)
            spot = np.flatnonzero(ok)
            spot = spot[want[before[spot]]]
            back = text[before[spot]].astype(np.int64)
            local = ranges[back] == part
            spot, back = spot[local], back[local]
            inner[spot] = (back if up else symbols - 1 - back) * 2
            bound = np.minimum.accumulate(inner)
            stop = len(batch) if not len(spot) else int(np.searchsorted(rank > bound, True)) if rank[-1] > bound[-1] else len(batch)
            ready, ready_rank = batch[:stop], rank[:stop]
            made = ready[ready_rank % 2 == 0]
            if len(made):
                out.push(part, made)
            new, symbol = put_back(ready)
            where = ranges[symbol]
            here = where == part
            push(new[~here], where[~here])
            batch, rank = batch[stop:], rank[stop:]
            if here.any():
                more = symbol[here]
                batch = np.concatenate([batch, new[here]])
                rank = np.concatenate([rank, (more if up else symbols - 1 - more) * 2])
                order = np.argsort(rank, kind="stable")
                batch, rank = batch[order], rank[order]
    queue.close()
    return out


def _ranges(text: np.ndarray, symbols: int) -> np.ndarray:
    """Range of every symbol: one each for bytes, else about RANGE suffixes to a range."""
    if symbols <= 256:
        return np.arange(symbols)
    count = np.bincount(text, minlength=symbols)
    return (np.cumsum(count) - count) // max(RANGE, len(text) // 4096)


def _queue_of(at: np.ndarray, text: np.ndarray, ranges: np.ndarray, folder: str, memory: int, common: np.ndarray | None = None) -> Queue:
    """A queue that holds sorted suffixes."""
    ranges = _dense(ranges)
    out = Queue(int(ranges[-1]) + 1, folder, memory)
    tuples = np.zeros(len(at), _TUPLE)
    tuples["at"] = at
    if common is not None:
        tuples["common"] = common
    part = ranges[text[at]]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(at) else []
    for a, b in zip(cut, np.append(cut[1:], len(at)) if len(at) else []):
        out.push(int(part[a]), tuples[a:b])
    return out


def _dense(ranges: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[0, np.diff(ranges) != 0])


def _drained(queue: Queue, parts: Iterator[int]) -> Iterator[np.ndarray]:
    for part in parts:
        got = queue.pop(part)
        if len(got):
            yield got
    queue.close()


def _both(text, smaller, seeds_at, symbols, folder, memory, common=None, cap=0, padded=None):
    """The two inductions from sorted (or, to sort substrings, grouped) LMS suffixes:
    queues with the L-type suffixes ascending and the S-type ones descending."""
    ranges = _dense(_ranges(text, symbols))
    seeds = _queue_of(seeds_at, text, ranges, folder, memory, common)
    large = _induce(text, ~smaller, seeds, ranges, True, len(text) - 1, folder, memory, symbols, cap, padded)
    # Descending: the same suffixes from the back, each with the prefix it shares with the
    # one that came after it before.
    back = Queue(int(ranges[-1]) + 1, folder, memory)
    kept = Queue(int(ranges[-1]) + 1, folder, memory)
    for part in range(int(ranges[-1]) + 1):
        tuples = large.pop(part)
        if not len(tuples):
            continue
        kept.push(part, tuples)
        turned = tuples[::-1].copy()
        turned["common"][1:] = tuples["common"][:0:-1]
        turned["common"][0] = 0
        back.push(part, turned)
    large.close()
    small = _induce(text, smaller, back, ranges, False, -1, folder, memory, symbols, cap, padded)
    back.close()
    return kept, small, int(ranges[-1]) + 1


def lms_order(text: np.ndarray, symbols: int, folder: str, memory: int = MEMORY) -> np.ndarray:
    """Positions of the LMS suffixes in the order of the suffixes."""
    smaller = _types(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) < 2:
        return lms
    grouped = lms[np.argsort(text[lms], kind="stable")]
    large, small, parts = _both(text, smaller, grouped, symbols, folder, memory)
    large.close()
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    order = [t["at"][is_lms[t["at"]]] for t in _drained(small, iter(range(parts - 1, -1, -1)))]
    order = np.concatenate(order)[::-1]
    # Substrings reach to the next LMS position, and are equal if all symbols are.
    number = np.empty(len(text), np.int64)
    number[lms] = np.arange(len(lms))
    size = np.diff(np.append(lms, len(text))) + 1
    size[-1] -= 1
    length = size[number[order]]
    same = np.zeros(len(order), bool)
    every = np.flatnonzero(length[1:] == length[:-1])
    for a in range(0, len(every), PIECE // 4):
        pairs = every[a : a + PIECE // 4]
        flat_a, flat_b = ragged(order[pairs], length[pairs]), ragged(order[pairs + 1], length[pairs])
        differ = text[flat_a] != text[flat_b]
        clean = np.ones(len(pairs), bool)
        clean[np.searchsorted(np.cumsum(length[pairs]), np.flatnonzero(differ), "right")] = False
        same[pairs[clean] + 1] = True
    # The last substring ends with the text, so it equals no other.
    at_last = int(np.flatnonzero(order == lms[-1])[0])
    same[at_last] = False
    if at_last + 1 < len(same):
        same[at_last + 1] = False
    name = np.cumsum(~same) - 1
    if int(name[-1]) + 1 == len(lms):
        return order
    shorter = np.empty(len(lms), np.int64)
    shorter[number[order]] = name
    return lms[suffix_order(shorter, int(name[-1]) + 1, folder, memory)]


def _doubled(text: np.ndarray) -> np.ndarray:
    """All suffixes in order, in memory: what is still tied is sorted by twice the length."""
    n, size = len(text), 1
    order = np.argsort(text, kind="stable")
    if not n:
        return order
    fresh = np.r_[True, text[order[1:]] != text[order[:-1]]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    while True:
        tied = ~(fresh & np.append(fresh[1:], True))
        spot = np.flatnonzero(tied)
        if not len(spot):
            return order
        mine = order[spot]
        behind = np.where(mine + size < n, rank[np.minimum(mine + size, n - 1)] + 1, 0)
        key = rank[mine] * (n + 1) + behind
        inner = np.argsort(key, kind="stable")
        order[spot] = mine[inner]
        key = key[inner]
        fresh[spot] |= np.r_[True, key[1:] != key[:-1]]
        rank[order[spot]] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))[spot]
        size *= 2


def suffix_order(text: np.ndarray, symbols: int, folder: str, memory: int = MEMORY) -> np.ndarray:
    """All suffixes in order; the end of the text is smaller than any symbol."""
    n = len(text)
    if n <= IN_MEMORY:
        return _doubled(text)
    smaller = _types(text)
    first = lms_order(text, symbols, folder, memory)
    large, small, parts = _both(text, smaller, first, symbols, folder, memory)
    out = []
    for part in range(parts):
        down, up = small.pop(part)[::-1], large.pop(part)
        both = np.concatenate([up["at"], down["at"]])
        if symbols > 256 and len(both):
            both = both[np.argsort(text[both], kind="stable")]
        out.append(both)
    large.close()
    small.close()
    return np.concatenate(out)


def repeats(text: np.ndarray, length: int, folder: str, memory: int = MEMORY) -> Iterator[np.ndarray]:
    """Positions whose next ``length`` bytes start anywhere else in the text too.

    ``text`` has bytes; positions less than ``length`` from its end are never given.
    """
    n = len(text)
    if n < max(length, 32):
        seen: dict[bytes, list[int]] = {}
        data = text.tobytes()
        for i in range(n - length + 1):
            seen.setdefault(data[i : i + length], []).append(i)
        yield np.array(sorted(i for at in seen.values() if len(at) > 1 for i in at), np.int64)
        return
    padded = np.concatenate([text, np.zeros(length + 8, text.dtype)])
    smaller = _types(text)
    first = lms_order(text, 256, folder, memory)
    common = np.zeros(len(first), np.int64)
    common[1:] = _common(padded, first[:-1], first[1:], length)
    large, small, parts = _both(text, smaller, first, 256, folder, memory, common, length, padded)
    for part in range(parts):
        up, down = large.pop(part), small.pop(part)
        for tuples in (up, down):
            near = tuples["common"] >= length
            hit = near.copy()
            hit[:-1] |= near[1:]
            yield tuples["at"][hit]
        if len(up) and len(down):  # where the two meet
            pair = np.array([up["at"][-1]]), np.array([down["at"][-1]])
            if _common(padded, *pair, length)[0] >= length:
                yield np.concatenate(pair)
    large.close()
    small.close()

