"""Anchors: places that every copy of a long enough string has in common.

Every window of ``window`` bytes chooses the k-gram of least hash in it (the rightmost
of equal ones).  The choice depends on the window's bytes alone, so equal windows, where
ever they stand, choose the same k-gram at the same distance.  Strings that repeat are
therefore found among the contexts of anchors with equal k-grams.
"""

from __future__ import annotations

import numpy as np

from galeframe.llm.ranks import mixed, powers, word_hashes

_LOW = np.uint64((1 << 24) - 1)
# Text handled at a time; positions in a piece have 24 bits.
PIECE = 1 << 16


def _chosen(text: np.ndarray, window: int, k: int) -> np.ndarray:
    """Position of the k-gram chosen by the window at every start."""
    n = len(text)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(n), out=sums[1:])
    gram = mixed((sums[k:] - sums[:-k]) * powers(n + 1, back=True)[: n - k + 1])
    at = np.arange(len(gram), dtype=np.uint64)
    least = (gram & ~_LOW) | (_LOW - at)
    width, have = window - k + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    return (_LOW - (least & _LOW)).astype(np.int64)


def anchors(text: np.ndarray, offsets: np.ndarray, window: int, k: int) -> dict[str, np.ndarray]:
    """The anchors of texts given end to end.

    ``row``: the text, ``lo`` and ``span``: first window (from the text's start) that
    chose the anchor and how many more did, ``off``: distance of the k-gram from it,
    ``gram``: hash of the k-gram, ``context``: hash of all bytes of those windows and of
    the distances.
    """
    parts = []
    for first, last in _pieces(offsets, window):
        piece = text[first:last]
        if len(piece) < window:
            continue
        chosen = _chosen(piece, window, k)
        # Texts that meet the piece, and the windows that lie within one of them.
        a, b = np.searchsorted(offsets, first, "right") - 1, np.searchsorted(offsets, first + len(chosen), "left")
        bounds = np.clip(offsets[a : b + 1] - first, 0, len(chosen))
        owner = np.repeat(np.arange(a, b), np.diff(bounds))
        start = np.arange(first, first + len(chosen))
        inside = start <= np.repeat(offsets[a + 1 : b + 1] - window, np.diff(bounds))
        start, chosen, owner = start[inside], chosen[inside] + first, owner[inside]
        if not len(start):
            continue
        fresh = np.r_[True, (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])]
        lo = np.flatnonzero(fresh)
        hi = np.append(lo[1:], len(start)) - 1
        begin, end, at = start[lo], start[hi] + window, chosen[lo]
        gram = word_hashes(piece, at - first, at - first + k)
        context = word_hashes(piece, begin - first, end - first) + (at - begin).astype(np.uint64)
        row = owner[lo]
        parts.append((row, begin - offsets[row], start[hi] - start[lo], at - begin, gram, mixed(context)))
    names = ("row", "lo", "span", "off", "gram", "context")
    if not parts:
        return {n: np.zeros(0, np.uint64 if n in names[4:] else np.int64) for n in names}
    return dict(zip(names, map(np.concatenate, zip(*parts))))


def _pieces(offsets: np.ndarray, window: int):
    """(first byte, end) of pieces; a text may span several, which overlap
    by a window less one byte so that each window falls in one of them."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        last = min(end, at + PIECE)
        yield at, min(end, last + window - 1)
        at = last
