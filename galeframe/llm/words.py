"""Words of many texts at once, as spans of their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from galeframe.llm.ranks import powers, ragged, word_hashes

BLOCK_BYTES = 1 << 20


def lowered(text: np.ndarray) -> np.ndarray:
    """A copy with the capitals of ASCII and Latin-1 made small."""
    out = text.copy()
    out[(text >= 65) & (text <= 90)] += 32
    if len(text) > 1:
        wide = np.flatnonzero((text[1:] >= 0x80) & (text[1:] <= 0x9E) & (text[1:] != 0x97) & (text[:-1] == 0xC3)) + 1
        out[wide] += 32
    return out


def letter_words(text: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of ASCII letters and bytes beyond ASCII; none spans two
    texts (``heads``: where texts begin)."""
    letter = ((text >= 97) & (text <= 122)) | ((text >= 65) & (text <= 90)) | (text >= 128)
    return _runs(letter, heads)


def _runs(inside: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[heads] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def distinct(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one word of each kind, and the kind of every word (by 64-bit hash)."""
    key = word_hashes(text, begin, end)
    order = np.argsort(key)
    fresh = np.append(True, key[order[1:]] != key[order[:-1]])[: len(order)]
    kind = np.empty(len(key), np.int64)
    kind[order] = np.cumsum(fresh) - 1
    return order[fresh], kind


def doc_blocks(offsets: np.ndarray, size: int = BLOCK_BYTES):
    """(first, last) rows of blocks of about ``size`` bytes; a longer text is one block."""
    a, rows = 0, len(offsets) - 1
    while a < rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, rows)
        a = min(b, rows)


__all__ = ["distinct", "doc_blocks", "letter_words", "lowered", "powers", "ragged", "word_hashes"]
