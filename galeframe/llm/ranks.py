"""Byte-pair merging over contiguous rank arrays, for many words at a time.

Each word holds its part boundaries and, beside every part, the rank of the pair it
forms with the next one.  One round scans all words for their smallest rank, deletes the
boundary behind the leftmost pair that has it, and refreshes the ranks of the two
neighbours.  The arrays of all words of a block lie end to end, so a round is a few
passes over contiguous memory; a word leaves them when none of its pairs has a rank.
A word repeated in a block is merged once.
"""

from __future__ import annotations

import heapq
import json
import os

import numpy as np
import regex

# Words over this many bytes are merged one by one, from a heap once they are so long
# that a scan for every merge would be quadratic.
LONG_WORD = 48
# Text handled at a time; blocks end where no token can span.
BLOCK_BYTES = 1 << 20

_NONE = np.int32(2**31 - 1)
_LETTER, _DIGIT, _OTHER, _WHITE = 1, 2, 3, 4
# White space of Unicode (fixed by the vocabularies' splitting rules).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _classes() -> np.ndarray:
    """Class of the characters up to U+00FF."""
    out = np.full(256, _OTHER, np.uint8)
    for c in range(256):
        if chr(c).isalpha():
            out[c] = _LETTER
        elif regex.match(r"\p{N}", chr(c)):
            out[c] = _DIGIT
    out[[*range(9, 14), 32, 0x85, 0xA0]] = _WHITE
    return out


_CLASS = _classes()


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabulary files: printable
    bytes stand for themselves, the others count up from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    for k, b in enumerate(sorted({*range(256)} - {*printable})):
        letters[chr(256 + k)] = b
    return letters


class PairRanks:
    """Rank of a pair of part ids: two hash tables, so a look-up is two gathers."""

    BITS = 19

    def __init__(self, ranks: dict[tuple[int, int], int]):
        self.exact = ranks
        keys = np.array([a << 32 | b for a, b in ranks], np.uint64)
        values = np.fromiter(ranks.values(), np.int32, len(ranks))
        rng = np.random.default_rng(7)
        while True:
            self.factors = rng.integers(1, 2**63, 2, np.uint64) | np.uint64(1)
            self.tables = []
            left = np.arange(len(keys))
            for factor in self.factors:
                slot = self._slot(keys[left], factor)
                _, first = np.unique(slot, return_index=True)
                table_keys = np.full(1 << self.BITS, 2**64 - 1, np.uint64)
                table_values = np.full(1 << self.BITS, _NONE, np.int32)
                table_keys[slot[first]] = keys[left[first]]
                table_values[slot[first]] = values[left[first]]
                self.tables.append((table_keys, table_values))
                left = np.delete(left, first)
            if not len(left):
                break

    def _slot(self, keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((keys * factor) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys, self.factors[0])
        out = np.where(self.tables[0][0][slot] == keys, self.tables[0][1][slot], _NONE)
        miss = np.flatnonzero(out == _NONE)
        slot = self._slot(keys[miss], self.factors[1])
        out[miss] = np.where(self.tables[1][0][slot] == keys[miss], self.tables[1][1][slot], _NONE)
        return out


class Encoder:
    """Ids of texts for a byte-level BPE file of the tokenizers library.

    Understands the two kinds of splitting rule found in such files: the one that keeps
    white space (a word takes the space before it), and the one for lower-cased words
    that drops it and marks the end of each word.  Texts with characters beyond U+00FF
    or with special tokens take the same path word by word, or the library itself where
    the file asks for normalisation.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.lower = spec["normalizer"] is not None
        self.first = np.array([vocab[c] for c in sorted(letters, key=letters.get)], np.int32)
        self.last = np.array([vocab[c + suffix] for c in sorted(letters, key=letters.get)], np.int32)
        ranks, result = {}, []
        for k, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            ranks.setdefault((vocab[left], vocab[right]), k)
            result.append(vocab[left + right])
        self.ranks, self.result = PairRanks(ranks), np.array(result, np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.bytes_of = {
            i: bytes(letters[c] for c in token.removesuffix(suffix) if c in letters) for token, i in vocab.items()
        } | {i: token.encode() for token, i in self.special.items()}
        self.splits = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
        )
        self._path, self._library = path, None

    # One word at a time.

    def merge_one(self, word: bytes) -> list[int]:
        """Ids of one word by the same rule."""
        parts = [*self.first[[*word[:-1]]].tolist(), int(self.last[word[-1]])]
        if len(parts) > 8 * LONG_WORD:
            return self._merge_by_heap(parts)
        get, none = self.ranks.exact.get, int(_NONE)
        ranks = [get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i] = int(self.result[least])
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return parts

    def _merge_by_heap(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.ranks.exact.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or get((parts[i], parts[j])) != rank:
                continue  # one of the two was merged meanwhile
            parts[i], parts[j] = int(self.result[rank]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := get((parts[a], parts[after[a]]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [p for p in parts if p >= 0]

    def encode_one(self, text: str) -> np.ndarray:
        """Ids of a text of any characters."""
        if self.lower:
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self._path)
                self._library.no_truncation()
                self._library.no_padding()
            return np.array(self._library.encode(text, add_special_tokens=False).ids, np.int32)
        ids: list[int] = []
        for part in self.specials.split(text):
            if part in self.special:
                ids.append(self.special[part])
            else:
                for word in self.splits.findall(part):
                    ids += self.merge_one(word.encode())
        return np.array(ids, np.int32)

    # Many words at a time.

    def merge_many(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and how many each has."""
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(starts)), lengths)
        byte = text[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]
        parts = self.first[byte]
        parts[ends - 1] = self.last[byte[ends - 1]]
        rank = np.full(len(parts), _NONE, np.int32)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.ranks.look_up(parts[inner], parts[inner + 1])
        words, counts = np.arange(len(starts)), lengths.copy()
        done_words, done_counts, done_parts = [], [], []
        while len(words):
            begin = np.cumsum(counts) - counts
            least = np.minimum.reduceat(rank, begin)
            open_ = least < _NONE
            if not open_.all():
                part_open = np.repeat(open_, counts)
                done_words.append(words[~open_])
                done_counts.append(counts[~open_])
                done_parts.append(parts[~part_open])
                words, counts, least = words[open_], counts[open_], least[open_]
                parts, rank = parts[part_open], rank[part_open]
                if not len(words):
                    break
                begin = np.cumsum(counts) - counts
            at = np.flatnonzero(rank == np.repeat(least, counts))
            word_of = np.searchsorted(begin, at, "right")
            at = at[np.r_[True, word_of[1:] != word_of[:-1]]]  # the leftmost of each word
            parts[at] = self.result[least]
            keep = np.ones(len(parts), bool)
            keep[at + 1] = False
            last_pair = at + 2 >= begin + counts
            parts, kept_rank = parts[keep], rank[keep]
            counts = counts - 1
            here = at - np.arange(len(at))
            kept_rank[here] = _NONE
            more = here[~last_pair]
            kept_rank[more] = self.ranks.look_up(parts[more], parts[more + 1])
            begin = np.cumsum(counts) - counts
            prior = here[here > begin]
            kept_rank[prior - 1] = self.ranks.look_up(parts[prior - 1], parts[prior])
            rank = kept_rank
        words = np.concatenate(done_words)
        counts = np.concatenate(done_counts)
        flat = np.concatenate(done_parts)
        order = np.argsort(words)
        offsets = (np.cumsum(counts) - counts)[order]
        counts = counts[order]
        return flat[ragged(offsets, counts)], counts

    def _words(self, text: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of plain UTF-8; ``heads``: where texts begin."""
        n = len(text)
        lead = (text & 0xC0) != 0x80
        kind = _CLASS[text]
        wide = np.flatnonzero(text >= 0xC2)
        kind[wide] = kind[wide + 1] = _CLASS[(text[wide] & 3) << 6 | text[wide + 1] & 0x3F]
        head = np.zeros(n, bool)
        head[heads] = True
        start = np.empty(n, bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= head
        white = kind == _WHITE
        # A run of white space gives its last character to what follows.
        after = np.flatnonzero(start & ~white)
        after = after[after > 0]
        after = after[white[after - 1] & ~head[after]]
        wide_space = ~lead[after - 1]
        before = after - 1 - wide_space
        start[before] = True
        if self.lower:
            start |= (kind == _DIGIT) & lead
        else:
            glued = text[after - 1] == 32
            start[after[glued]] = False
        quote = np.flatnonzero((text == 39) & start)
        if len(quote):
            pad = np.r_[text, np.zeros(3, np.uint8)]
            limit = np.append(np.flatnonzero(head), n)
            limit = limit[np.searchsorted(limit, quote, "right")]
            a, b = pad[quote + 1], pad[quote + 2]
            one = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & (quote + 1 < limit)
            pairs = (a.astype(np.int32) << 8) | b
            two = np.isin(pairs, [0x7265, 0x7665, 0x6C6C]) & (quote + 2 < limit)
            size = np.where(one, 2, np.where(two, 3, 0))
            hit = size > 0
            quote, size = quote[hit], size[hit]
            start[quote + 1] = False
            stop = quote + size
            inside = stop[stop < n]
            start[inside] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], n)
        if self.lower:
            word = ~white[begin]
            begin, end = begin[word], end[word]
        return begin, end

    def _plain(self, text: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a block, and of each word its start and how many ids it has."""
        if self.lower:
            text = text.copy()
            upper = (text >= 65) & (text <= 90)
            wide = np.flatnonzero((text[1:] >= 0x80) & (text[1:] <= 0x9E) & (text[1:] != 0x97) & (text[:-1] == 0xC3)) + 1
            text[upper] += 32
            text[wide] += 32
        begin, end = self._words(text, heads)
        if not len(begin):
            return np.zeros(0, np.int32), begin, begin
        lengths = end - begin
        key = word_hashes(text, begin, end)
        order = np.argsort(key)
        fresh = np.append(True, key[order[1:]] != key[order[:-1]])
        first = order[fresh]
        inverse = np.empty(len(key), np.int64)
        inverse[order] = np.cumsum(fresh) - 1
        # Equal hashes must be equal words.
        other = first[inverse]
        same = lengths == lengths[other]
        spot = np.flatnonzero(same & (other != np.arange(len(other))))
        flat = ragged(begin[spot], lengths[spot])
        differs = text[flat] != text[ragged(begin[other[spot]], lengths[spot])]
        if differs.any():
            same[spot[np.searchsorted(np.cumsum(lengths[spot]), np.flatnonzero(differs), "right")]] = False
        if not same.all():
            extra = np.flatnonzero(~same)
            inverse[extra] = len(first) + np.arange(len(extra))
            first = np.append(first, extra)
        size = lengths[first]
        short = np.flatnonzero(size <= LONG_WORD)
        counts = np.zeros(len(first), np.int64)
        ids, counts[short] = self.merge_many(text, begin[first[short]], size[short]) if len(short) else (np.zeros(0, np.int32), 0)
        at = np.zeros(len(first), np.int64)
        at[short] = np.cumsum(counts[short]) - counts[short]
        for k in np.flatnonzero(size > LONG_WORD):
            merged = np.array(self.merge_one(text[begin[first[k]] : end[first[k]]].tobytes()), np.int32)
            at[k], counts[k] = len(ids), len(merged)
            ids = np.append(ids, merged)
        counts_of = counts[inverse]
        return ids[ragged(at[inverse], counts_of)], begin, counts_of

    def encode(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the UTF-8 texts between ``offsets``, end to end, and how many each has."""
        rows = len(offsets) - 1
        odd = np.zeros(rows, bool)
        strange = np.flatnonzero(text >= 0xC4)
        mark = np.flatnonzero((text[:-1] == 60) & (text[1:] == 124)) if len(text) else strange
        odd[np.searchsorted(offsets, np.append(strange, mark), "right") - 1] = True
        counts = np.zeros(rows, np.int64)
        pieces: list[tuple[int, np.ndarray]] = []
        for i in np.flatnonzero(odd):
            ids = self.encode_one(text[offsets[i] : offsets[i + 1]].tobytes().decode())
            counts[i] = len(ids)
            pieces.append((int(i), ids))
        if odd.any():
            row = np.repeat(np.arange(rows), np.diff(offsets))
            plain = text[~odd[row]]
            sizes = np.where(odd, 0, np.diff(offsets))
            bounds = np.append(0, np.cumsum(sizes))
        else:
            plain, bounds = text, offsets
        found = []
        heads = bounds[:-1][np.diff(bounds) > 0]
        for a, b in blocks(plain, heads):
            inner = heads[np.searchsorted(heads, a) : np.searchsorted(heads, b)] - a
            ids, begin, sizes = self._plain(plain[a:b], inner)
            owner = np.searchsorted(bounds, begin + a, "right") - 1
            counts += np.bincount(owner, sizes, rows).astype(np.int64)
            found.append(ids)
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        if pieces:
            sizes = np.where(odd, 0, counts)
            ends = np.cumsum(sizes)
            by_row = dict(pieces)
            flat = np.concatenate([by_row[i] if odd[i] else flat[ends[i] - sizes[i] : ends[i]] for i in range(rows)])
        return flat.astype("<u4"), counts

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every piece, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_powers = {False: np.ones(1, np.uint64), True: np.ones(1, np.uint64)}


def powers(n: int, back: bool = False) -> np.ndarray:
    """_FACTOR ** k modulo 2**64 for k below n, or ** -k."""
    if len(_powers[back]) < n:
        full = np.full(n, pow(int(_FACTOR), -1 if back else 1, 2**64), np.uint64)
        full[0] = 1
        _powers[back] = np.cumprod(full, dtype=np.uint64)
    return _powers[back][:n]


def word_hashes(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece, the same wherever it stands."""
    sums = np.empty(len(text) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(len(text)), out=sums[1:])
    key = (sums[end] - sums[begin]) * powers(len(text) + 1, back=True)[begin]
    return mixed(key + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def mixed(key: np.ndarray) -> np.ndarray:
    """All bits of a 64-bit number spread over all of them."""
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return key ^ (key >> np.uint64(32))


def blocks(text: np.ndarray, heads: np.ndarray):
    """Pieces of about BLOCK_BYTES, cut where a text begins or white space follows a word."""
    a, n = 0, len(text)
    while a < n:
        b = a + BLOCK_BYTES
        while b < n:
            near = text[b - 1 : b + BLOCK_BYTES]
            cut = np.flatnonzero(((near[1:] == 32) | (near[1:] == 10)) & (near[:-1] > 32) & (near[:-1] < 127))
            k = np.searchsorted(heads, b)
            options = [b + int(cut[0])] if len(cut) else []
            options += [int(heads[k])] if k < len(heads) else []
            if options:
                b = min(options)
                break
            b += BLOCK_BYTES
        yield a, min(b, n)
        a = min(b, n)


_open: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def vocabulary(name: str) -> str:
    """Where the public vocabulary ``name`` lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
