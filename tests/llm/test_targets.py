"""Decontamination, importance resampling and token alignment against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from galeframe.llm import alignment, decontaminate, importance
from galeframe.llm.ranks import vocabulary
from tests.llm.conftest import frame

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FILES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def word_list(text):
    return PLAIN.findall(lower(text))


@pytest.fixture(scope="session")
def items(texts):
    """Items cut from the texts, short ones, ones of other words, nulls and repeats."""
    long = max((t for t in texts if t), key=len).split(" ")
    out = [(1, " ".join(long[40:70]).upper()), (2, "; ".join(long[60:75])), (10, " ".join(long[3:9])), (3, None), (4, ""), (5, "Two words"), (6, "É ÜÑ")]
    out += [(7, "none of these words stands anywhere in any text at all zzz"), (1, " ".join(long[40:70])), (None, " ".join(long[100:112])), (8, "é ü ñ 中文 😀")]
    return out + [(9, " ".join(long[3:9]))]


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def leaks(rows, items):
    windows = {}
    for item, text in items:
        words = word_list(text)
        n = min(10, len(words))
        for k in range(len(words) - n + 1 if words else 0):
            windows.setdefault(tuple(words[k : k + n]), set()).add(item)
    out = []
    for i, text in rows:
        words, hit, named = word_list(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if (found := windows.get(tuple(words[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    named |= found
        names = sorted(str(x) for x in named if x is not None)
        out.append((i, len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("at_once", [500_000, 30])
def test_decontamination(spark, docs, texts, items, rows, at_once):
    given = [(3 * k, t) for k, t in enumerate(texts)]
    got = decontaminate.digests(docs, bench(spark, items), at_once=at_once)
    want = leaks(given, items)
    assert rows(got) == want
    assert sum(r[5] for r in want) >= 3 and len({r[3] for r in want}) > 2


def test_decontamination_edges(spark, texts, items, rows, none):
    long = max((t for t in texts if t), key=len)
    odd = [(None, long), (5, long), (5, long), (5, "Two words, and more"), (5, None), (None, None)]
    table = frame(spark, [(i, t, "en") for i, t in odd])
    some = bench(spark, items)
    assert rows(decontaminate.digests(table, some)) == leaks(odd, items)
    assert rows(decontaminate.digests(table, bench(spark, []))) == leaks(odd, [])
    assert rows(decontaminate.digests(table, bench(spark, [(1, None), (2, " ")]))) == leaks(odd, [])
    assert decontaminate.digests(none, some).count() == 0
    assert decontaminate.cleaned(none, some).count() == 0


def test_removal(spark, texts, items):
    rows = [(1, "Start, a b c. Two words -- then more"), (2, "clean text here"), (3, None), (None, "two words"), (2, "two  WORDS two words!")]
    table = frame(spark, [(i, t, "en") for i, t in rows]).withColumnRenamed("c0", "a.b")
    some = bench(spark, [(5, "Two words"), (6, "b c two words then")])
    cut = decontaminate.cleaned(table, some)
    assert cut.columns == table.columns
    assert sorted((r.doc_id, r.text) for r in cut.collect() if r.doc_id) == [(1, "Start, a more"), (2, ""), (2, "clean text here"), (3, None)] or sorted(
        ((r.doc_id, r.text) for r in cut.collect() if r.doc_id), key=repr
    ) == [(1, "Start, a more"), (2, ""), (2, "clean text here"), (3, None)]
    whole = decontaminate.cleaned(table, some, remove="documents")
    assert whole.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in whole.collect()), key=repr) == [(2, "clean text here"), (3, None)]
    # What is left has no hit where nothing new came together.
    again = decontaminate.digests(cut.where("doc_id = 1"), some).collect()
    assert [r.contaminated for r in again] == [False]
    assert decontaminate.cleaned(table, bench(spark, [])).count() == len(rows)


def chosen(rows, items, percent=25):
    def feats(text):
        words = word_list(text)
        return words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    corpus, target = Counter(), Counter()
    for counter, texts in ((corpus, rows), (target, items)):
        for _, text in texts:
            counter.update(map(bucket, feats(text)))
    s_all, t_all = sum(corpus.values()), sum(target.values())
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (s_all + 10_000) / ((corpus[b] + 1) * (t_all + 10_000))))
    scored = []
    for i, text in rows:
        own = feats(text)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((i, len(own), weight, score, len(word_list(text)) >= 20 and i is not None))
    able = sorted((-r[3], r[0], k) for k, r in enumerate(scored) if r[4])
    place = {k: n + 1 for n, (_, _, k) in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], place.get(k)) for k, r in enumerate(scored)), key=repr)


def test_importance(spark, docs, texts, items, rows, none):
    given = [(3 * k, t) for k, t in enumerate(texts)]
    want = chosen(given, items)
    assert rows(importance.resampled(docs, bench(spark, items))) == want
    assert sum(r[4] is not None for r in want) > 10
    assert rows(importance.resampled(docs, bench(spark, []))) == chosen(given, [])
    assert importance.resampled(none, bench(spark, items)).count() == 0


def test_importance_edges(spark, texts, items, rows):
    long = [t for t in texts if t and len(word_list(t)) >= 20]
    odd = [(None, long[0]), (1, None), (2, ""), (3, long[1]), (3, long[1]), (4, "x" * 100_000), (5, long[2] * 40), (6, "é ü Ñ É 中文"), (7, long[3]), (8, long[4])]
    table = frame(spark, [(i, t, "en") for i, t in odd])
    assert rows(importance.resampled(table, bench(spark, items), percent=60)) == chosen(odd, items, 60)
    kept = importance.drawn(table, bench(spark, items), percent=60)
    assert kept.columns == table.columns and 0 < kept.count() <= 4


def test_features_of_a_block_do_not_cross_texts():
    alone = [importance.features([t]) for t in (b"Aa bb", b"", b"cc", b"\xc3\xa9 9")]
    own, n, words = importance.features([b"Aa bb", b"", b"cc", b"\xc3\xa9 9"])
    assert n.tolist() == [3, 0, 1, 3] and words.tolist() == [2, 0, 1, 2]
    assert sorted(own.tolist()) == sorted(np.concatenate([a[0] for a in alone]).tolist())
    assert zlib.crc32(b"aa bb") % importance.BUCKETS in own


def aligned_plainly(rows):
    """By lists of byte ranges, one text after the other."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(FILES[0])
    library.encode_special_tokens = True  # their strings are plain text
    pair = alignment.tokenizers(*FILES)
    table = [[bytes(t.data[a : a + n]) for a, n in zip(t.starts.tolist(), t.lengths.tolist())] for t in (pair.a, pair.b)]
    found = []
    for i, text in rows:
        both = []
        if text:
            raw = b" " + text.encode()
            ids = [library.encode(" " + text, add_special_tokens=False).ids, pair._b.encode(text)]
            if all(b"".join(t[k] for k in own) == raw for t, own in zip(table, ids)):
                for t, own in zip(table, ids):
                    spans, at = [], 0
                    for k in own:
                        spans.append((at, at + len(t[k]), k))
                        at += len(t[k])
                    both.append(spans)
        groups, linked = [], []
        if both:
            cuts = sorted({e for _, e, _ in both[0]} & {e for _, e, _ in both[1]})
            for lo, hi in zip([0, *cuts], cuts):
                a, b = ([x for x in side if lo < x[1] <= hi] for side in both)
                groups.append(",".join(str(x[2]) for x in a) + "|" + ",".join(str(x[2]) for x in b))
                linked += [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        found.append((i, *(len(s) for s in both or [[], []]), groups, linked))
    held = Counter(p for r in found for p in set(r[4]))
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    return sorted(
        (
            (i, a, b, len(g), len(k), sum(held[p] == best[p[0]] for p in k), sum(held[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for i, a, b, g, k in found
        ),
        key=repr,
    )


@pytest.mark.parametrize("at_once, chunk_bytes", [(4_000_000, 1 << 16), (0, 1 << 16), (4_000_000, 61)])
def test_alignment(docs, texts, rows, at_once, chunk_bytes):
    got = alignment.digests(docs, *FILES, at_once=at_once, chunk_bytes=chunk_bytes)
    assert rows(got) == aligned_plainly([(3 * k, t) for k, t in enumerate(texts)])


def test_alignment_edges(spark, rows, none):
    odd = [(None, "some text"), (1, None), (1, "<|endoftext|></s><unk> plain"), (1, "plain"), (2, "plain"), (2, "plain"), (3, "▁ odd"), (4, "  two  spaces \n\n lines\t"), (5, "é😀中文" * 50), (6, "\x00\x01")]
    table = frame(spark, [(i, t, "en") for i, t in odd])
    want = aligned_plainly(odd)
    assert rows(alignment.digests(table, *FILES)) == want
    assert rows(alignment.digests(table, *FILES, chunk_bytes=3)) == want
    assert any(r[1] == 0 and r[0] == 3 for r in want)
    assert alignment.digests(none, *FILES).count() == 0
    listing = alignment.aligned(table, *FILES, with_groups=True).where("doc_id = 3 OR doc_id = 2").collect()
    assert all((r.groups == "") == (r.n_a == 0) and r.groups.count("|") == r.n_groups for r in listing)


def test_fragments_compose_in_any_order(texts):
    pair, rng = alignment.tokenizers(*FILES), random.Random(5)
    text = max((t for t in texts if t), key=len)[:4000] + " é😀中文" * 20
    a, b = ((ids, t) for ids, t in zip((pair.encode([text])[0], pair.encode([text])[2]), (pair.a, pair.b)))
    a, b = (np.stack([ids, np.cumsum(t.lengths[ids])], 1) for ids, t in (a, b))
    whole = alignment.compose(pair, alignment.START, alignment.fragment(pair, a, b))
    for _ in range(6):
        edges = [0, *sorted(rng.sample(range(1, int(a[-1, 1])), 900)), int(a[-1, 1])]
        parts = [alignment.fragment(pair, *(x[(x[:, 1] > lo) & (x[:, 1] <= hi)] for x in (a, b))) for lo, hi in zip(edges, edges[1:])]
        assert any(not p.cut for p in parts)
        while len(parts) > 1:  # neighbours in random order
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [alignment.compose(pair, parts[k], parts[k + 1])]
        got = alignment.compose(pair, alignment.START, alignment.compose(pair, parts[0], alignment.Fragment()))
        assert (got.text, got.n_groups, got.n_a, got.n_b) == (whole.text, whole.n_groups, len(a), len(b))
        assert np.array_equal(got.keys, whole.keys) and np.array_equal(got.counts, whole.counts)
        assert not len(got.tail_a) and not len(got.head_a)
