"""Near copies and repeated strings against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from galeframe.llm import induced, jaccard, suffix_dedup
from galeframe.llm.components import components
from tests.llm.conftest import frame, sentence

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def plain_groups(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    least = {i: i for i in ids}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def got_groups(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(df).collect()}


def test_groups(docs, none, texts):
    assert got_groups(docs) == plain_groups([(3 * k, t) for k, t in enumerate(texts)])
    assert jaccard.groups(none).count() == 0


def test_groups_of_short_and_edited_texts(spark):
    rng = random.Random(8)
    rows = []
    for size in (5, 6, 7, 8, 10, 12, 16, 22, 29, 30, 33, 40, 55):
        base = sentence(rng, size).split(" ")
        for _ in range(9):
            words = list(base)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([[], ["new%d" % rng.randrange(9)], [words[k], "more"]])
            rows.append((len(rows), " ".join(words), "en"))
    rows += [(len(rows) + k, rows[k][1], "en") for k in range(0, 40, 3)]
    assert got_groups(frame(spark, rows).repartition(3)) == plain_groups([r[:2] for r in rows])


def test_every_linked_pair_shares_a_key():
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = x[rng.random(len(x)) > rng.choice([0.05, 0.12, 0.2])]
        y = np.unique(np.append(keep, rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 6) + 1))).astype(np.uint64)))
        shared = len(np.intersect1d(x, y))
        if len(x) == len(y) == shared or not len(y) or 100 * shared < 75 * (len(x) + len(y) - shared):
            continue
        row, key, role = jaccard.keys(np.concatenate([x, y]), np.array([len(x), len(y)]), np.sort(rng.choice(x, min(5, len(x)))))
        held = [{(k, r) for k, r in zip(key[row == i].tolist(), role[row == i].tolist())} for i in (0, 1)]
        assert {k for k, _ in held[0]} & {k for k, _ in held[1]}
        looks = [{k for k, r in h if r & 2} & {k for k, r in o if r & 1} for h, o in (held, held[::-1])]
        assert looks[0] or looks[1]


def test_one_of_each(spark, docs, texts):
    expected = sorted({c for _, c in plain_groups([(3 * k, t) for k, t in enumerate(texts)]).values()})
    stay = jaccard.one_of_each(docs)
    assert stay.columns == docs.columns
    assert sorted(r[0] for r in stay.select("doc_id").collect()) == expected
    twice = frame(spark, [(1, "a b c d e f", "en"), (1, "a b c d e f", "en"), (None, "x y", "en"), (None, None, "en")])
    assert sorted((r[0] or -1) for r in jaccard.one_of_each(twice).select("doc_id").collect()) == [-1, -1, 1]


def test_several_texts_of_one_id(spark):
    """Each text of an id links what it is near to; none is lost, and no row goes but a near copy."""
    rng = random.Random(4)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    rows = [(7, a, "en"), (7, b, "en"), (9, a + " end", "en"), (11, b + " end", "en"), (13, c, "en"), (15, c, "en"), (15, None, "en"), (15, " ", "en")]
    got = sorted(tuple(r) for r in jaccard.groups(frame(spark, rows).repartition(3)).collect())
    sizes = {i: len(shingle_set(t)) for i, t in (("a", a), ("b", b), ("c", c))}
    want = [(7, sizes["a"], 7), (7, sizes["b"], 7), (9, sizes["a"] + 1, 7), (11, sizes["b"] + 1, 7), (13, sizes["c"], 13), (15, sizes["c"], 13), (15, 0, 15), (15, 0, 15)]
    assert got == sorted(want)
    stay = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(frame(spark, rows).repartition(3)).collect()), key=repr)
    assert stay == sorted([(7, a), (7, b), (13, c), (15, None), (15, " ")], key=repr)


def test_keys_of_a_text_do_not_grow_with_the_buckets():
    rng = np.random.default_rng(2)
    held = [(rng.integers(0, 2**62, 300), rng.integers(0, 2**63, 300).astype(np.uint64), np.full(300, 3)) for _ in range(4)]
    for buckets in (6, 211, 10_000):
        out = jaccard._packed(held, buckets)
        assert sum(len(v) for c in (1, 2) for v in out.column(c).to_pylist()) <= 16 * 1200
        pairs = set()
        for names, packed in zip(out.column(1).to_pylist(), out.column(2).to_pylist()):
            names, packed = np.frombuffer(names, "<i8"), np.frombuffer(packed, "<u8")
            pairs |= set(zip(names[(packed >> np.uint64(2)).astype(int) & 0x3FFF].tolist(), (packed >> np.uint64(16)).tolist()))
        assert pairs == {(int(r), int(k) & (1 << 48) - 1) for rep, key, _ in held for r, k in zip(rep, key)}


def test_components(spark):
    edges = [(5, 4), (4, 9), (9, 1), (20, 21), (22, 21), (7, 7), *[(100 + k, 101 + k) for k in range(30)]]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {5: 1, 4: 1, 9: 1, 21: 20, 22: 20, **{101 + k: 100 for k in range(30)}}


def plain_removal(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("length", "gram", "hot", "memory"), [(200, 64, 1 << 16, 1 << 21), (60, 20, 3, 50), (24, 24, 1 << 16, 50)])
def test_repeated_strings(spark, docs, none, texts, length, gram, hot, memory):
    rows = [(3 * k, t) for k, t in enumerate(texts)]
    got = suffix_dedup.digests(docs, length, gram=gram, hot=hot, memory=memory).collect()
    assert sorted(tuple(r) for r in got) == plain_removal(rows, length)
    assert suffix_dedup.digests(none, length).count() == 0


def test_repeated_rows_remove_each_other(spark):
    rng = random.Random(4)
    long = sentence(rng, 90)
    rows = [(1, long, "en"), (1, long, "en"), (1, sentence(rng, 80), "en"), (2, None, "en"), (3, "short", "en")]
    got = sorted(tuple(r) for r in suffix_dedup.digests(frame(spark, rows)).collect())
    assert got == plain_removal([r[:2] for r in rows], 200)
    cleaned = suffix_dedup.cleaned(frame(spark, rows))
    assert sorted(((r["doc_id"], r["text"]) for r in cleaned.collect()), key=repr) == sorted([(1, ""), (1, ""), (1, rows[2][1]), (2, None), (3, "short")], key=repr)
    assert cleaned.columns == frame(spark, rows).columns


def test_shards_grow_with_the_contexts(spark, monkeypatch):
    """More bytes give more shards, not larger ones, and the same marks."""
    rng = random.Random(3)
    rows = []
    for k in range(300):
        text = bytearray(rng.randrange(97, 123) for _ in range(60))
        rows += [(k, 2 * k, 1, 20, text), (k, 2 * k + 1, 1, 20, bytearray(b"!" + text[1:]))]
    contexts = spark.createDataFrame(rows, "gram long, context long, n long, span long, bytes binary")
    few = suffix_dedup._sorted_marks(contexts, 40, 1 << 21)
    monkeypatch.setattr(suffix_dedup, "SHARD", 1000, raising=False)
    many = suffix_dedup._sorted_marks(contexts, 40, 1 << 21)
    assert many.rdd.getNumPartitions() == -(-600 * 61 // 1000) > few.rdd.getNumPartitions()
    marks = [{(r["gram"], r["context"]): bytes(r["spans"]) for r in one.collect()} for one in (few, many)]
    assert marks[0] == marks[1] and len(marks[0]) == 600


def test_suffix_order_and_repeats(monkeypatch, tmp_path):
    rng = random.Random(5)
    for _ in range(60):
        n, letters = rng.randint(1, 300), rng.choice([1, 2, 3, 8, 250])
        text = np.array([rng.randrange(letters) for _ in range(n)], np.uint8)
        if rng.random() < 0.4:
            text = np.tile(text[: rng.randint(1, 30)], n)[:n]
        monkeypatch.setattr(induced, "RANGE", rng.choice([1, 8, 4096]))
        monkeypatch.setattr(induced, "IN_MEMORY", rng.choice([4, 40, 1 << 21]))
        monkeypatch.setattr(induced, "PIECE", rng.choice([5, 64, 1 << 18]))
        memory = rng.choice([7, 1 << 20])
        _, names = np.unique(text, return_inverse=True)
        order = induced.suffix_order(names.astype(np.int64) + 300, 300 + int(names.max()) + 1, str(tmp_path), memory)
        assert order.tolist() == sorted(range(n), key=lambda i: text[i:].tolist())
        length = rng.choice([1, 3, 10, 40])
        data = text.tobytes()
        count = Counter(data[i : i + length] for i in range(n - length + 1))
        expected = [i for i in range(n - length + 1) if count[data[i : i + length]] > 1]
        got = {int(i) for part in induced.repeats(text, length, str(tmp_path), memory) for i in part}
        assert sorted(i for i in got if i <= n - length) == expected
