"""Token ids against the tokenizers library; files and packing against their definition."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from galeframe.llm import bpe, packing, ranks, repair
from galeframe.llm.ranks import Encoder, vocabulary
from galeframe.session import scratch_dir

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def library(path):
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("block", [64, 1 << 20])
def test_ids_are_the_librarys(monkeypatch, texts, path, block):
    monkeypatch.setattr(ranks, "BLOCK_BYTES", block)
    rng = random.Random(2)
    odd = [t or "" for t in texts]
    for letters in (" \n\t\x1c\x85\xa0 abAÉ1²,.'<|😀中éΣ", " \n'stm're ll'd.1a", " \xa0\x85\n'sé×ÉÞ1²!a", "aabbé "):
        odd += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    odd.append("".join(rng.choice("abcé") for _ in range(3000)))
    raw = [t.encode() for t in odd]
    offsets = np.append(0, np.cumsum([len(r) for r in raw]))
    ids, counts = Encoder(path).encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    ends = np.cumsum(counts)
    lib = library(path)
    for text, a, b in zip(odd, ends - counts, ends):
        assert ids[a:b].tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_round_trip(spark, docs, none, texts):
    lib = library(BYTE)
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, BYTE).collect()}
    import hashlib

    for k, text in enumerate(texts):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        row = got[3 * k]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {3 * k: t or "" for k, t in enumerate(texts)}
    assert bpe.round_trip(none, BYTE).count() == 0


def test_files_of_ids(spark, docs, none, texts, monkeypatch):
    lib = library(WORD)
    path = scratch_dir(spark, "ids")
    repair.write_ids(docs, path, WORD, end_id=1)
    got = {r["doc_id"]: r for r in repair.read_ids(spark, path, digest=True).collect()}
    whole = {r["doc_id"]: r["ids"] for r in repair.read_ids(spark, path).collect()}
    start = 0
    for k, text in enumerate(texts):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        row = got[3 * k]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), crc(ids))
        assert whole[3 * k] == ids
        start += len(ids)
    path = scratch_dir(spark, "ids")
    repair.write_ids(none, path, WORD, end_id=1)
    assert repair.read_ids(spark, path).count() == 0


@pytest.mark.parametrize("least", [2, 24])
def test_grammar_round_trip(monkeypatch, least):
    monkeypatch.setattr(repair, "LEAST_COUNT", least)
    rng = np.random.default_rng(1)
    for size, symbols in ((0, 5), (1, 5), (5000, 3), (20000, 40), (3000, 1)):
        ids = rng.integers(0, symbols, size).astype(np.uint32)
        counts = np.bincount(np.sort(rng.integers(0, 60, size)), minlength=60)
        row = repair._row(0, 0, np.arange(60), ids, counts, symbols)
        block = repair.Block(row)
        assert block.all().tolist() == ids.tolist()
        ends = np.cumsum(counts)
        assert all(block.doc(k).tolist() == ids[ends[k] - counts[k] : ends[k]].tolist() for k in range(60))
        if size > 1000:
            assert len(block.symbols) < size


def best_fit(lengths, capacity):
    rooms = []
    for n in lengths:
        fitting = [r for r in rooms if r >= n]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_packing(spark, docs, none, texts):
    lib = library(WORD)
    rows = packing.pack(docs, WORD, capacity=512).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == {3 * k for k in range(len(texts))}
    for k, text in enumerate(texts):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted(by_doc[3 * k], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(-(-len(ids) // 512)))
        for r in mine:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == 512 * r["piece"] and crc(part) == r["ids_crc32"] and len(part) == r["length"]
        assert sum(r["length"] for r in mine) == len(ids)
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 512
    lengths = sorted((r["length"] for r in rows), reverse=True)
    assert len(by_sequence) <= best_fit(lengths, 512)
    assert packing.pack(none, WORD).count() == 0


def test_plan_holds_every_piece_once():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 2049, 3000), rng.integers(1, 30, 500), np.full(40, 2048), np.full(7, 1000), rng.integers(1100, 2000, 99)):
        counts = Counter(lengths.tolist())
        found = Counter()
        for held, times in packing.plan(counts, 2048):
            assert sum(held) <= 2048
            for n in held:
                found[n] += times
        assert found == counts
        bins = sum(t for _, t in packing.plan(counts, 2048))
        bound = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
        assert bins <= 1.03 * bound + 2
    assert packing.plan({}, 2048) == []


def test_linear_program_places_the_pieces():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 2049, 3000), np.minimum(rng.lognormal(6.2, 1.0, 5000).astype(int) + 1, 2048), rng.integers(200, 900, 2000)):
        counts = Counter(lengths.tolist())
        placed = Counter()
        for held, share in packing.configurations(counts, 2048):
            assert sum(held) <= 2048 and share >= 1
            for n in held:
                placed[n] += share
        assert all(placed[n] <= c for n, c in counts.items())
        assert placed.total() >= 0.9 * len(lengths)
        assert sum(n * (c - placed[n]) for n, c in counts.items()) <= 2048
        bins = sum(t for _, t in packing.plan(counts, 2048))
        assert bins <= best_fit(sorted(lengths.tolist(), reverse=True), 2048)


@pytest.mark.parametrize("seed", range(6))
def test_few_pieces_take_no_more_sequences_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(20, 300))
    for lengths in (rng.integers(1, 513, n), rng.choice([1, 12, 33, 41, 170, 171, 227, 300, 512], n)):
        bins = sum(t for _, t in packing.plan(Counter(lengths.tolist()), 512))
        assert bins <= best_fit(sorted(lengths.tolist(), reverse=True), 512)


def test_rounds_of_a_large_histogram():
    rng = np.random.default_rng(2)
    counts = {int(n): int(c) for n, c in zip(rng.permutation(2048)[:300] + 1, rng.integers(1, 10**9, 300))}
    packed = packing.plan(counts, 2048)
    assert sum(len(held) * t for held, t in packed) == sum(counts.values())
    best = sum(t for _, t in packing._completed(counts, [], 2048))
    assert sum(t for _, t in packed) <= 1.0001 * best
