"""Media columns: what bytes really are, and what is embedded in them.

One Aho-Corasick automaton finds the magic bytes of all known formats in a pass.  Magic
bytes occur by chance, so a validator of the format walks its structure (chunks, blocks,
boxes, checksums) and gives the exact length, or rejects the spot.  A match at the start
of the column is its type, whatever was declared; matches further in are embedded media
that can be carved out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.support import kept, mapped

UNKNOWN = "application/octet-stream"
SAMPLE_RATE = 8000


# Validators: length of the medium at ``at``, or 0.


def _png(b: bytes, at: int) -> int:
    p = at + 8
    while p + 12 <= len(b):
        size = int.from_bytes(b[p : p + 4], "big")
        end = p + 12 + size
        if end > len(b) or zlib.crc32(b[p + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return 0
        if b[p + 4 : p + 8] == b"IEND":
            return end - at
        p = end
    return 0


def _gif(b: bytes, at: int) -> int:
    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            local = b[p + 9]
            p = blocks(p + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind in (0x00, 0xFF) or 0xD0 <= kind <= 0xD8:
            return 0
        size = int.from_bytes(b[p + 2 : p + 4], "big")
        if size < 2:
            return 0
        p += 2 + size
        if kind != 0xDA:
            continue
        while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b):  # the coded picture
            if b[p + 1] == 0xD9:
                return p + 2 - at
            if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                p += 2
            else:
                break
        if p < 0:
            return 0
    return 0


def _bmp(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    size, zero, data, header = struct.unpack_from("<IIII", b, at + 2)
    width, height, planes, depth = struct.unpack_from("<iiHH", b, at + 18)
    sound = zero == 0 and header in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32)
    return size if sound and width > 0 and height and 14 + header <= data <= size <= len(b) - at else 0


def _riff(b: bytes, at: int) -> int:
    if at + 12 > len(b):
        return 0
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b) or b[at + 8 : at + 12] not in (b"WAVE", b"WEBP", b"AVI "):
        return 0
    p = at + 12
    while p + 8 <= end:
        size = int.from_bytes(b[p + 4 : p + 8], "little")
        p += 8 + size + size % 2
    return end - at if p == end and end > at + 12 else 0


def _ogg(b: bytes, at: int) -> int:
    p = at
    while b[p : p + 5] == b"OggS\0" and p + 27 <= len(b):
        count = b[p + 26]
        size = 27 + count + sum(b[p + 27 : p + 27 + count])
        if p + size > len(b):
            return 0
        last = b[p + 5] & 4
        p += size
        if last:
            return p - at
    return 0


def _midi(b: bytes, at: int) -> int:
    if b[at + 4 : at + 8] != b"\0\0\0\6" or at + 14 > len(b):
        return 0
    p = at + 14
    for _ in range(int.from_bytes(b[at + 10 : at + 12], "big")):
        if b[p : p + 4] != b"MTrk" or p + 8 > len(b):
            return 0
        p += 8 + int.from_bytes(b[p + 4 : p + 8], "big")
    return p - at if p <= len(b) and p > at + 14 else 0


def _pdf(b: bytes, at: int) -> int:
    if not b[at + 5 : at + 8].replace(b".", b"").isdigit():
        return 0
    end = b.find(b"%%EOF", at)
    return end + 5 - at if end > 0 and b.find(b"startxref", at, end) > 0 else 0


def _zip(b: bytes, at: int) -> int:
    p = b.find(b"PK\5\6", at)
    while 0 <= p <= len(b) - 22:
        size, start, note = struct.unpack_from("<IIH", b, p + 12)
        if start + size == p - at and b[at + start : at + start + 4] == b"PK\1\2" and p + 22 + note <= len(b):
            return p + 22 + note - at
        p = b.find(b"PK\5\6", p + 4)
    return 0


def _gzip(b: bytes, at: int) -> int:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return 0
    reader, fed = zlib.decompressobj(31), at
    try:
        while not reader.eof and fed < len(b):
            reader.decompress(b[fed : fed + 65536])
            fed += 65536
    except zlib.error:
        return 0
    return min(fed, len(b)) - len(reader.unused_data) - at if reader.eof else 0


def _boxes(b: bytes, at: int) -> int:
    """ISO media: boxes from ``ftyp`` on."""
    p, seen = at, set()
    while p + 8 <= len(b) and (kind := b[p + 4 : p + 8]) in _BOXES:
        size = int.from_bytes(b[p : p + 4], "big")
        if size < 8 or p + size > len(b):
            return 0
        seen.add(kind)
        p += size
    return p - at if {b"ftyp", b"moov"} <= seen or {b"ftyp", b"meta"} <= seen else 0


_BOXES = {b"ftyp", b"moov", b"mdat", b"free", b"skip", b"meta", b"moof", b"mfra", b"uuid", b"wide", b"sidx", b"styp"}


def _au(b: bytes, at: int) -> int:
    if at + 24 > len(b):
        return 0
    data, size, coding, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    sound = data >= 24 and 1 <= coding <= 27 and 0 < rate <= 768_000 and 0 < channels <= 64 and size < 0xFFFFFFFF
    return data + size if sound and at + data + size <= len(b) else 0


# Magic bytes, where they stand in the format, type, validator (fixed by the formats).
SIGNATURES: tuple[tuple[bytes, int, str, Callable[[bytes, int], int]], ...] = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"BM", 0, "image/bmp", _bmp),
    (b"WAVEfmt ", 8, "audio/wav", _riff),
    (b"WEBPVP8", 8, "image/webp", _riff),
    (b"AVI LIST", 8, "video/x-msvideo", _riff),
    (b"OggS\0\2", 0, "application/ogg", _ogg),
    (b"MThd", 0, "audio/midi", _midi),
    (b".snd", 0, "audio/basic", _au),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"PK\3\4", 0, "application/zip", _zip),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
    (b"ftyp", 4, "video/mp4", _boxes),
)


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic, back, kind, length in SIGNATURES:
        out.add_word(magic.decode("latin-1"), (len(magic), back, kind, length))
    out.make_automaton()
    return out


_FINDER = _automaton()


def found(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every valid medium, the outer one first.

    A medium inside one that starts with the column is reported too; one inside an
    embedded medium belongs to that one.
    """
    hits = []
    for last, (size, back, kind, length) in _FINDER.iter(data.decode("latin-1")):
        at = last + 1 - size - back
        if at >= 0 and (n := length(data, at)):
            hits.append((at, -n, kind))
    out: list[tuple[str, int, int]] = []
    free = 0
    for at, n, kind in sorted(set(hits)):
        if at == 0 and not (out and out[0][1] == 0):
            out.append((kind, 0, -n))
        elif at >= free and at > 0:
            out.append((kind, at, -n))
            free = at - n
    return out


_SNIFFED = "declared string, detected string, corrected boolean, length long, embedded array<struct<type:string,offset:long,length:long>>"


def sniff(df: DataFrame, id_column: str, media: str, declared: str) -> DataFrame:
    """(id, declared, detected, corrected, length, embedded) for a column of bytes.

    ``detected`` is the type of the valid medium at the start, else the declared type if
    no signature speaks for it, else application/octet-stream; ``length`` its bytes (null
    if unknown).  A null or empty column is application/octet-stream of length 0.
    """
    known = {kind for _, _, kind, _ in SIGNATURES}

    def step(batch: pa.RecordBatch) -> dict:
        rows = []
        for data, said in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            media_ = found(data) if data else []
            outer = media_[0] if media_ and media_[0][1] == 0 else None
            kind = outer[0] if outer else said if said and said not in known and data else UNKNOWN
            rows.append((said, kind, kind != said, outer[2] if outer else None if data else 0, [dict(zip(("type", "offset", "length"), m)) for m in media_ if m is not outer]))
        columns = list(zip(*rows))
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))]
        names = ["declared", "detected", "corrected", "length", "embedded"]
        return {id_column: batch.column(0)} | {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)}

    kind = df.schema[id_column].dataType.simpleString()
    return mapped(df.select(id_column, media, declared), step, f"`{id_column}` {kind}, {_SNIFFED}")


def carve(df: DataFrame, id_column: str, media: str) -> DataFrame:
    """(id, type, offset, content): a row for every embedded medium."""

    def step(batch: pa.RecordBatch) -> dict:
        out = [(i, k, at, d[at : at + n]) for i, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if d for k, at, n in found(d) if at]
        columns = list(zip(*out)) or [[]] * 4
        return {n: pa.array(c, k) for n, c, k in zip((id_column, "type", "offset", "content"), columns, (batch.column(0).type, pa.string(), pa.int64(), pa.binary()))}

    kind = df.schema[id_column].dataType.simpleString()
    return mapped(df.select(id_column, media), step, f"`{id_column}` {kind}, type string, offset long, content binary")


# Texts as sound: a lossless medium whose bytes are known in full.


def wave(samples: bytes) -> bytes:
    """8-bit mono PCM; the samples are the payload."""
    n = len(samples)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", n)
    return head + samples


def samples_of(medium: bytes) -> bytes:
    """The samples of an 8-bit PCM medium, by walking its chunks."""
    p, end = 12, 8 + int.from_bytes(medium[4:8], "little")
    while p + 8 <= end:
        size = int.from_bytes(medium[p + 4 : p + 8], "little")
        if medium[p : p + 4] == b"data":
            return medium[p + 8 : p + 8 + size]
        p += 8 + size + size % 2
    raise ValueError("no data chunk")


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, declared, medium): every whole text as stored 8-bit samples,
    padded with zeros to a positive multiple of 64 bytes; the type is left undeclared."""

    def step(batch: pa.RecordBatch) -> dict:
        raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
        media = [wave(r + bytes(-len(r) % 64 if r else 64)) for r in raw]
        return {"doc_id": batch.column(0), "n_bytes": [len(r) for r in raw], "declared": [UNKNOWN] * len(raw), "medium": media}

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return kept(mapped(docs, step, "doc_id long, n_bytes long, declared string, medium binary"), "media")


def digests(media: DataFrame) -> DataFrame:
    """Reads stored media back: what the bytes prove to be, the payload, its digests.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature); the feature holds the detected type, whether the declared
    one had to be corrected, mean and peak of the samples, and the embedded media.
    """

    def step(batch: pa.RecordBatch) -> dict:
        rows = []
        for said, medium in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            media_ = found(medium)
            kind, _, length = media_[0]
            payload = samples_of(medium[:length])
            level = np.frombuffer(payload, np.uint8)
            inner = ",".join(f"{k}@{at}+{n}" for k, at, n in media_[1:]) or "none"
            feature = f"{kind};corrected={int(kind != said)};mean={int(level.sum()) // len(level)};peak={int(level.max())};embedded={inner}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(medium), hashlib.sha256(medium).hexdigest(), feature))
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        return {"doc_id": batch.column(0), "n_bytes": batch.column(1)} | dict(zip(names, map(list, zip(*rows))))

    return mapped(
        media.select("doc_id", "n_bytes", "declared", "medium"),
        step,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string",
    )
