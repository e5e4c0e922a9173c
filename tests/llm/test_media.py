"""Signatures and validators against media built by the format's rules."""

import gzip
import hashlib
import io
import struct
import zipfile
import zlib

from galeframe.llm import media


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0\xff\xda\0\x08\1\1\0\0\x3f\0\x12\xff\0\x34\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
MIDI = b"MThd\0\0\0\6\0\0\0\1\0\x60MTrk\0\0\0\4\0\xff\x2f\0"
MP4 = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 8, b"moov") + struct.pack(">I4s", 12, b"mdat") + b"abcd"
AU = b".snd" + struct.pack(">IIIII", 24, 4, 1, 8000, 1) + b"abcd"
PDF = b"%PDF-1.4\n1 0 obj\nstartxref\n0\n%%EOF"
MADE = {
    "image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "audio/midi": MIDI, "video/mp4": MP4, "audio/basic": AU,
    "application/pdf": PDF, "application/zip": archive(), "application/gzip": gzip.compress(b"data" * 50), "audio/wav": media.wave(b"\x80" * 64),
}


def test_every_format_is_found_and_measured():
    for kind, data in MADE.items():
        assert media.found(data + b"tail")[0] == (kind, 0, len(data)), kind
        assert media.found(b"some text " + data + b"tail") == [(kind, 10, len(data))], kind
        assert not media.found(data[:-3]), kind


def test_magic_bytes_by_chance_are_no_media():
    assert media.found(b"BM GIF89a %PDF- PK\3\4 RIFF....WAVEfmt  OggS ftyp MThd .snd \xff\xd8\xff") == []
    assert media.found(b"") == []


def test_sniff_and_carve(spark):
    inside = b"head" + MADE["image/png"] + b"mid" + MADE["image/gif"]
    rows = [(1, MADE["image/png"], "image/jpeg", "z"), (2, inside, "text/plain", "z"), (3, None, "image/png", "z"), (4, b"", None, "z"), (5, b"abc", "image/png", "z"), (1, MADE["image/png"], "image/png", "z")]
    df = spark.createDataFrame(rows, "id long, body binary, said string, length string")
    got = sorted(((r["id"], r["said"] if "said" in r else r["declared"], r["detected"], r["corrected"], r["length"], len(r["embedded"])) for r in media.sniff(df, "id", "body", "said").collect()), key=repr)
    size = len(MADE["image/png"])
    assert got == sorted(
        [(1, "image/jpeg", "image/png", True, size, 0), (1, "image/png", "image/png", False, size, 0), (2, "text/plain", "text/plain", False, None, 2),
         (3, "image/png", media.UNKNOWN, True, 0, 0), (4, None, media.UNKNOWN, True, 0, 0), (5, "image/png", media.UNKNOWN, True, None, 0)], key=repr,
    )
    carved = {(r["id"], r["type"], r["offset"]): bytes(r["content"]) for r in media.carve(df, "id", "body").collect()}
    assert carved == {(2, "image/png", 4): MADE["image/png"], (2, "image/gif", 7 + size): MADE["image/gif"]}


def test_texts_as_sound(spark, docs, none, texts):
    rows = {r["doc_id"]: r for r in media.digests(media.stored(docs)).collect()}
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        medium = media.wave(payload)
        r = rows[3 * k]
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(medium))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(medium).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["feature"].startswith("audio/wav;corrected=1;")
    assert media.digests(media.stored(none)).count() == 0
