"""A valid and a broken blob of each format, two media carved from one blob, corrected types, null blobs."""

import gzip
import io
import random
import struct
import time
import zipfile
import zlib

import pytest

from plumbline.llm import media


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "some text " * 20)
        z.writestr("b.txt", "more")
    return out.getvalue()


PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\7")) + chunk(b"IEND", b"")
VALID = {
    "audio/wav": media.wrap(b"abcdefgh" * 8),
    "image/png": PNG,
    "image/gif": b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0" + b"\x3b",
    "image/bmp": struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 58, 0, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4),
    "image/jpeg": b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + bytes(9) + b"\xff\xda" + struct.pack(">H", 8) + bytes(6) + b"\x12\xff\x00\x34\xff\xd9",
    "application/pdf": b"%PDF-1.4\n1 0 obj <<>> endobj\nstartxref\n9\n%%EOF",
    "application/zip": archive(),
    "application/gzip": gzip.compress(b"text " * 50),
}


@pytest.mark.parametrize("kind", sorted(VALID))
def test_formats(kind):
    blob = VALID[kind]
    assert media.sniff(blob) == [(kind, 0, len(blob))]
    assert media.sniff(b"before " + blob + b" after") == [(kind, 7, 7 + len(blob))]
    assert not [m for m in media.sniff(blob[:-3]) if m[0] == kind]


def test_every_format_is_tried():
    assert set(VALID) == set(media.VALIDATORS)


def test_two_media_in_one_blob():
    a, b = VALID["image/png"], VALID["audio/wav"]
    broken = a[:20] + bytes([a[20] ^ 1]) + a[21:]
    assert media.sniff(b"x" * 5 + a + b"--" + broken + b) == [("image/png", 5, 5 + len(a)), ("audio/wav", 7 + 2 * len(a), 7 + 2 * len(a) + len(b))]


def test_many_beginnings_cost_one_pass():
    """A megabyte of starts without ends of their own: seconds if every hit searched on, far less by tables of end marks."""
    began = time.process_time()
    assert media.sniff(b"%PDF-" * 200_000 + b"%%EOF") == []
    assert media.sniff(b"PK\x03\x04" * 100_000 + (b"PK\x05\x06" + bytes(18)) * 20_000) == []
    assert time.process_time() - began < 10
    pair = VALID["application/pdf"] + b"%PDF-%%EOF" + VALID["application/pdf"]
    n = len(VALID["application/pdf"])
    assert media.sniff(pair) == [("application/pdf", 0, n), ("application/pdf", n + 10, 2 * n + 10)]
    two = VALID["application/zip"] * 2
    assert media.sniff(two) == [("application/zip", 0, len(two) // 2), ("application/zip", len(two) // 2, len(two))]


def test_column(spark):
    rows = [(1, VALID["image/png"], "image/jpeg"), (2, None, "image/png"), (3, b"", None), (4, b"xx" + VALID["image/gif"], "image/gif")]
    df = spark.createDataFrame(rows, "id long, blob binary, said string")
    got = {r.id: (r.declared, r.media_type, [(c.media_type, c.start, c.end) for c in r.carved]) for r in media.sniff_column(df, "blob", "said", ["id"]).collect()}
    assert got[1] == ("image/jpeg", "image/png", [("image/png", 0, len(PNG))]) and got[2] == ("image/png", media.UNKNOWN, []) and got[3] == (None, media.UNKNOWN, [])
    assert got[4][1] == media.UNKNOWN and got[4][2] == [("image/gif", 2, 2 + len(VALID["image/gif"]))]


def member(body: bytes, stored: bool = True) -> bytes:
    """A gzip member, of stored blocks or coded."""
    c = zlib.compressobj(0 if stored else 9, zlib.DEFLATED, 31)
    return c.compress(body) + c.flush()


def test_gzip_members():
    rnd = random.Random(5)
    noise = rnd.randbytes(70000)
    for stored in (True, False):
        for body in (b"", b"a", b"text " * 9000, noise, b"\0" * 3_000_000):
            blob = b"before " + member(body, stored) + b" after"
            assert media.sniff(blob) == [("application/gzip", 7, len(blob) - 6)], (stored, len(body))
        cut = member(noise, stored)[:-20]
        assert media.sniff(cut) == [] and media.sniff(cut + b"x" * 40) == []
        wrong = bytearray(member(noise, stored))
        wrong[-6] ^= 1
        assert media.sniff(bytes(wrong)) == []
    named = gzip.compress(b"x" * 100)
    with_name = named[:3] + b"\x08" + named[4:10] + b"name.txt\0" + named[10:]
    assert media.sniff(with_name) == [("application/gzip", 0, len(with_name))]


def test_hostile_gzip():
    """Beginnings nested in each other's stored blocks, none of which ends: one walk for all."""
    begin = b"\x1f\x8b\x08" + bytes(7)
    one = begin + b"\0" + struct.pack("<HH", 10, 10 ^ 0xFFFF)
    blob = one * 70_000  # each one's block is the next one's head
    blob = blob[: 1 << 20]
    began = time.perf_counter()
    assert media.sniff(blob) == []
    assert time.perf_counter() - began < 1.5
