"""Media columns by signature sniffing: magic bytes are located by an Aho-Corasick automaton, format validators confirm
structure and lengths, declared types are corrected, and media embedded in larger blobs are carved out.

Formats: WAVE, PNG, GIF, BMP, JPEG, PDF, ZIP, gzip. A hit counts only if its validator walks the structure to an end
inside the blob; where valid media overlap, the earliest start wins, then the longest.

Cases: null and empty blobs have no media and type application/octet-stream; a magic inside text or inside another
medium's body gives no medium of its own; very long blobs are scanned once, and what a validator
learns of a blob serves its other beginnings; repeated rows give equal values; an empty
table gives an empty result; only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

# The magic bytes of each format and where they stand from the start of the medium.
MAGIC = {
    b"WAVE": ("audio/wav", 8),
    b"\x89PNG\r\n\x1a\n": ("image/png", 0),
    b"GIF87a": ("image/gif", 0),
    b"GIF89a": ("image/gif", 0),
    b"BM": ("image/bmp", 0),
    b"\xff\xd8\xff": ("image/jpeg", 0),
    b"%PDF-": ("application/pdf", 0),
    b"PK\x03\x04": ("application/zip", 0),
    b"\x1f\x8b\x08": ("application/gzip", 0),
}
UNKNOWN = "application/octet-stream"
RATE = 8000


def _wav(b: bytes, at: int) -> int:
    """End of a RIFF/WAVE file whose chunks fill its declared length and hold a format and data; -1 if none."""
    if b[at : at + 4] != b"RIFF" or at + 12 > len(b):
        return -1
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return -1
    seen, i = set(), at + 12
    while i + 8 <= end:
        name, size = struct.unpack_from("<4sI", b, i)
        seen.add(name)
        i += 8 + size + (size & 1)
    return end if i == end and {b"fmt ", b"data"} <= seen else -1


def _png(b: bytes, at: int) -> int:
    """End of a PNG: chunks with right checksums from IHDR to IEND."""
    i, first = at + 8, True
    while i + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, i)
        if i + 12 + size > len(b) or first and name != b"IHDR":
            return -1
        if zlib.crc32(b[i + 4 : i + 8 + size]) != struct.unpack_from(">I", b, i + 8 + size)[0]:
            return -1
        i, first = i + 12 + size, False
        if name == b"IEND":
            return i
    return -1


def _gif(b: bytes, at: int) -> int:
    """End of a GIF: its blocks up to the trailer."""

    def table(flags: int) -> int:
        return 3 << (flags & 7) + 1 if flags & 128 else 0

    def blocks(i: int) -> int:
        while i < len(b) and b[i]:
            i += 1 + b[i]
        return i + 1

    if at + 13 > len(b):
        return -1
    i, frames = at + 13 + table(b[at + 10]), 0
    while i < len(b):
        if b[i] == 0x3B:
            return i + 1 if frames else -1
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 < len(b):
            i, frames = blocks(i + 11 + table(b[i + 9])), frames + 1
        else:
            return -1
    return -1


def _bmp(b: bytes, at: int) -> int:
    """End of a BMP whose declared length, data offset and header agree."""
    if at + 54 > len(b):
        return -1
    size, zero, offset, header, _, _, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    fits = zero == 0 and planes == 1 and header in (40, 52, 56, 108, 124) and bits in (1, 4, 8, 16, 24, 32)
    return at + size if fits and 14 + header <= offset <= size and at + size <= len(b) else -1


_EOI = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _jpeg(b: bytes, at: int) -> int:
    """End of a JPEG: marker segments, then entropy-coded data, up to the end marker."""
    i, scanned = at + 2, False
    while i + 4 <= len(b) and b[i] == 0xFF:
        i, scanned = i + 2 + struct.unpack_from(">H", b, i + 2)[0], scanned or b[i + 1] == 0xDA
        if scanned:
            m = _EOI.search(b, i)
            if not m:
                return -1
            if m[0][1] == 0xD9:
                return m.end()
            i = m.start()
    return -1


class _Blob(bytes):
    """A blob that knows where the end marks of PDF and ZIP stand: each is found in one pass, and only when asked for, so
    that many beginnings without an end cost no further passes."""

    @cached_property
    def gzip_dead(self) -> set[int]:
        """Places of gzip blocks from which no end was reached."""
        return set()

    @cached_property
    def pdf_ends(self) -> list[int]:
        return [m.start() for m in re.finditer(rb"%%EOF", self)]

    @cached_property
    def pdf_tables(self) -> list[int]:
        return [m.start() for m in re.finditer(rb"startxref", self)]

    @cached_property
    def zip_ends(self) -> dict[int, int]:
        """Start and end of each ZIP: an end record's directory offset and length lead back to its start; of several
        records of one start the first counts."""
        found: dict[int, int] = {}
        for m in re.finditer(rb"PK\x05\x06", self):
            i = m.start()
            if i + 22 <= len(self):
                size, offset, comment = struct.unpack_from("<IIH", self, i + 12)
                start = i - size - offset
                if start >= 0 and self[start + offset : start + offset + 4] == b"PK\x01\x02" and i + 22 + comment <= len(self):
                    found.setdefault(start, i + 22 + comment)
        return found


def _pdf(b: _Blob, at: int) -> int:
    """End of a PDF: the first end mark behind its start, a cross-reference table's place before it."""
    end, table = bisect_left(b.pdf_ends, at), bisect_left(b.pdf_tables, at)
    if end == len(b.pdf_ends) or table == len(b.pdf_tables) or b.pdf_tables[table] + 9 > b.pdf_ends[end]:
        return -1
    return b.pdf_ends[end] + 5


def _zip(b: _Blob, at: int) -> int:
    return b.zip_ends.get(at, -1)


def _gzip_body(b: bytes, at: int) -> int:
    """Where a gzip member's first block begins, or -1."""
    if at + 10 > len(b) or b[at + 3] & 0xE0:
        return -1
    flags, i = b[at + 3], at + 10
    if flags & 4:
        i += 2 + struct.unpack_from("<H", b, i)[0] if i + 2 <= len(b) else len(b)
    for flag in (8, 16):
        if flags & flag:
            i = b.find(b"\0", i) + 1 or len(b)
    return i + (2 if flags & 2 else 0)


def _gzip(b: _Blob, at: int) -> int:
    """End of a gzip member. Stored blocks are followed by their lengths; a block from which no end was reached is remembered,
    so that many beginnings in one blob walk it once. Coded blocks are decoded by bounded pieces."""
    i, path, total, dead = _gzip_body(b, at), [], 0, b.gzip_dead
    while 0 <= i and i + 5 <= len(b) and i not in dead and b[i] >> 1 & 3 == 0:
        path.append(i)
        n, complement = struct.unpack_from("<HH", b, i + 1)
        last, i, total = b[i] & 1, i + 5 + n, total + n
        if n ^ 0xFFFF != complement or i > len(b):
            i = -1
        elif last:  # of all beginnings that share this end, the length at the end fits few
            if i + 8 > len(b) or struct.unpack_from("<I", b, i + 4)[0] != total & 0xFFFFFFFF:
                return -1
            return i + 8 if _whole(b, at) == i + 8 else -1
    if i < 0 or i + 5 > len(b) or i in dead:
        dead.update(path)
        return -1
    end = _whole(b, at)
    if end == -1:
        dead.update([*path, i])
    return max(end, -1)


def _whole(b: bytes, at: int) -> int:
    """End of the member that zlib decodes from here; -1 where it breaks off, -2 where only its checksum is wrong."""
    d = zlib.decompressobj(31)
    try:
        for i in range(at, len(b), 1 << 16):
            piece = b[i : i + (1 << 16)]
            while piece:
                d.decompress(piece, 1 << 16)
                piece = d.unconsumed_tail
            if d.eof:
                return min(len(b), i + (1 << 16)) - len(d.unused_data)
    except zlib.error as e:
        return -2 if "check" in str(e) else -1
    return -1


VALIDATORS = {"audio/wav": _wav, "image/png": _png, "image/gif": _gif, "image/bmp": _bmp, "image/jpeg": _jpeg, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip}
_AUTOMATON: list = []


def automaton():
    if not _AUTOMATON:
        a = ahocorasick.Automaton()
        for magic, (kind, back) in MAGIC.items():
            a.add_word(magic.decode("latin-1"), (kind, back + len(magic)))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def sniff(blob: bytes) -> list[tuple[str, int, int]]:
    """(type, start, end) of each valid medium in the blob, outermost first come, without overlaps."""
    blob = _Blob(blob)
    hits = sorted((end + 1 - length, kind) for end, (kind, length) in automaton().iter(blob.decode("latin-1")))
    found: list[tuple[str, int, int]] = []
    past = 0
    for start, kind in hits:
        if start >= past and (end := VALIDATORS[kind](blob, start)) > 0:
            found.append((kind, start, end))
            past = end
    return found


def wrap(payload: bytes) -> bytes:
    """A WAVE file of one channel whose 8-bit samples are the payload."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples(blob: bytes, start: int, end: int) -> bytes:
    """The data chunk of the WAVE file in blob[start:end]."""
    i = start + 12
    while i + 8 <= end:
        name, size = struct.unpack_from("<4sI", blob, i)
        if name == b"data":
            return blob[i + 8 : i + 8 + size]
        i += 8 + size + (size & 1)
    return b""


def sniff_column(df: DataFrame, blob_col: str, declared_col: str, keep: list[str], features=None) -> DataFrame:
    """Adds declared, media_type (corrected: a medium that fills the blob) and carved, an array of type, start and end;
    with `features`, a function of (blob, spans) to a string, also feature."""
    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    spans_type = pa.list_(pa.struct([("media_type", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            blobs = [b or b"" for b in batch.column(blob_col).to_pylist()]
            found = [sniff(b) for b in blobs]
            whole = [f[0][0] if f and f[0][1:] == (0, len(b)) else UNKNOWN for f, b in zip(found, blobs)]
            carved = pa.array([[{"media_type": k, "start": s, "end": e} for k, s, e in f] for f in found], spans_type)
            columns = [*(batch.column(c) for c in keep), batch.column(declared_col), pa.array(whole, pa.string()), carved]
            if features:
                columns.append(pa.array([features(b, f) for b, f in zip(blobs, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*keep, "declared", "media_type", "carved", *["feature"] * bool(features)])

    schema = f"{fields}, declared string, media_type string, carved array<struct<media_type string, start long, end long>>" + ", feature string" * bool(features)
    return df.select(*keep, blob_col, declared_col).mapInArrow(run, schema)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a WAVE blob of its padded UTF-8 bytes, with a declared type that sniffing has to correct."""

    def run(batches):
        for batch in batches:
            raw = [t.encode() for t in common.texts(batch, text_col)]
            media = [wrap(r + bytes(-len(r) % 64 or (0 if r else 64))) for r in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary()), pa.array([UNKNOWN] * len(raw), pa.string())],
                [id_col, "n_bytes", "media", "declared"],
            )

    common.small_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary, declared string")


def digests(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads stored blobs back through the sniffer and digests the carved payload."""

    def digest(blob: bytes, found: list[tuple[str, int, int]]) -> str:
        kind, start, end = found[0]
        payload = samples(blob, start, end)
        x = np.frombuffer(payload, dtype=np.uint8)
        counts = np.bincount(x, minlength=256)
        p = counts[counts > 0] / len(x)
        feature = f"{kind};media={len(found)};span={start}-{end};rate={RATE};bits=8;min={x.min()};max={x.max()};mean={int(x.sum(dtype=np.int64)) / len(x):.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};levels={len(p)}"
        return "|".join([str(len(payload)), hashlib.sha256(payload).hexdigest(), str(zlib.crc32(payload[-64:])), str(end - start), hashlib.sha256(blob[start:end]).hexdigest(), feature])

    sniffed = sniff_column(stored, "media", "declared", [id_col, "n_bytes"], digest)
    return sniffed.selectExpr(
        id_col, "n_bytes", "cast(split_part(feature, '|', 1) as long) payload_bytes", "split_part(feature, '|', 2) payload_sha256", "cast(split_part(feature, '|', 3) as long) tail_crc32",
        "cast(split_part(feature, '|', 4) as long) media_bytes", "split_part(feature, '|', 5) media_sha256", "split_part(feature, '|', 6) feature", "declared", "media_type",
    )


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = common.materialize(store_texts(common.documents(spark, sf_dir)), "media", compression="zstd")
    return digests(stored)
