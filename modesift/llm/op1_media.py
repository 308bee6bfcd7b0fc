"""Media columns: signature sniffing of binary values.

An Aho-Corasick automaton locates the magic bytes of all formats in one pass, and with them the trailers of
formats that are bounded from their end, so that no validator searches on from each hit. For each hit a validator
walks the format's own structure (chunks, boxes, pages, blocks, markers) with lengths and checksums and
says where the medium ends, or rejects the hit. A valid medium at the start gives the detected type,
which corrects the declared one; valid media further in are carved as spans.

Defined results: null content is empty content, detected as nothing; a declared type of null counts as
unknown; hits inside an already validated medium are part of it; equal contents give equal results.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_rows, documents, text_bytes

#: Bytes that end a medium or a part of one. Fixed by the formats.
TRAILERS = (b"startxref", b"%%EOF", b"PK\x05\x06")


class Marks:
    """Where the automaton met each of the byte strings that validators look for, in order."""

    def __init__(self) -> None:
        self.at: dict[bytes, list[int]] = {}

    def next(self, mark: bytes, start: int, default: int) -> int:
        """The first position from ``start`` on, or the default."""
        known = self.at.get(mark, [])
        k = bisect.bisect_left(known, start)
        return known[k] if k < len(known) else default


PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def _png(d: bytes, at: int) -> int:
    """Chunks with their CRCs from IHDR to IEND."""
    p, first = at + 8, True
    while p + 12 <= len(d):
        size, kind = struct.unpack_from(">I4s", d, p)
        end = p + 12 + size
        if end > len(d) or first != (kind == b"IHDR") or zlib.crc32(memoryview(d)[p + 4 : end - 4]) != struct.unpack_from(">I", d, end - 4)[0]:
            return -1
        if kind == b"IEND":
            return end
        first, p = False, end
    return -1


def _jpeg(d: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(d):
        if d[p] != 0xFF:
            return -1
        marker = d[p + 1]
        p += 2
        if marker == 0xD9:
            return p
        if 0xD0 <= marker <= 0xD7 or marker == 1:
            continue
        p += struct.unpack_from(">H", d, p)[0]
        if marker == 0xDA:  # entropy-coded data up to the next true marker
            while True:
                p = d.find(b"\xff", p)
                if p < 0 or p + 1 >= len(d):
                    return -1
                if d[p + 1] == 0 or 0xD0 <= d[p + 1] <= 0xD7:
                    p += 2
                    continue
                break
    return p + 2 if d[p : p + 2] == b"\xff\xd9" else -1


def _gif(d: bytes, at: int) -> int:
    if len(d) < at + 13:
        return -1
    p = at + 13 + (3 << ((d[at + 10] & 7) + 1) if d[at + 10] & 0x80 else 0)
    while p < len(d):
        kind = d[p]
        if kind == 0x3B:
            return p + 1
        if kind == 0x21:
            p += 2
        elif kind == 0x2C and p + 10 < len(d):
            p += 10 + (3 << ((d[p + 9] & 7) + 1) if d[p + 9] & 0x80 else 0) + 1
        else:
            return -1
        while p < len(d) and d[p]:
            p += d[p] + 1
        p += 1
    return -1


def _bmp(d: bytes, at: int) -> int:
    if len(d) < at + 30:
        return -1
    size, _, _, start, head = struct.unpack_from("<IHHII", d, at + 2)
    return at + size if 26 <= start <= size <= len(d) - at and head in (12, 40, 52, 56, 108, 124) else -1


def _riff(d: bytes, at: int) -> int:
    if len(d) < at + 12 or d[at + 8 : at + 12] not in (b"WAVE", b"WEBP", b"AVI "):
        return -1
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    p = at + 12
    while p + 8 <= end <= len(d):
        p += 8 + (n := struct.unpack_from("<I", d, p + 4)[0]) + n % 2
    return end if p == end and end > at + 12 else -1


def _flac(d: bytes, at: int) -> int:
    p, last, first = at + 4, False, True
    while not last:
        if p + 4 > len(d) or first and (d[p] & 127 or d[p + 1 : p + 4] != b"\0\0\x22"):
            return -1
        last, first = bool(d[p] & 128), False
        p += 4 + int.from_bytes(d[p + 1 : p + 4], "big")
    return len(d) if p < len(d) and d[p : p + 2] in (b"\xff\xf8", b"\xff\xf9") else -1


def _ogg(d: bytes, at: int) -> int:
    p, end = at, -1
    while d[p : p + 5] == b"OggS\0" and p + 27 <= len(d):
        n = d[p + 26]
        p += 27 + n + sum(d[p + 27 : p + 27 + n])
        if p > len(d):
            return -1
        end = p
    return end


def _mp4(d: bytes, at: int) -> int:
    """Boxes from ftyp on; the magic stands four bytes after the start. Films and sound have a moov or moof box,
    still images a meta box."""
    p, known, kinds = at, {b"ftyp", b"moov", b"mdat", b"free", b"skip", b"moof", b"mfra", b"wide", b"uuid", b"sidx", b"meta", b"styp", b"pdin", b"idat"}, set()
    while p + 8 <= len(d):
        size, kind = struct.unpack_from(">I4s", d, p)
        if size == 1 and p + 16 <= len(d):
            size = struct.unpack_from(">Q", d, p + 8)[0]
        if kind not in known or size < 8 or p + size > len(d) or (kind == b"ftyp") != (p == at):
            break
        kinds.add(kind)
        p += size
    return p if kinds & ({b"meta"} if _brand(d, at).startswith("image/") else {b"moov", b"moof"}) else -1


def _brand(d: bytes, at: int) -> str:
    return BRANDS.get(d[at + 8 : at + 12], "video/mp4")


def _pdf(d: bytes, at: int, marks: Marks) -> int:
    """To the end of the last section (startxref, offset, %%EOF) before the next file's header, so incremental
    updates belong to their file; a line break after the last mark does too if the value ends with it."""
    until = marks.next(b"%PDF-", at + 1, len(d))
    end, p = -1, at
    while (start := marks.next(b"startxref", p, until)) < until:
        p = start + 9
        eof = marks.next(b"%%EOF", p, until)
        if eof < until and eof - p <= 40 and d[p:eof].strip().isdigit():  # an offset and line breaks
            end = p = eof + 5
    return len(d) if end > 0 and d[end:] in (b"\n", b"\r", b"\r\n") else end


def _zip(d: bytes, at: int, marks: Marks) -> int:
    """Through the end record, whose directory offset must point at a directory entry."""
    p = marks.next(b"PK\x05\x06", at, -1)
    if p < 0 or p + 22 > len(d):
        return -1
    size, start, note = struct.unpack_from("<IIH", d, p + 12)
    return p + 22 + note if at + start + size == p and d[at + start : at + start + 4] in (b"PK\x01\x02", b"PK\x05\x06") and p + 22 + note <= len(d) else -1


def _gzip(d: bytes, at: int) -> int:
    z = zlib.decompressobj(31)
    try:
        for k in range(at, len(d), 1 << 16):
            z.decompress(d[k : k + (1 << 16)])
            if z.eof:
                return min(len(d), k + (1 << 16)) - len(z.unused_data)
    except zlib.error:
        pass
    return -1


#: Magic bytes, offset of the magic from the medium's start, media type, validator. Fixed by the formats.
FORMATS: list[tuple[bytes, int, str, Callable[..., int]]] = [
    (PNG_MAGIC, 0, "image/png", _png),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"BM", 0, "image/bmp", _bmp),
    (b"RIFF", 0, "riff", _riff),
    (b"fLaC", 0, "audio/flac", _flac),
    (b"OggS", 0, "audio/ogg", _ogg),
    (b"ftyp", 4, "boxes", _mp4),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"PK\x03\x04", 0, "application/zip", _zip),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
]
#: Media types of files of boxes by their major brand, where it is not video/mp4. Fixed by the formats.
BRANDS = {
    b"M4A ": "audio/mp4", b"M4B ": "audio/mp4", b"M4P ": "audio/mp4", b"avif": "image/avif", b"avis": "image/avif", b"heic": "image/heic", b"heix": "image/heic",
    b"heim": "image/heic", b"heis": "image/heic", b"mif1": "image/heif", b"msf1": "image/heif", b"qt  ": "video/quicktime", b"3gp4": "video/3gpp", b"3gp5": "video/3gpp", b"3gp6": "video/3gpp",
}
_RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k, (magic, *_) in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), k)
    for k, mark in enumerate(TRAILERS, start=len(FORMATS)):
        a.add_word(mark.decode("latin-1"), k)
    a.make_automaton()
    return a


_MAGIC = _automaton()


def sniff(data: bytes) -> tuple[int, list[tuple[int, int, str]]]:
    """Number of magic hits, and the valid media (start, end, type) left to right, not nested."""
    hits, marks = [], Marks()
    for end, k in _MAGIC.iter(data.decode("latin-1")):
        magic, shift = FORMATS[k][:2] if k < len(FORMATS) else (TRAILERS[k - len(FORMATS)], 0)
        at = end + 1 - len(magic) - shift
        marks.at.setdefault(magic, []).append(at)
        if k < len(FORMATS):
            hits.append((at, k))
    spans: list[tuple[int, int, str]] = []
    free = 0
    for at, k in sorted(h for h in hits if h[0] >= 0):
        if at < free:
            continue
        _, _, kind, check = FORMATS[k]
        try:
            end = check(data, at, marks) if check in (_pdf, _zip) else check(data, at)
        except (struct.error, IndexError):
            end = -1
        if end > at:
            spans.append((at, end, _RIFF_TYPES[data[at + 8 : at + 12]] if kind == "riff" else _brand(data, at) if kind == "boxes" else kind))
            free = end
    return len(hits), spans


def sniff_column(df: DataFrame, content: str, declared: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The kept columns with detected type, corrected type (detected, else declared), whether that
    differs from the declared one, number of magic hits, and the media found as spans."""
    keep = keep or []
    fields = [f for f in df.schema.fields if f.name in keep]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema = ", ".join(filter(None, [head, "detected string, corrected string, changed boolean, magic_hits long, media array<struct<start:long,end:long,type:string>>"]))
    cols = [*keep, content, *([declared] if declared else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string())])
        for batch in batches:
            found = [sniff(x) for x in text_bytes(batch.column(content))]
            said = batch.column(declared).to_pylist() if declared else [None] * len(found)
            kinds = [s[0][2] if s and s[0][0] == 0 else None for _, s in found]
            right = [k or d for k, d in zip(kinds, said, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(kinds, pa.string()), pa.array(right, pa.string()), pa.array([a != b for a, b in zip(right, said, strict=True)]), pa.array([n for n, _ in found], pa.int64()), pa.array([[dict(start=a, end=b, type=t) for a, b, t in s] for _, s in found], pa.list_(span))], names=[*keep, "detected", "corrected", "changed", "magic_hits", "media"])

    return df.select(*cols).mapInArrow(run, schema)


# --- lossless storage of texts as 8-bit grey images ----------------------------------------------

WIDTH = 64


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def store_png(text: bytes) -> bytes:
    """The text, padded with bytes 0 to a positive multiple of 64, as an 8-bit grey PNG 64 wide."""
    rows = max(1, -(-len(text) // WIDTH))
    lines = np.zeros((rows, WIDTH + 1), dtype=np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = np.frombuffer(text.ljust(rows * WIDTH, b"\0"), dtype=np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> bytes:
    """The samples of an image made by store_png."""
    body, p = [], 8
    while p < len(data):
        size, kind = struct.unpack_from(">I4s", data, p)
        if kind == b"IDAT":
            body.append(data[p + 8 : p + 8 + size])
        p += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(-1, WIDTH + 1)[:, 1:].tobytes()


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _row(doc_id: int | None, text: bytes) -> tuple:
    media = store_png(text)
    _, spans = sniff(media)
    at, end, kind = spans[0]
    payload = read_png(media[at:end])
    hits, inside = sniff(payload)
    feature = f"declared=application/octet-stream;detected={kind};rows={len(payload) // WIDTH};payload_hits={hits};carved={','.join(f'{t}@{a}-{b}' for a, b, t in inside)}"
    return doc_id, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), end - at, hashlib.sha256(media[at:end]).hexdigest(), feature


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrow_rows(batch, 1 << 23):
            rows = [_row(i, x) for i, x in zip(part.column("doc_id").to_pylist(), text_bytes(part.column("text")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_OUT)], schema=_OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as an image, found again by its signature, validated, read back."""
    return documents(spark, sf_dir).select("doc_id", "text").mapInArrow(_store, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
