import gzip
import hashlib
import io
import random
import struct
import zipfile
import zlib

from modesift.llm import op1_media as M


def wav(n):
    body = bytes(range(256))[:n]
    data = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", n) + body
    return b"RIFF" + struct.pack("<I", 4 + len(data)) + b"WAVE" + data


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + bytes(8) + b"\0" + b"\x02\x02\x44\x01\0" + b"\x3b"
BMP = b"BM" + struct.pack("<IHHIIIIHHI", 58, 0, 0, 54, 40, 1, 1, 1, 24, 0) + bytes(58 - 34)
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + bytes(14) + b"\xff\xda" + struct.pack(">H", 8) + bytes(6) + b"\x01\xff\x00\x02\xff\xd9"
FLAC = b"fLaC" + b"\x80\x00\x00\x22" + bytes(34) + b"\xff\xf8" + bytes(10)
OGG = b"OggS\0" + bytes(21) + b"\x02\x03\x04" + bytes(7)
MP4 = struct.pack(">I4s", 16, b"ftyp") + bytes(8) + struct.pack(">I4s", 12, b"moov") + bytes(4)
PDF = b"%PDF-1.4\nxx\nstartxref\n0\n%%EOF"
MEDIA = {"image/png": M.store_png(b"hello"), "image/gif": GIF, "image/bmp": BMP, "image/jpeg": JPEG, "audio/wav": wav(10), "audio/flac": FLAC, "audio/ogg": OGG, "video/mp4": MP4, "application/pdf": PDF, "application/zip": zipped(), "application/gzip": gzip.compress(b"x" * 100)}


def test_every_format_is_found_and_bounded():
    for kind, data in MEDIA.items():
        _, spans = M.sniff(data)
        assert spans == [(0, len(data), kind)], kind


def test_embedded_media_are_carved():
    for kind, data in MEDIA.items():
        if kind == "audio/flac":  # its frames have no total length: it runs to the end
            continue
        _, spans = M.sniff(b"prose " + data + b" more prose")
        assert spans == [(6, 6 + len(data), kind)], kind


def test_damage_is_rejected():
    for kind, data in MEDIA.items():
        if kind != "application/pdf":
            assert all(s[1] != len(data) or s[0] for s in M.sniff(data[:-3])[1]) or kind in ("audio/flac",), kind
    bad = bytearray(MEDIA["image/png"])
    bad[20] ^= 1
    assert not M.sniff(bytes(bad))[1]
    rng = random.Random(1)
    for data in MEDIA.values():
        for _ in range(50):
            x = bytearray(data)
            x[rng.randrange(len(x))] ^= 1 << rng.randrange(8)
            M.sniff(bytes(x))  # never raises


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_brands_of_box_files():
    film, still = box(b"moov", bytes(4)) + box(b"mdat", bytes(9)), box(b"meta", bytes(12)) + box(b"mdat", bytes(5))
    for brand, rest, kind in ((b"M4A ", film, "audio/mp4"), (b"isom", film, "video/mp4"), (b"qt  ", film, "video/quicktime"), (b"heic", still, "image/heic"), (b"mif1", still, "image/heif"), (b"avif", still, "image/avif")):
        data = box(b"ftyp", brand + bytes(4)) + rest
        assert M.sniff(b"ab" + data + b" tail")[1] == [(2, 2 + len(data), kind)]
    assert not M.sniff(box(b"ftyp", b"isom" + bytes(4)) + still)[1] and not M.sniff(box(b"ftyp", b"heic" + bytes(4)) + film)[1]
    two = box(b"ftyp", b"isom" + bytes(4)) + film
    assert [s[:2] for s in M.sniff(two + two)[1]] == [(0, len(two)), (len(two), 2 * len(two))]


def test_pdf_updates_belong_to_their_file():
    update = b"\n9 0 obj\nendobj\nstartxref\n12\n%%EOF"
    twice = PDF + update
    assert M.sniff(twice)[1] == [(0, len(twice), "application/pdf")]
    assert M.sniff(b"x" + twice + b"\n" + PDF + b"text")[1] == [(1, 1 + len(twice), "application/pdf"), (2 + len(twice), 2 + len(twice) + len(PDF), "application/pdf")]
    assert M.sniff(PDF + b" about startxref and %%EOF")[1] == [(0, len(PDF), "application/pdf")]
    assert not M.sniff(b"%PDF-1.4 startxref %%EOF")[1]


def test_repeated_hits_take_no_search_each():
    def steps(data):
        seen = []

        class Counted(M.Marks):
            def next(self, mark, start, default):
                seen.append(mark)
                return super().next(mark, start, default)

        real, M.Marks = M.Marks, Counted
        try:
            assert not M.sniff(data)[1]
        finally:
            M.Marks = real
        return len(seen)

    for hit in (b"%PDF-1.4\n", b"PK\x03\x04 text "):
        assert steps(hit * 4000) <= 2.1 * steps(hit * 2000)


def test_declared_types(spark):
    rows = [(1, MEDIA["image/png"], "image/jpeg"), (2, MEDIA["image/gif"], "image/gif"), (3, b"text", "text/plain"), (4, None, None), (5, b"", "x")]
    out = {r.id: r for r in M.sniff_column(spark.createDataFrame(rows, "id long, content binary, declared string"), "content", "declared", ["id"]).collect()}
    assert (out[1].corrected, out[1].changed) == ("image/png", True) and not out[2].changed
    assert (out[3].detected, out[3].corrected) == (None, "text/plain") and out[4].corrected is None and out[5].corrected == "x"


def test_round_trip_and_query(spark):
    for text in (b"", b"a", b"x" * 64, b"y" * 65, bytes(range(256)) * 9):
        assert M.read_png(M.store_png(text)) == text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    out = {r.doc_id: r for r in M.query(spark, "/root/testdata/sf0.001").collect()}
    assert len(out) == len(docs)
    for d in docs:
        raw = d.text.encode()
        pad = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = out[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert "detected=image/png" in r.feature
