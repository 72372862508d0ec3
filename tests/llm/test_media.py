import gzip
import hashlib
import io
import struct
import zipfile
import zlib

from llm.media import Sniffer, sniff, text_media_features, wav_of, wav_samples


def png(body=b"\0\0\0\0\0"):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0\xff\xc0\0\x0b\x08\0\x01\0\x01\x01\x01\x11\0\xff\xda\0\x08\x01\x01\0\0\x3f\0\xab\xff\0\xcd\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
OGG = b"OggS\0\x06" + b"\0" * 20 + b"\x01\x05hello"
FLAC = b"fLaC\x80\0\0\x22" + b"\0" * 34 + b"\xff\xf8rest"
MP4 = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 8, b"moov") + struct.pack(">I4s", 12, b"mdat") + b"abcd"


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "text")
    return out.getvalue()


ALL = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "audio/wav": wav_of(b"abc"), "application/gzip": gzip.compress(b"x" * 99), "application/zip": zipped(), "application/pdf": PDF, "application/ogg": OGG, "audio/flac": FLAC, "video/mp4": MP4}


def test_each_format_alone_and_embedded():
    sniffer = Sniffer()
    for kind, body in ALL.items():
        assert (0, len(body), kind) in sniffer(body), kind
        if kind != "audio/flac":  # runs to the end of the payload
            assert (7, len(body), kind) in sniffer(b"padding" + body + b"tail"), kind


def test_broken_objects_are_rejected():
    sniffer = Sniffer()
    for kind, body in ALL.items():
        if kind not in ("audio/flac", "application/pdf"):
            assert sniffer(body[:-1]) == [], kind
    bad = bytearray(png())
    bad[20] ^= 1
    assert sniffer(bytes(bad)) == []
    for text in (b"BM is a word, GIF89a too, %PDF-1.4 and RIFF....WAVE", b"PK\x03\x04", b"\x1f\x8b\x08", b"ftyp", b""):
        assert sniffer(text) == []


def test_correction_and_carving(spark):
    holder = b"HEAD" + png() + b"xx" + GIF
    rows = [(1, holder, "image/png"), (2, png(), "image/jpeg"), (3, png(), "image/png"), (4, None, "image/gif"), (5, b"", None), (6, b"text", "text/plain"), (6, b"text", "text/plain")]
    df = spark.createDataFrame(rows, "id int, media binary, declared string")
    got = sorted(sniff(df, "media", "declared").collect(), key=lambda r: r.id)
    assert [(r.media_type, r.corrected) for r in got] == [("application/octet-stream", True), ("image/png", True), ("image/png", False), ("image/gif", False), (None, False), ("text/plain", False), ("text/plain", False)]
    assert [(c.start, c.type, bytes(c.body)) for c in got[0].carved] == [(4, "image/png", png()), (4 + len(png()) + 2, "image/gif", GIF)]
    assert sniff(df.limit(0)).count() == 0


def test_texts_come_back(spark):
    schema = "text string, doc_id long, feature int, id string"
    rows = [("", 1, 0, ""), (None, 2, 0, ""), ("é" * 96, 3, 0, ""), ("a" * 193, 4, 0, ""), ("RIFF " * 50_000, None, 0, ""), ("", 1, 0, "")]
    df = spark.createDataFrame(rows, schema)
    got = text_media_features(df).collect()
    assert len(got) == len(rows)
    for (text, doc, *_), r in zip(rows, got):
        raw = (text or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (doc, len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        media = wav_of(payload)
        assert r.media_sha256 == hashlib.sha256(media).hexdigest() and r.media_bytes == len(media) and wav_samples(media) == payload
    assert text_media_features(df.limit(0)).count() == 0


def test_feature_by_naive_search(spark):
    from llm.media import RIFF_KINDS, SIGNATURES, VALIDATORS

    inner = "BM and GIF89a and %PDF-1.4 x startxref 9 %%EOF and PK\x03\x04, ftyp; OggS " * 3 + "%PDF-1.7\nstartxref\n%%EOF"
    rows = [(1, inner), (2, "plain"), (3, zipped().decode("latin-1")), (4, "")]
    got = {r.doc_id: r.feature for r in text_media_features(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, text in rows:
        raw = text.encode()
        media = wav_of(raw.ljust(max(192, -(-len(raw) // 192) * 192)))
        found = set()
        for magic, place, kind in SIGNATURES:
            for at in range(len(media)):
                if at - place >= 0 and media[at : at + len(magic)] == magic and (n := VALIDATORS[kind](memoryview(media), at - place)):
                    found.add((at - place, -n, RIFF_KINDS[media[at + 8 : at + 12]] if kind == "riff" else kind))
        assert got[doc] == ";".join(f"{k}@{s}+{-n}" for s, n, k in sorted(found))
    assert "application/pdf" in got[1] and got[2] == "audio/wav@0+236"


def test_many_headers_in_one_payload_are_cheap():
    import time

    start = time.perf_counter()
    assert Sniffer()(b"PK\x03\x04 %PDF- " * 100_000) == []
    assert Sniffer()(b"xx" + zipped() + zipped())[:2] == [(2, len(zipped()), "application/zip"), (2 + len(zipped()), len(zipped()), "application/zip")]
    assert time.perf_counter() - start < 20


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, png(), 5, "old")], "row int, media binary, __seen int, media_type string")
    got = sniff(df).first()
    assert (got.row, got["__seen"], got.media_type) == (1, 5, "image/png")
