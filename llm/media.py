"""Media columns: what bytes really are, by signatures and structure.

An Aho-Corasick automaton finds every magic byte string of a payload in one
pass.  Where a format's magic stands at its place, a validator reads the
structure and says how long the object is, or rejects it.  From the confirmed
objects the operator corrects the declared type and carves what is embedded.
Bytes are searched as Latin-1 text, which maps each byte to one character.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Magic bytes, their place in the object, and the media type.
SIGNATURES = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"BM", 0, "image/bmp"),
    (b"RIFF", 0, "riff"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"%PDF-", 0, "application/pdf"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "application/ogg"),
    (b"ftyp", 4, "video/mp4"),
)
RIFF_KINDS = {b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}


def _png(b: memoryview, at: int) -> int:
    """Chunks with right checksums, IHDR first, up to IEND."""
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or first and (kind != b"IHDR" or n != 13):
            return 0
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return 0


def _gif(b: memoryview, at: int) -> int:
    """Screen descriptor, then blocks up to the trailer."""
    if at + 13 > len(b):
        return 0

    def colours(flags: int) -> int:
        return 3 << (flags & 7) + 1 if flags & 128 else 0

    def sub_blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    p, images = at + 13 + colours(b[at + 10]), 0
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at if images else 0
        if b[p] == 0x21 and p + 2 <= len(b):
            p = sub_blocks(p + 2)
        elif b[p] == 0x2C and p + 11 <= len(b):
            p, images = sub_blocks(p + 11 + colours(b[p + 9])), images + 1
        else:
            return 0
    return 0


def _jpeg(b: memoryview, at: int) -> int:
    """Marker segments with sound lengths, a frame, a scan, and the end marker."""
    p, frame, scan = at + 2, False, False
    while p + 2 <= len(b):
        if b[p] != 0xFF:
            if not scan:
                return 0
            p += 1
            continue
        kind = b[p + 1]
        if kind == 0xD9:
            return p + 2 - at if frame and scan else 0
        if kind in (0x00, 0xFF) or 0xD0 <= kind <= 0xD7:
            if not scan:
                return 0
            p += 1 if kind == 0xFF else 2
            continue
        if p + 4 > len(b):
            return 0
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or p + 2 + n > len(b):
            return 0
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        scan = kind == 0xDA if not scan else True
        p += 2 + n
    return 0


def _bmp(b: memoryview, at: int) -> int:
    """File and info headers that agree about size, offset and planes."""
    if at + 30 > len(b):
        return 0
    size, reserved, offset, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    sound = not reserved and header in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and width > 0 and height and 14 + header <= offset <= size
    return size if sound and at + size <= len(b) else 0


def _riff(b: memoryview, at: int) -> int:
    """Chunks that fill the declared size exactly, each padded to even length."""
    if at + 12 > len(b):
        return 0
    size, kind = struct.unpack_from("<I4s", b, at + 4)
    end = at + 8 + size
    if kind not in RIFF_KINDS or end > len(b):
        return 0
    p, names = at + 12, []
    while p + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, p)
        names.append(name)
        p += 8 + n + (n & 1)
    whole = p == end and (kind != b"WAVE" or names[:1] == [b"fmt "] and b"data" in names)
    return end - at if whole else 0


def _gzip(b: memoryview, at: int) -> int:
    """Inflates to the end with checksum and length in order."""
    d, rest = zlib.decompressobj(31), b[at:]
    try:
        while len(rest) and not d.eof:  # what it holds is not kept
            d.decompress(rest, 1 << 20)
            rest = d.unconsumed_tail
    except zlib.error:
        return 0
    return len(b) - at - len(d.unused_data) if d.eof else 0


def zip_archives(b: memoryview) -> dict[int, int]:
    """Start and length of archives: an end record says where its directory and its first entry lie."""
    raw, found = b.obj if isinstance(b.obj, bytes) else bytes(b), {}
    end = raw.find(b"PK\x05\x06")
    while end >= 0 and end + 22 <= len(b):
        entries, size, offset, comment = struct.unpack_from("<HIIH", b, end + 10)
        start, directory = end - size - offset, end - size
        if start >= 0 and raw[directory : directory + 4] in (b"PK\x01\x02", b"PK\x05\x06") and end + 22 + comment <= len(b):
            found.setdefault(start, end + 22 + comment - start if entries else 0)
        end = raw.find(b"PK\x05\x06", end + 4)
    return found


def _zip(b: memoryview, at: int) -> int:
    """Local headers up to a central directory whose end record points back to them."""
    return zip_archives(b).get(at, 0)


def _pdf(b: memoryview, at: int) -> int:
    """A version, a cross-reference pointer and the end marker before any other file starts."""
    raw = b.obj if isinstance(b.obj, bytes) else bytes(b)
    if not re.match(rb"%PDF-[12]\.\d", raw[at : at + 8]):
        return 0
    stop = raw.find(b"%PDF-", at + 5)
    end = raw.rfind(b"%%EOF", at, len(raw) if stop < 0 else stop)
    return end + 5 - at if end > 0 and raw.find(b"startxref", at, end) > 0 else 0


def _flac(b: memoryview, at: int) -> int:
    """STREAMINFO first and metadata blocks that lead to a frame; frames run to the end."""
    p, first = at + 4, True
    while p + 4 <= len(b):
        head = struct.unpack_from(">I", b, p)[0]
        kind, n, last = head >> 24 & 127, head & 0xFFFFFF, head >> 31
        if first and (kind or n != 34) or kind > 6 or p + 4 + n > len(b):
            return 0
        p, first = p + 4 + n, False
        if last:
            return len(b) - at if p + 2 <= len(b) and b[p] == 0xFF and b[p + 1] & 0xFE == 0xF8 else 0
    return 0


def _ogg(b: memoryview, at: int) -> int:
    """Pages one after the other, from a first page to a last one."""
    p, begun = at, False
    while p + 27 <= len(b) and bytes(b[p : p + 5]) == b"OggS\0":
        flags, n = b[p + 5], b[p + 26]
        if p + 27 + n > len(b) or not begun and not flags & 2:
            return 0
        p, begun = p + 27 + n + sum(b[p + 27 : p + 27 + n]), True
        if p > len(b):
            return 0
        if flags & 4:
            return p - at
    return 0


def _mp4(b: memoryview, at: int) -> int:
    """Boxes of known names, ftyp first, with a moov among them."""
    p, names = at, []
    while p + 8 <= len(b):
        n, name = struct.unpack_from(">I4s", b, p)
        if n == 1 and p + 16 <= len(b):
            n = struct.unpack_from(">Q", b, p + 8)[0]
        if name not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"uuid", b"moof", b"mfra", b"meta", b"sidx", b"styp"):
            break
        if n < 8 or p + n > len(b):
            return 0
        names.append(name)
        p += n
    return p - at if names[:1] == [b"ftyp"] and b"moov" in names else 0


VALIDATORS: dict[str, Callable[[memoryview, int], int]] = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "riff": _riff, "application/gzip": _gzip,
    "application/zip": _zip, "application/pdf": _pdf, "audio/flac": _flac, "application/ogg": _ogg, "video/mp4": _mp4,
}


class Sniffer:
    """Finds confirmed media objects as (start, length, type), outermost first."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, (magic, place, kind) in enumerate(SIGNATURES):
            self.automaton.add_word(magic.decode("latin-1"), (i, len(magic) - 1 + place, kind))
        self.automaton.make_automaton()

    def __call__(self, payload: bytes) -> list[tuple[int, int, str]]:
        view, found, tried, archives = memoryview(payload), [], set(), None
        for end, (_, back, kind) in self.automaton.iter(payload.decode("latin-1")):
            at = end - back
            if at < 0 or (at, kind) in tried:
                continue
            tried.add((at, kind))
            if kind == "application/zip":  # looked up, so that many headers cost no more than one
                archives = zip_archives(view) if archives is None else archives
                length = archives.get(at, 0)
            else:
                length = VALIDATORS[kind](view, at)
            if length:
                name = RIFF_KINDS[bytes(view[at + 8 : at + 12])] if kind == "riff" else kind
                found.append((at, length, name))
        return sorted(found, key=lambda f: (f[0], -f[1], f[2]))


def true_type(found: list[tuple[int, int, str]], declared: str | None) -> str:
    """The type of the object at the start; else the declared one if it is no media type known here; else binary."""
    if found and found[0][0] == 0:
        return found[0][2]
    known = {k for _, _, k in SIGNATURES} | set(RIFF_KINDS.values())
    return declared if declared and declared not in known else "application/octet-stream"


def sniff(media: DataFrame, media_col: str = "media", declared_col: str | None = None) -> DataFrame:
    """Adds ``media_type``, ``corrected`` and ``carved`` to every row of ``media``.

    ``media_type`` is what the bytes show, ``corrected`` whether it differs from
    the declared type, ``carved`` the confirmed objects (start, length, type,
    bytes) in the order of their starts.  Null and empty payloads have no
    object and keep their declared type.  Columns of these names are replaced.
    """
    schema = "media_type string, corrected boolean, carved array<struct<start:bigint,length:bigint,type:string,body:binary>>"

    @F.pandas_udf(schema)
    def look(bodies, declared):
        import pandas as pd

        sniffer, rows = Sniffer(), []
        for body, told in zip(bodies, declared):
            body = body or b""
            found = sniffer(body)
            kind = true_type(found, told) if body else told
            rows.append((kind, kind != told, [{"start": s, "length": n, "type": k, "body": body[s : s + n]} for s, n, k in found]))
        return pd.DataFrame(rows, columns=["media_type", "corrected", "carved"])

    declared = F.col(declared_col) if declared_col else F.lit(None).cast("string")
    added = ("media_type", "corrected", "carved")
    seen = media.select(F.struct(*[F.col(f"`{c}`") for c in media.columns]).alias("row"), look(F.col(media_col), declared).alias("seen"))
    return seen.select(*[F.col(f"row.`{c}`") for c in media.columns if c not in added], *[F.col(f"seen.{c}") for c in added])


def wav_of(samples: bytes, rate: int = 8000) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    pad = len(samples) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * pad


def wav_samples(media: bytes) -> bytes:
    """The data chunk of a WAV file."""
    p = 12
    while p + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, p)
        if name == b"data":
            return media[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def padded(text: str | None, multiple: int = 192) -> tuple[int, bytes]:
    """UTF-8 length and the bytes with spaces up to a positive multiple."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw.ljust(max(multiple, -(-len(raw) // multiple) * multiple), b" ")


def text_media_features(docs: DataFrame, multiple: int = 192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a WAV payload, sniffs and carves it again, and describes what came back.

    The media column exists within the Arrow batch only: the stored bytes go to
    the sniffer with a wrong declared type, the carved object is read back, and
    its digests are returned.  ``feature`` is the sniffed type, start and length
    of each confirmed object, joined by ``;``, the first being the whole file.
    Null and empty texts are one block of spaces.  Equal texts give equal rows.
    """

    def features(batches):
        sniffer = Sniffer()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                n, payload = padded(text, multiple)
                media = wav_of(payload)
                found = sniffer(media)
                if true_type(found, "image/bmp") != "audio/wav":
                    raise ValueError("a stored payload was not recognised")
                start, length, _ = found[0]
                back = wav_samples(media[start : start + length])
                feature = ";".join(f"{k}@{s}+{m}" for s, m, k in found)
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["id", *names])

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return rows.mapInArrow(features, schema).withColumnRenamed("id", id_col)
