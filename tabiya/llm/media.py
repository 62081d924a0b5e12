"""Media columns: what bytes are, by signature sniffing, and media that they hold inside.

An Aho-Corasick automaton finds all magic bytes in one pass. At each hit the format's validator walks the structure - chunks,
boxes, pages, checksums, length fields - and gives the length that the structure covers, or refuses. A value's type is the valid
format that begins at its first byte (if any); a declared type is corrected to it. Valid media at other places, outside ones already
found, are carved: type, offset, length.

The query stores each text's bytes, padded with zeros to a positive multiple of 64, as 8-bit mono samples of a WAVE file in a
table of the shared folder, and computes its columns from the stored files, read back through the same sniffer.

Null and empty values hold nothing: type `application/octet-stream`, nothing carved; as a text, null counts as '' and
gives 64 zero samples. Equal values give equal results. Extra columns stay; an operator's own column replaces one of its name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabiya.llm.common import cut, scoped, slices, strings, table, text_slices, tidy

UNKNOWN = "application/octet-stream"
BLOCK, RATE = 64, 8000


def _png(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        end = p + 12 + n
        if end > len(b) or (first and (kind != b"IHDR" or n != 13)) or not kind.isalpha():
            return 0
        if zlib.crc32(memoryview(b)[p + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return 0
        if kind == b"IEND":
            return end - at
        p, first = end, False
    return 0


def _gif_blocks(b: bytes, p: int) -> int:
    while p < len(b):
        if b[p] == 0:
            return p + 1
        p += b[p] + 1
    return 0


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)
    while p and p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = _gif_blocks(b, p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            flags = b[p + 9]
            p = _gif_blocks(b, p + 11 + (3 << ((flags & 7) + 1) if flags & 128 else 0))
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind == 0xD9:
            return p + 2 - at
        if kind == 0xFF:
            p += 1
            continue
        if kind == 1 or 0xD0 <= kind <= 0xD8:
            p += 2
            continue
        n = struct.unpack_from(">H", b, p + 2)[0]
        p += 2 + n
        if n < 2:
            return 0
        if kind == 0xDA:  # coded data up to the next marker that isn't a restart
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return 0
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
    return p + 2 - at if b[p : p + 2] == b"\xff\xd9" else 0


def _bmp(b: bytes, at: int) -> int:
    if at + 26 > len(b):
        return 0
    size, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    ok = zero == 0 and head in (12, 40, 52, 56, 64, 108, 124) and 14 + head <= start <= size <= len(b) - at
    return size if ok else 0


def _riff(form: bytes, first: bytes) -> Callable[[bytes, int], int]:
    def walk(b: bytes, at: int) -> int:
        if at + 20 > len(b) or b[at + 8 : at + 12] != form or not b[at + 12 : at + 16].startswith(first):
            return 0
        size = struct.unpack_from("<I", b, at + 4)[0]
        end, p = at + 8 + size, at + 12
        if end > len(b):
            return 0
        while p + 8 <= end:
            n = struct.unpack_from("<I", b, p + 4)[0]
            p += 8 + n + (n & 1)
        return 8 + size if p in (end, end + 1) else 0

    return walk


_OGG = []
for _i in range(256):
    _r = _i << 24
    for _ in range(8):
        _r = (_r << 1 ^ 0x04C11DB7 if _r >> 31 else _r << 1) & 0xFFFFFFFF
    _OGG.append(_r)


def _ogg(b: bytes, at: int) -> int:
    p, serial = at, None
    while p + 27 <= len(b) and b[p : p + 5] == b"OggS\0":
        n = b[p + 26]
        end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        own = b[p + 14 : p + 18]
        if end > len(b) or (serial is not None and own != serial and not b[p + 5] & 2):
            break
        crc = 0
        for x in b[p : p + 22] + b"\0\0\0\0" + b[p + 26 : end]:
            crc = (crc << 8 & 0xFFFFFFFF) ^ _OGG[crc >> 24 ^ x]
        if crc != struct.unpack_from("<I", b, p + 22)[0]:
            break
        p, serial = end, own
    return p - at


def _flac(b: bytes, at: int) -> int:
    p, first = at + 4, True
    while p + 4 <= len(b):
        kind, n = b[p], int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (kind & 127 or n != 34):
            return 0
        p, first = p + 4 + n, False
        if kind & 128:  # frames have no length: the stream takes the rest
            return len(b) - at if p <= len(b) and (p == len(b) or b[p : p + 2] in (b"\xff\xf8", b"\xff\xf9")) else 0
    return 0


def _pdf(b: bytes, at: int) -> int:
    if not (b[at + 5 : at + 6].isdigit() and b[at + 6 : at + 7] == b"." and b[at + 7 : at + 8].isdigit()):
        return 0
    following = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, following if following > 0 else len(b))
    return end + 5 - at if end > 0 and b.find(b"startxref", at, end) > 0 else 0


def _gzip(b: bytes, at: int) -> int:
    unpack = zlib.decompressobj(31)
    try:
        for p in range(at, len(b), 1 << 16):
            unpack.decompress(b[p : p + (1 << 16)])
            if unpack.eof:
                return min(p + (1 << 16), len(b)) - len(unpack.unused_data) - at
    except zlib.error:
        return 0
    return 0


def _zip(b: bytes, at: int) -> int:
    p = b.find(b"PK\5\6", at)
    while p >= 0:
        if p + 22 <= len(b):
            size, start, note = struct.unpack_from("<IIH", b, p + 12)
            if start + size == p - at and (size == 0 or b[at + start : at + start + 4] == b"PK\1\2") and p + 22 + note <= len(b):
                return p + 22 + note - at
        p = b.find(b"PK\5\6", p + 4)
    return 0


def _mp4(b: bytes, at: int) -> int:
    p = start = at - 4
    if start < 0:
        return 0
    seen = set()
    while p + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        head = 8
        if n == 1 and p + 16 <= len(b):
            n, head = struct.unpack_from(">Q", b, p + 8)[0], 16
        if n < head or p + n > len(b) or not all(32 <= x < 127 for x in kind):
            break
        seen.add(kind)
        p += n
    return p - start if {b"ftyp", b"moov"} <= seen else 0


def _tiff(order: str) -> Callable[[bytes, int], int]:
    def walk(b: bytes, at: int) -> int:
        if at + 8 > len(b):
            return 0
        p, end, seen = struct.unpack_from(order + "I", b, at + 4)[0], 8, set()
        if not p:
            return 0
        while p:
            if p in seen or at + p + 2 > len(b):
                return 0
            seen.add(p)
            n = struct.unpack_from(order + "H", b, at + p)[0]
            if not n or at + p + 6 + 12 * n > len(b):
                return 0
            found: dict[int, list[int]] = {}
            for k in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", b, at + p + 2 + 12 * k)
                size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}.get(kind, 0) * count
                where = p + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", b, at + p + 10 + 12 * k)[0]
                if not size or at + where + size > len(b):
                    return 0
                end = max(end, where + size)
                if tag in (273, 279) and kind in (3, 4):
                    found[tag] = list(struct.unpack_from(order + ("H" if kind == 3 else "I") * 1 * count, b, at + where))
            end = max([end, p + 6 + 12 * n, *(x + y for x, y in zip(found.get(273, []), found.get(279, []), strict=False))])
            p = struct.unpack_from(order + "I", b, at + p + 2 + 12 * n)[0]
        return end if at + end <= len(b) else 0

    return walk


# Fixed values of the formats: type, magic bytes, how far into the file they stand, and the validator.
FORMATS = (
    ("image/png", b"\x89PNG\r\n\x1a\n", 0, _png),
    ("image/gif", b"GIF87a", 0, _gif),
    ("image/gif", b"GIF89a", 0, _gif),
    ("image/jpeg", b"\xff\xd8\xff", 0, _jpeg),
    ("image/bmp", b"BM", 0, _bmp),
    ("image/webp", b"RIFF", 0, _riff(b"WEBP", b"VP8")),
    ("audio/wav", b"RIFF", 0, _riff(b"WAVE", b"fmt ")),
    ("audio/ogg", b"OggS", 0, _ogg),
    ("audio/flac", b"fLaC", 0, _flac),
    ("application/pdf", b"%PDF-", 0, _pdf),
    ("application/gzip", b"\x1f\x8b\x08", 0, _gzip),
    ("application/zip", b"PK\x03\x04", 0, _zip),
    ("video/mp4", b"ftyp", 4, _mp4),
    ("image/tiff", b"II*\0", 0, _tiff("<")),
    ("image/tiff", b"MM\0*", 0, _tiff(">")),
)
_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        by_magic: dict[bytes, list[int]] = {}
        for k, (_, magic, _, _) in enumerate(FORMATS):
            by_magic.setdefault(magic, []).append(k)
        _AUTOMATON = ahocorasick.Automaton()
        for magic, which in by_magic.items():
            _AUTOMATON.add_word(magic.decode("latin-1"), (len(magic), which))
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def sniff(value: bytes) -> tuple[str, int, list[tuple[str, int, int]]]:
    """The value's type and the length its structure covers, and (type, offset, length) of other media inside.

    Inside a container of stored samples or files, embedded media are looked for as well; media inside carved ones aren't.
    """
    kind, covered, carved, free = UNKNOWN, 0, [], 0
    for end, (size, which) in _automaton().iter(value.decode("latin-1")):
        for k in which:
            name, _, before, valid = FORMATS[k]
            start = end + 1 - size - before
            if start < free or (start == 0 and covered):
                continue
            length = valid(value, end + 1 - size)
            if not length:
                continue
            if start == 0:
                kind, covered = name, length
            else:
                carved.append((name, start, length))
                free = start + length
            break
    return kind, covered, carved


_FOUND = pa.struct([("media_type", pa.string()), ("media_length", pa.int64()), ("carved", pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))])


def sniff_column(df: DataFrame, column: str, declared: str | None = None) -> DataFrame:
    """df with media_type, media_length, carved and, for a declared type, corrected (whether it was another)."""
    own = ["media_type", "media_length", "carved", "corrected"]
    df = df.drop(*[c for c in own if c != declared])
    names = df.columns

    def run(batches):
        for batch in batches:
            found = []
            for x in batch.column(column):
                kind, length, carved = sniff(x.as_py() or b"")
                found.append({"media_type": kind, "media_length": length, "carved": [dict(zip(("type", "offset", "length"), c, strict=True)) for c in carved]})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, _FOUND)], [*names, "_found"])

    kinds = "struct<media_type: string, media_length: long, carved: array<struct<type: string, offset: long, length: long>>>"
    out = df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, T.StructField("_found", T._parse_datatype_string(kinds))]))
    extra = [] if declared is None else [(~F.col(declared).eqNullSafe(F.col("_found.media_type"))).alias("corrected")]
    return out.select(*names, "_found.*", *extra)


def wave(payload: bytes) -> bytes:
    """8-bit mono samples as a WAVE file."""
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def samples(media: bytes) -> bytes:
    """The samples of a WAVE file; ValueError if it isn't one of 8-bit mono samples."""
    if not _riff(b"WAVE", b"fmt ")(media, 0):
        raise ValueError("not a WAVE file")
    p = 12
    while p + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, p)
        if kind == b"fmt " and struct.unpack_from("<HH", media, p + 8) + struct.unpack_from("<H", media, p + 22) != (1, 1, 8):
            raise ValueError("not 8-bit mono samples")
        if kind == b"data":
            return media[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no samples")


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a WAVE file of the padded UTF-8 bytes) of each text."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                raw = [x.encode("utf-8", "surrogatepass") for x in strings(part.column("text"))]
                media = [wave(x + b"\0" * (-len(x) % BLOCK or (BLOCK if not x else 0))) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary")


def media_digests(stored: DataFrame) -> DataFrame:
    """The stored files' digests and features, from the files alone."""

    def run(batches):
        for batch in batches:
            column = batch.column("media")
            for lo, hi in slices(np.array([len(x.as_buffer()) for x in column], np.int64)):
                rows = []
                for x in column.slice(lo, hi - lo).to_pylist():
                    kind, length, carved = sniff(x)
                    payload = samples(x)
                    level = np.frombuffer(payload, np.uint8).astype(np.int64)
                    inside = ",".join(f"{t}@{at}+{n}" for t, at, n in carved) or "none"
                    feature = f"{kind};length={length};rate={RATE};bits=8;samples={len(payload)};sum={int(level.sum())};steps={int(np.abs(np.diff(level)).sum())};inside={inside}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(x), hashlib.sha256(x).hexdigest(), feature))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return stored.mapInArrow(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


@scoped
def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(cut(store_texts(table(spark, sf_dir, "documents")), 2))
