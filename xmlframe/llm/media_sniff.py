"""Media columns: texts stored as media files, and a sniffer that trusts bytes, not declarations.

`store_as_wav` keeps bytes losslessly as the 8-bit samples of a RIFF/WAVE file. `sniff` finds magic
bytes with an Aho-Corasick automaton, asks the validator of each format to confirm structure and
length, corrects the declared type and lists embedded media with offset and length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

UNIT = 192

# Magic bytes, the distance from the file's start at which they stand, the format.
MAGIC = [
    (b"RIFF", 0, "riff"),
    (b"\x89PNG\r\n\x1a\n", 0, "png"),
    (b"\xff\xd8\xff", 0, "jpeg"),
    (b"GIF87a", 0, "gif"),
    (b"GIF89a", 0, "gif"),
    (b"BM", 0, "bmp"),
    (b"%PDF-", 0, "pdf"),
    (b"PK\x03\x04", 0, "zip"),
    (b"\x1f\x8b\x08", 0, "gzip"),
    (b"OggS", 0, "ogg"),
    (b"fLaC", 0, "flac"),
    (b"ftyp", 4, "mp4"),
]


def _u32(b: bytes, at: int, order: str = "<") -> int:
    return struct.unpack_from(order + "I", b, at)[0] if at + 4 <= len(b) else -1


class Finder:
    """Where a mark comes next. Asked for places in ascending order, it reads the bytes once for each mark."""

    def __init__(self, data: bytes):
        self.data, self.at = data, {}

    def __call__(self, mark: bytes, start: int) -> int:
        last = self.at.get(mark)
        if last is None or -1 < last < start:
            last = self.at[mark] = self.data.find(mark, start)
        return last


# Validators: type and length of what starts at a place, or None; and, where the length is only that of what is
# left, how much of it is certain.

def _riff(b: bytes, at: int, find: Finder):
    size, kind = _u32(b, at + 4), b[at + 8 : at + 12]
    end = at + 8 + size
    if size < 4 or end > len(b) or kind not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    p, seen = at + 12, set()
    while p + 8 <= end:
        seen.add(b[p : p + 4])
        p += 8 + _u32(b, p + 4) + (_u32(b, p + 4) & 1)
    if p not in (end, end + 1) or kind == b"WAVE" and not {b"fmt ", b"data"} <= seen:
        return None
    return {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}[kind], end - at


def _png(b: bytes, at: int, find: Finder):
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = _u32(b, p, ">"), b[p + 4 : p + 8]
        if p + 12 + n > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[p + 4 : p + 8 + n]) != _u32(b, p + 8 + n, ">"):
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return "image/png", p - at
    return None


def _jpeg(b: bytes, at: int, find: Finder):
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind, n = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or kind in (0x00, 0xFF):
            return None
        p += 2 + n
        if kind == 0xDA:
            end = b.find(b"\xff\xd9", p) if find(b"\xff\xd9", at) >= 0 else -1
            return None if end < 0 else ("image/jpeg", end + 2 - at)
    return None


def _gif(b: bytes, at: int, find: Finder):
    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    if at + 13 > len(b):
        return None
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return "image/gif", p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            p = blocks(p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0))
        else:
            return None
    return None


def _bmp(b: bytes, at: int, find: Finder):
    size, start = _u32(b, at + 2), _u32(b, at + 10)
    if _u32(b, at + 6) == 0 and _u32(b, at + 14) in (12, 40, 52, 56, 64, 108, 124) and 26 <= start <= size <= len(b) - at:
        return "image/bmp", size
    return None


def _pdf(b: bytes, at: int, find: Finder):
    end = find(b"%%EOF", at)
    return ("application/pdf", end + 5 - at) if end > 0 and 0 < find(b"startxref", at) < end else None


def _zip(b: bytes, at: int, find: Finder):
    end = find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, start = struct.unpack_from("<II", b, end + 12)
    return ("application/zip", end + 22 + struct.unpack_from("<H", b, end + 20)[0] - at) if at + start + size == end else None


def _gzip(b: bytes, at: int, find: Finder):
    if at + 10 > len(b) or b[at + 3] & 0xE0 or b[at + 3] & 0x18 and find(b"\0", at) < 0:
        return None  # a reserved flag, or a name or comment that nothing ends
    d, p, step = zlib.decompressobj(31), at, 256  # most places fail in their first bytes
    try:
        while p < len(b) and not d.eof:
            d.decompress(b[p : p + step])
            p, step = p + step, min(2 * step, 65536)
    except zlib.error:
        return None
    return ("application/gzip", min(p, len(b)) - len(d.unused_data) - at) if d.eof else None


def _ogg(b: bytes, at: int, find: Finder):
    p = at
    while b[p : p + 4] == b"OggS" and p + 27 <= len(b) and b[p + 4] == 0:
        n = b[p + 26]
        p += 27 + n + sum(b[p + 27 : p + 27 + n])
    return ("audio/ogg", p - at) if at < p <= len(b) else None


def _flac(b: bytes, at: int, find: Finder):
    p, first = at + 4, True
    while p + 4 <= len(b):
        kind, n = b[p] & 0x7F, int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (kind, n) != (0, 34) or p + 4 + n > len(b):
            return None
        last, p, first = b[p] >> 7, p + 4 + n, False
        if last:
            return "audio/flac", len(b) - at, p - at  # frames carry no total; they may run to the end
    return None


def _mp4(b: bytes, at: int, find: Finder):
    p = at
    while p + 8 <= len(b) and b[p + 4 : p + 8].isalnum():
        n = _u32(b, p, ">")
        if n < 8 or p + n > len(b):
            break
        p += n
    return ("video/mp4", p - at) if p > at else None


VALIDATORS: dict[str, Callable] = {"riff": _riff, "png": _png, "jpeg": _jpeg, "gif": _gif, "bmp": _bmp, "pdf": _pdf, "zip": _zip, "gzip": _gzip, "ogg": _ogg, "flac": _flac, "mp4": _mp4}
_automaton = None


def automaton():
    """The automaton over all magic bytes, built once in each worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for magic, ahead, kind in MAGIC:
            _automaton.add_word(magic.decode("latin-1"), (len(magic) - 1 + ahead, kind))
        _automaton.make_automaton()
    return _automaton


def sniff_bytes(data: bytes) -> tuple[str | None, int, list[tuple[str, int, int]]]:
    """Type and length of the media that starts the bytes (None, 0 if none does), and what is embedded
    behind or in it as (type, offset, length): leftmost first, none inside another embedded one."""
    top, length, embedded, free, find = None, 0, [], 1, Finder(data)
    hits = [(end - back, kind) for end, (back, kind) in automaton().iter(data.decode("latin-1"))]
    for at, kind in sorted(hits):
        if at < 0 or at and at < free:
            continue
        if found := VALIDATORS[kind](data, at, find):
            if at == 0:
                top, length = found[:2]
            else:
                embedded.append((found[0], at, found[1]))
                free = at + found[-1]
    return top, length, embedded


DECLARED = "application/octet-stream"
EMBEDDED = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
SNIFFED = "media_type string, media_length long, corrected boolean, embedded array<struct<type:string,offset:long,length:long>>"


def sniff(df: DataFrame, data: str = "media", declared: str | None = None) -> DataFrame:
    """Add media_type (null: unknown), media_length, corrected (the declared type was another) and
    embedded to df. Null bytes give nulls and an empty list. The input's columns stay, but those with the names
    of the added ones give way."""
    df = df.drop("media_type", "media_length", "corrected", "embedded")
    names = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, data):
            found = [sniff_bytes(b) if b is not None else (None, None, []) for b in part.column(names.index(data)).to_pylist()]
            said = part.column(names.index(declared)).to_pylist() if declared else [None] * len(found)
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns,
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.int64()),
                    pa.array([x[0] is not None and s is not None and s != x[0] for x, s in zip(found, said, strict=True)], pa.bool_()),
                    pa.array([[{"type": t, "offset": o, "length": n} for t, o, n in x[2]] for x in found], EMBEDDED),
                ],
                [*names, "media_type", "media_length", "corrected", "embedded"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(work, f"{schema}, {SNIFFED}")


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """A RIFF/WAVE file of 8-bit mono samples."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * (len(samples) & 1)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def wav_samples(media: bytes) -> bytes:
    """The samples of the first data chunk."""
    p = 12
    while media[p : p + 4] != b"data":
        p += 8 + _u32(media, p + 4) + (_u32(media, p + 4) & 1)
    return media[p + 8 : p + 8 + _u32(media, p + 4)]


def padded(raw: bytes) -> bytes:
    """Bytes with byte 32 behind them up to a positive multiple of UNIT."""
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def store_as_wav(docs: DataFrame, id_column: str = "doc_id", text: str = "text", declared: str = DECLARED) -> DataFrame:
    """(id, n_bytes, declared, media): the text's UTF-8 (null: none), padded with byte 32 to a positive
    multiple of 192, as the samples of a WAV file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            raw = [b or b"" for b in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array([declared] * len(raw)), pa.array([wav(padded(b)) for b in raw], pa.binary())],
                [id_column, "n_bytes", "declared", "media"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text).alias("text")).mapInArrow(work, f"{id_column} {kind}, n_bytes long, declared string, media binary")


def media_features(stored: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Digests and features of stored media whose type `sniff` confirmed as audio/wav. The feature is
    the type, the number of samples, their mean, mean absolute step and the number of embedded media."""
    columns = [id_column, "n_bytes", "media", "media_type", "media_length", "embedded"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media"):
            out = [features_of(*row) for row in zip(*(c.to_pylist() for c in part.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *_feature_arrays(out)], [id_column, "n_bytes", *[name for name, _ in FEATURES]])

    kind = stored.schema[id_column].dataType.simpleString()
    return stored.select(*columns).mapInArrow(work, f"{id_column} {kind}, n_bytes long, {FEATURE_TYPES}")


FEATURES = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
FEATURE_TYPES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features_of(media: bytes, kind: str | None, length: int | None, embedded: list) -> tuple:
    """The values of FEATURES of stored bytes, read back from them."""
    if kind != "audio/wav" or length != len(media):
        raise ValueError(f"stored bytes are {kind} of {length} bytes, not a whole WAV file of {len(media)}")
    payload = wav_samples(media)
    x = np.frombuffer(payload, np.uint8)
    step = np.abs(np.diff(x.astype(np.int16))).mean() if len(x) > 1 else 0.0
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{kind} samples={len(x)} mean={x.mean():.4f} step={step:.4f} embedded={len(embedded)}"


def _feature_arrays(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(FEATURES)]


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every whole text as media, sniff the stored bytes, read them back: (doc_id, n_bytes, FEATURES,
    media_type, corrected, embedded), corrected because the stored bytes are declared as a mere octet stream. What
    `store_as_wav`, `sniff` and `media_features` do, in one map step. Empty and null texts give one unit of spaces;
    equal texts give equal values; columns of docs other than doc_id and text are not looked at."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out, sizes, found = [], [], []
            for raw in part.column(1).cast(pa.binary()).to_pylist():
                media = wav(padded(raw or b""))
                kind, length, embedded = sniff_bytes(media)
                sizes.append(len(raw or b""))
                found.append((kind, embedded))
                out.append(features_of(media, kind, length, embedded))
            more = [pa.array([k for k, _ in found], pa.string()), pa.array([k is not None and k != DECLARED for k, _ in found], pa.bool_()), pa.array([[{"type": t, "offset": o, "length": n} for t, o, n in e] for _, e in found], EMBEDDED)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), *_feature_arrays(out), *more], ["doc_id", "n_bytes", *[name for name, _ in FEATURES], "media_type", "corrected", "embedded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_bytes long, {FEATURE_TYPES}, media_type string, corrected boolean, embedded array<struct<type:string,offset:long,length:long>>")
