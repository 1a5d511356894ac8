"""Media columns: what bytes really are, found by their signatures and confirmed by their structure.

An Aho-Corasick automaton finds the magic bytes of all formats in one walk; a validator of the format then
reads its structure from there and says how long the medium is. What starts at 0 corrects the declared
type, what starts later is carved out as embedded media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from filigree.llm.common import rows_of, through, utf8

# Each validator takes the bytes and where the medium starts, and gives its length, or 0 if it isn't one.


def _riff(b: bytes, at: int) -> int:
    if len(b) < at + 12 or b[at + 8 : at + 12] not in (b"WAVE", b"WEBP", b"AVI "):
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    pos = at + 12
    while pos + 8 <= end <= len(b):
        pos += 8 + (size := struct.unpack_from("<I", b, pos + 4)[0]) + size % 2
    return end - at if pos == end <= len(b) and end > at + 12 else 0


def _png(b: bytes, at: int) -> int:
    pos = at + 8
    while pos + 12 <= len(b):
        size = struct.unpack_from(">I", b, pos)[0]
        kind, end = b[pos + 4 : pos + 8], pos + 12 + size
        if end > len(b) or (pos == at + 8) != (kind == b"IHDR") or zlib.crc32(b[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return 0
        if kind == b"IEND":
            return end - at
        pos = end
    return 0


def _gif(b: bytes, at: int) -> int:
    if len(b) < at + 13:
        return 0
    flags = b[at + 10]
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1 - at
        if b[pos] == 0x2C and pos + 10 < len(b):
            pos += 11 + (3 << ((b[pos + 9] & 7) + 1) if b[pos + 9] & 0x80 else 0)
        elif b[pos] == 0x21:
            pos += 2
        else:
            return 0
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        pos += 1
    return 0


def _jpeg(b: bytes, at: int) -> int:
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        mark = b[pos + 1]
        if mark == 0xFF:
            pos += 1
            continue
        size = struct.unpack_from(">H", b, pos + 2)[0]
        if size < 2 or not 0xC0 <= mark <= 0xFE or 0xD0 <= mark <= 0xD9:
            return 0
        pos += 2 + size
        if mark == 0xDA:  # entropy-coded data: up to a marker that is neither stuffing nor a restart
            while (pos := b.find(b"\xff", pos)) >= 0 and pos + 1 < len(b):
                if b[pos + 1] == 0xD9:
                    return pos + 2 - at
                if b[pos + 1] and not 0xD0 <= b[pos + 1] <= 0xD7 and b[pos + 1] != 0xFF:
                    break
                pos += 1 + (b[pos + 1] != 0xFF)
            if pos < 0:
                return 0
    return 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) < at + 26:
        return 0
    size, reserved, data, header = struct.unpack_from("<IIII", b, at + 2)
    return size if not reserved and header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= data <= size <= len(b) - at else 0


def _gzip(b: bytes, at: int) -> int:
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return 0
    got = zlib.decompressobj(31)
    try:
        rest = memoryview(b)[at:]
        while rest and not got.eof:  # in pieces: what it expands to is never held
            got.decompress(rest[:65536], 1 << 20)
            while got.unconsumed_tail and not got.eof:
                got.decompress(got.unconsumed_tail, 1 << 20)
            rest = rest[65536:]
    except zlib.error:
        return 0
    return len(b) - at - len(rest) - len(got.unused_data) if got.eof else 0


def _zip(b: bytes, at: int) -> int:
    end = at
    while (end := b.find(b"PK\x05\x06", end)) >= 0 and end + 22 <= len(b):
        size, start, note = struct.unpack_from("<IIH", b, end + 12)
        if start + size == end - at and end + 22 + note <= len(b) and (not size or b[at + start : at + start + 4] == b"PK\x01\x02"):
            return end + 22 + note - at
        end += 4
    return 0


def _pdf(b: bytes, at: int) -> int:
    if not b[at + 5 : at + 6].isdigit() or b[at + 6 : at + 7] != b".":
        return 0
    end = b.find(b"%%EOF", at)
    return end + 5 - at if end >= 0 and b.find(b"startxref", at, end) >= 0 else 0


#: Magic bytes, media type, validator.
FORMATS: list[tuple[bytes, str, Callable[[bytes, int], int]]] = [
    (b"RIFF", "riff", _riff),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"%PDF-", "application/pdf", _pdf),
]
RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}


def automaton() -> ahocorasick.Automaton:
    """Over the bytes as Latin-1 characters, of which one is one byte."""
    found = ahocorasick.Automaton()
    for i, (magic, _, _) in enumerate(FORMATS):
        found.add_word(magic.decode("latin-1"), (i, len(magic)))
    found.make_automaton()
    return found


def sniff(data: bytes, words: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """Confirmed media in ``data``: start, length, type, by start; those inside others are told too."""
    out = []
    for last, (i, size) in words.iter(data.decode("latin-1")):
        at = last - size + 1
        if n := FORMATS[i][2](data, at):
            out.append((at, n, RIFF_TYPES.get(data[at + 8 : at + 12], "riff") if FORMATS[i][1] == "riff" else FORMATS[i][1]))
    return sorted(out)


def with_id(df: DataFrame, column: str, ddl: str) -> StructType:
    """A schema that starts with ``column`` of ``df``, named id."""
    return StructType([StructField("id", df.schema[column].dataType), *StructType.fromDDL(ddl).fields])


IDENTIFIED = "data binary, declared string, media_type string, length long, embedded array<struct<start:long,length:long,media_type:string>>"


def _identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, data, declared to id and ``IDENTIFIED``."""
    words = automaton()
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("media_type", pa.string())]))
    for batch in rows_of(batches):
        kind, length, inside = [], [], []
        for data, declared in zip(*batch.columns[1:], strict=True):
            got = sniff(b := data.as_py(), words)
            whole = max((x for x in got if x[0] == 0), key=lambda x: x[1], default=(0, len(b), declared.as_py()))
            kind.append(whole[2])
            length.append(whole[1])
            inside.append([{"start": s, "length": n, "media_type": t} for s, n, t in got if s])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind, pa.string()), pa.array(length, pa.int64()), pa.array(inside, spans)], names=["id", "data", "declared", "media_type", "length", "embedded"])


def identify(media: DataFrame, id_col: str = "doc_id", data_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """``id, data, declared, media_type, length, embedded``: the type that the bytes prove, else what was declared.

    ``id`` may be of any type, a struct of several columns included. ``embedded`` lists start, length and type of
    media inside. Null data is empty and keeps its declared type; all columns can hold nulls, and other
    columns are left out.
    """
    d = media.select(F.col(id_col).alias("id"), F.coalesce(F.col(data_col), F.lit(b"")).alias("data"), F.col(declared_col).cast("string").alias("declared"))
    return through(d, with_id(d, "id", IDENTIFIED), _identify)


def carve(identified: DataFrame) -> DataFrame:
    """``id, start, media_type, data`` of every embedded medium that ``identify`` confirmed."""
    one = identified.select("id", "data", F.explode("embedded").alias("e"))
    cut = F.expr("substring(data, cast(e.start AS int) + 1, cast(e.length AS int))")
    return one.select("id", F.col("e.start").alias("start"), F.col("e.media_type").alias("media_type"), cut.alias("data"))


def wav_header(size: int, rate: int = 8000) -> bytes:
    """Of a canonical WAV file with one channel of unsigned 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", size)


def wav_samples(data: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    pos = 12
    while pos + 8 <= len(data):
        size = struct.unpack_from("<I", data, pos + 4)[0]
        if data[pos : pos + 4] == b"data":
            return data[pos + 8 : pos + 8 + size]
        pos += 8 + size + size % 2
    return b""


STORED = "n_bytes long, media binary, declared string"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _store(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """id, bytes to id and ``STORED``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            n, media = [], []
            for b in batch.column(1):
                b = b.as_py()
                n.append(len(b))
                size = max(block, -(-len(b) // block) * block)
                media.append(wav_header(size) + b.ljust(size, b"\0"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(["application/octet-stream"] * len(n), pa.string())], names=["id", "n_bytes", "media", "declared"])

    return run


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and ``IDENTIFIED`` to id and ``FEATURES``."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in rows_of(batches):
        out = []
        for data, kind, length, inside in zip(*(batch.column(i) for i in (1, 3, 4, 5)), strict=True):
            b = data.as_py()
            kind = kind.as_py() or ""
            got = wav_samples(b[: length.as_py()]) if kind == "audio/wav" else b
            x = np.frombuffer(got, np.uint8)
            total, n = int(x.sum(dtype=np.int64)), max(1, len(x))
            counts = np.bincount(x, minlength=256)
            square = int((counts * np.arange(256) ** 2).sum())
            up = x > total // n  # whole samples: over the mean is over its floor
            turns = int(np.count_nonzero(up[1:] != up[:-1]))
            feature = f"{kind};n={len(x)};mean={total / n:.4f};sd={max(0.0, square / n - (total / n) ** 2) ** 0.5:.4f};turns={turns};inside={len(inside)}"
            out.append((len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-64:]), len(b), hashlib.sha256(b).hexdigest(), feature))
        cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", *(x.split()[0] for x in FEATURES.split(", "))])


def text_as_wav(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 64) -> DataFrame:
    """``id, n_bytes, media, declared``: texts as 8-bit samples, padded with 0 to a positive multiple of ``block``.

    They are declared as unknown bytes, which `identify` has to correct. Null texts are empty.
    """
    d = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("b"))
    return through(d, with_id(d, "id", STORED), _store(block))


def wav_features(identified: DataFrame) -> DataFrame:
    """``id, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature`` of identified media.

    The samples are read back from the medium's own chunks; a medium that isn't a WAV file counts as raw samples.
    ``feature``: type, samples, mean, deviation, crossings of the mean, and confirmed media inside.
    """
    d = identified.select("id", "data", "declared", "media_type", "length", "embedded")
    return through(d, with_id(d, "id", FEATURES), _features)


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 64) -> DataFrame:
    """`text_as_wav`, `identify` and `wav_features` in one pass: ``id, n_bytes`` and the features."""
    d = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("b"))
    d = d.select(F.struct("id", F.octet_length("b").cast("long").alias("n_bytes")).alias("of"), "b")

    def unstored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["id", "media", "declared"])

    return through(d, with_id(d, "of", FEATURES), _store(block), unstored, _identify, _features).select("id.*", *(x.split()[0] for x in FEATURES.split(", ")))
