"""Media columns: what a value is by its bytes, whatever it is declared to be, and what is embedded in it.

An Aho-Corasick automaton finds all magic bytes in one pass; at each place, the format's validator walks the structure
(chunks, lengths, checksums) and gives the end of the item, or nothing. An item at the start gives the value's type and
corrects its declared one; items further in are carved.

Text documents take part as 8-bit mono sound: their bytes, filled up with 255 to a positive multiple of 576, are the
samples of a RIFF/WAVE file, which holds them without loss.

Defined cases: null text or value is empty; empty values have no type; ids may be null or repeat; equal values give
equal results; a row gives a row, so an empty table gives an empty result; texts and values of any length are read as a
whole; of items that start at one place the first format in the list counts; text_media reads doc_id and text only, and
sniffed keeps all columns, a column `sniffed` of the same name excepted.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import materialize

FRAME = 576
#: Bytes of a value that are looked at together: the automaton takes four bytes for each, the sums of a feature eight.
PIECE = 1 << 20
#: Media are written, and so read, in groups of about this many bytes: a task holds no more of them in its heap.
ROW_GROUPS = {"parquet.block.size": str(4 << 20)}


class Item(NamedTuple):
    kind: str
    start: int
    end: int


class Data:
    """Bytes with searches that remember where nothing more is found, so that many false starts stay linear."""

    def __init__(self, raw: bytes):
        self.raw, self._gone, self._next = raw, {}, {}

    def find(self, what: bytes, at: int) -> int:
        if at >= self._gone.get(what, len(self.raw) + 1):
            return -1
        lo, hit = self._next.get(what, (0, -1))
        if lo <= at <= hit:
            return hit
        hit = self.raw.find(what, at)
        if hit < 0:
            self._gone[what] = at
        else:
            self._next[what] = at, hit
        return hit

    def number(self, form: str, at: int) -> int:
        return struct.unpack_from(form, self.raw, at)[0] if 0 <= at <= len(self.raw) - struct.calcsize(form) else -1


def _png(d: Data, at: int) -> int | None:
    i = at + 8
    while (size := d.number(">I", i)) >= 0 and i + 12 + size <= len(d.raw):
        kind = d.raw[i + 4 : i + 8]
        if zlib.crc32(d.raw[i + 4 : i + 8 + size]) != d.number(">I", i + 8 + size) or (i == at + 8 and (kind != b"IHDR" or size != 13)):
            return None
        i += 12 + size
        if kind == b"IEND":
            return i
    return None


def _gif(d: Data, at: int) -> int | None:
    if d.raw[at + 4 : at + 6] not in (b"7a", b"9a") or d.number("<H", at + 6) < 1 or d.number("<H", at + 8) < 1:
        return None
    flags = d.number("B", at + 10)
    i = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while (tag := d.number("B", i)) in (0x21, 0x2C):
        if tag == 0x2C:
            flags = d.number("B", i + 9)
            i += 11 + (3 << (flags & 7) + 1 if flags > 0 and flags & 128 else 0)
        else:
            i += 2
        while (size := d.number("B", i)) > 0:
            i += 1 + size
        if size < 0:
            return None
        i += 1
    return i + 1 if tag == 0x3B else None


def _jpeg(d: Data, at: int) -> int | None:
    i = at + 2
    while d.number("B", i) == 0xFF and (mark := d.number("B", i + 1)) not in (0xDA, -1):
        size = d.number(">H", i + 2)
        if size < 2 or not 0xC0 <= mark <= 0xFE:
            return None
        i += 2 + size
    if d.number(">H", i) != 0xFFDA or i == at + 2:
        return None
    end = d.find(b"\xff\xd9", i)
    return end + 2 if end >= 0 else None


def _bmp(d: Data, at: int) -> int | None:
    size, start, head = d.number("<I", at + 2), d.number("<I", at + 10), d.number("<I", at + 14)
    fits = head in (12, 40, 52, 56, 108, 124) and d.number("<I", at + 6) == 0 and 14 + head <= start <= size <= len(d.raw) - at
    return at + size if fits and (head == 12 or d.number("<H", at + 26) == 1) else None


def _riff(d: Data, at: int) -> int | None:
    """A RIFF file of any form: chunks that fill its stated length; the forms are told apart by kind_at."""
    size = d.number("<I", at + 4)
    if size < 4 or at + 8 + size > len(d.raw):
        return None
    i, end = at + 12, at + 8 + size
    while i + 8 <= end:
        i += 8 + d.number("<I", i + 4)
        i += (i - at) % 2
    return end if i in (end, end + 1) else None


def _pdf(d: Data, at: int) -> int | None:
    if d.raw[at + 5 : at + 6] not in (b"1", b"2"):
        return None
    mark, end = d.find(b"startxref", at), d.find(b"%%EOF", at)
    return end + 5 if 0 <= mark < end else None


def _zip(d: Data, at: int) -> int | None:
    end = d.find(b"PK\5\6", at)
    if end < 0 or d.number("<H", at + 26) < 1 or d.number("<H", at + 4) > 63:
        return None
    size, start, note = d.number("<I", end + 12), d.number("<I", end + 16), d.number("<H", end + 20)
    return end + 22 + note if at + start + size == end and 0 <= note and end + 22 + note <= len(d.raw) else None


def _gzip(d: Data, at: int) -> int | None:
    if d.number("B", at + 3) & 0xE0 or d.number("B", at + 3) < 0:
        return None
    unpack, i = zlib.decompressobj(31), at
    try:
        while not unpack.eof and i < len(d.raw):
            tail = unpack.decompress(d.raw[i : i + 65536], 1 << 20)
            while unpack.unconsumed_tail:
                tail = unpack.decompress(unpack.unconsumed_tail, 1 << 20)
            del tail
            i += 65536
    except zlib.error:
        return None
    return min(i, len(d.raw)) - len(unpack.unused_data) if unpack.eof else None


def _ogg(d: Data, at: int) -> int | None:
    i = at
    while d.raw[i : i + 5] == b"OggS\0" and (n := d.number("B", i + 26)) >= 0 and i + 27 + n <= len(d.raw):
        i += 27 + n + sum(d.raw[i + 27 : i + 27 + n])
        if i > len(d.raw):
            return None
    return i if i > at else None


@cache
def _crc_table(polynomial: int, bits: int) -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << (bits - 8)
        for _ in range(8):
            crc = (crc << 1) ^ (polynomial if crc >> (bits - 1) & 1 else 0)
        table.append(crc & ((1 << bits) - 1))
    return table


def _flac_header(raw: bytes, at: int) -> tuple[int, int] | None:
    """(samples in the frame, where its header ends) of a frame at a place, if its own checksum holds."""
    if at + 6 > len(raw) or raw[at] != 0xFF or raw[at + 1] & 0xFE != 0xF8 or raw[at + 3] & 1:
        return None
    size, rate, i = raw[at + 2] >> 4, raw[at + 2] & 15, at + 4
    lead = raw[i]
    i += 1 if lead < 0x80 else max(2, 8 - (lead ^ 0xFF).bit_length()) if lead >= 0xC0 else 99
    extra = i
    i += (1 if size == 6 else 2 if size == 7 else 0) + (1 if rate == 12 else 2 if rate in (13, 14) else 0)
    if size == 0 or rate == 15 or i >= len(raw):
        return None
    table, crc = _crc_table(0x07, 8), 0
    for byte in raw[at:i]:
        crc = table[crc ^ byte]
    if crc != raw[i]:
        return None
    samples = 192 if size == 1 else 576 << (size - 2) if size < 6 else raw[extra] + 1 if size == 6 else int.from_bytes(raw[extra : extra + 2], "big") + 1 if size == 7 else 256 << (size - 8)
    return samples, i + 1


def _flac(d: Data, at: int) -> int | None:
    """Metadata blocks, then frames: each begins with a header that its checksum confirms and ends where the checksum of all of it does."""
    i, first, info = at + 4, True, at + 8
    while True:
        head = d.number(">I", i)
        size = head & 0xFFFFFF
        if head < 0 or (first and (head >> 24 & 127 or size != 34)) or i + 4 + size > len(d.raw):
            return None
        i, first = i + 4 + size, False
        if head >> 31:
            break
    raw = d.raw
    least, most = int.from_bytes(raw[info + 4 : info + 7], "big"), int.from_bytes(raw[info + 7 : info + 10], "big")
    total = int.from_bytes(raw[info + 13 : info + 18], "big") & ((1 << 36) - 1)
    table, seen = _crc_table(0x8005, 16), 0
    while not total or seen < total:
        found = _flac_header(raw, i)
        if not found:
            return None if total else i  # where the number of samples is not told, frames go on as long as there are any
        samples, body = found
        crc, stop = 0, min(len(raw), i + most) if most else len(raw)
        for k in range(i, stop):
            crc = (crc << 8 & 0xFFFF) ^ table[crc >> 8 ^ raw[k]]
            z = k + 1
            if crc == 0 and z >= max(body + 3, i + least) and (seen + samples >= total or _flac_header(raw, z)):
                break
        else:
            return None
        i, seen = z, seen + samples
    return i


def _mp4(d: Data, at: int) -> int | None:
    i, seen = at - 4, 0
    while (size := d.number(">I", i)) >= 8 and i + size <= len(d.raw) and d.raw[i + 4 : i + 8].isalnum():
        i += size
        seen += 1
    return i if seen > 1 else None


#: Magic bytes, name, and where before them the item starts.
FORMATS = (
    (b"\x89PNG\r\n\x1a\n", "png", 0, _png),
    (b"GIF8", "gif", 0, _gif),
    (b"\xff\xd8\xff", "jpeg", 0, _jpeg),
    (b"BM", "bmp", 0, _bmp),
    (b"RIFF", "riff", 0, _riff),
    (b"%PDF-", "pdf", 0, _pdf),
    (b"PK\x03\x04", "zip", 0, _zip),
    (b"\x1f\x8b\x08", "gzip", 0, _gzip),
    (b"OggS", "ogg", 0, _ogg),
    (b"fLaC", "flac", 0, _flac),
    (b"ftyp", "mp4", 4, _mp4),
)
TYPES = {"png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg", "bmp": "image/bmp", "wav": "audio/wav", "webp": "image/webp", "avi": "video/avi", "riff": "application/x-riff", "pdf": "application/pdf", "zip": "application/zip", "gzip": "application/gzip", "ogg": "audio/ogg", "flac": "audio/flac", "mp4": "video/mp4"}


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, (magic, *_) in enumerate(FORMATS):
        found.add_word(magic.decode("latin-1") if ahocorasick.unicode else magic, i)
    found.make_automaton()
    return found, ahocorasick.unicode


def _magic(raw: bytes) -> Iterator[tuple[int, int]]:
    """(place of the last byte, format) of all magic bytes; the automaton keeps its state from piece to piece."""
    automaton, as_text = _automaton()
    search = automaton.iter("" if as_text else b"")
    for at in range(0, len(raw), PIECE):
        piece = raw[at : at + PIECE]
        search.set(piece.decode("latin-1") if as_text else piece)
        yield from search


def items(raw: bytes) -> list[Item]:
    """The valid media items in raw, in order of their start; one inside another is listed too, unless it starts with it."""
    d, out, starts = Data(raw), [], set()
    for last, i in _magic(raw):
        magic, kind, before, valid = FORMATS[i]
        at = last - len(magic) + 1 - before
        if at >= 0 and at not in starts and (end := valid(d, at + before)) is not None:
            starts.add(at)
            if kind == "riff":
                kind = {b"WAVE": "wav", b"WEBP": "webp", b"AVI ": "avi"}.get(raw[at + 8 : at + 12], kind)
            out.append(Item(kind, at, end))
    return sorted(out, key=lambda x: (x.start, -x.end))


def sniff(raw: bytes, declared: str | None = None) -> tuple[str | None, bool, list[Item]]:
    """(type by the bytes, or else as declared; whether that corrects the declared one; items embedded further in)."""
    found = items(raw)
    own = TYPES[found[0].kind] if found and found[0].start == 0 else None
    return own or declared, own is not None and own != declared, [x for x in found if x.start > 0]


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit mono samples as a RIFF/WAVE file."""
    odd = len(payload) % 2
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + b"\0" * odd


def from_wav(raw: bytes) -> bytes:
    d, i = Data(raw), 12
    while (size := d.number("<I", i + 4)) >= 0:
        if raw[i : i + 4] == b"data":
            return raw[i + 8 : i + 8 + size]
        i += 8 + size + size % 2
    raise ValueError("no data chunk")


def feature(samples: np.ndarray) -> str:
    """Loudness, brightness and level of 8-bit samples, in fixed decimals."""
    total = squares = crossings = 0
    for at in range(0, len(samples), PIECE):
        x = samples[at : at + PIECE].astype(np.int64) - 128
        up = samples[at : at + PIECE + 1] >= 128  # and the next piece's first, for a crossing between the two
        total, squares, crossings = total + int(x.sum()), squares + int(x @ x), crossings + int((up[1:] != up[:-1]).sum())
    mean, rms = total / len(samples), math.sqrt(squares / len(samples))
    return f"samples={len(samples)};mean={mean:.4f};rms={rms:.4f};crossings={crossings};min={int(samples.min()) - 128};max={int(samples.max()) - 128}"


def _little(n: Column) -> Column:
    """A number as four bytes, the lowest first."""
    digits = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)]))


def wav_column(text: Column, rate: int = 8000) -> Column:
    """The same as to_wav of the filled-up bytes of a text, row by row inside the JVM: no batch of whole texts is held or sent."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    n = F.octet_length(text).cast("long")
    fill = F.when(n == 0, FRAME).otherwise(F.pmod(-n, F.lit(FRAME))).cast("int")
    head = struct.pack("<4s4sIHHIIHH4s", b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data")
    return F.concat(F.lit(b"RIFF"), _little(n + fill + 36), F.lit(head), _little(n + fill), text.cast("binary"), F.substring(F.lit(b"\xff" * FRAME), F.lit(1), fill))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, n, declared, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            raw = x.as_py()
            kind, fixed, inner = sniff(raw, declared)
            payload = from_wav(raw)
            says = f"type={kind};corrected={int(fixed)};embedded={'+'.join(f'{i.kind}@{i.start}-{i.end}' for i in inner)};{feature(np.frombuffer(payload, np.uint8))}"
            rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), says))
        columns = list(zip(*rows, strict=True)) or [()] * 8
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def text_media(docs: DataFrame) -> DataFrame:
    """Store every text as sound in a media column, read it back: one row per row, see the module's text."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    stored = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("n_bytes"), F.lit("application/octet-stream").alias("declared"), wav_column(text).alias("media")), "media", **ROW_GROUPS)
    return stored.mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def sniffed(media: DataFrame, value: str = "media", declared: str = "declared") -> DataFrame:
    """Any media column: the columns as they are, with sniffed (kind, corrected, embedded items with their bytes) added."""
    @F.pandas_udf("struct<kind:string,corrected:boolean,embedded:array<struct<kind:string,start:bigint,end:bigint,bytes:binary>>>")
    def look(values: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, name in zip(values, names, strict=True):
            raw = bytes(raw) if raw is not None else b""
            kind, fixed, inner = sniff(raw, name)
            rows.append((kind, fixed, [{"kind": i.kind, "start": i.start, "end": i.end, "bytes": raw[i.start : i.end]} for i in inner]))
        return pd.DataFrame(rows, columns=["kind", "corrected", "embedded"])

    seen = look(F.col(value), F.col(declared).cast("string"))
    return media.withColumn("sniffed", seen)
