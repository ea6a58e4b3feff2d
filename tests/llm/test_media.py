import gzip
import hashlib
import io
import random
import struct
import time
import tracemalloc
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rankflow.llm import media as m


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0ab\0cd")) + chunk(b"IEND", b"")


def crc(raw, polynomial, bits):
    value = 0
    for byte in raw:
        value ^= byte << (bits - 8)
        for _ in range(8):
            value = (value << 1 ^ (polynomial if value >> (bits - 1) & 1 else 0)) & ((1 << bits) - 1)
    return value


def flac(frames=3, told=True):
    """Frames of 192 equal samples each."""
    parts = []
    for k in range(frames):
        head = bytes([0xFF, 0xF8, 0x14, 0x08, k])
        body = head + bytes([crc(head, 0x07, 8)]) + bytes([0, 0, 40 + k])
        parts.append(body + crc(body, 0x8005, 16).to_bytes(2, "big"))
    sizes = (11).to_bytes(3, "big") * 2
    info = struct.pack(">HH", 192, 192) + sizes + ((44100 << 44) | (15 << 36) | (192 * frames if told else 0)).to_bytes(8, "big") + bytes(16)
    return b"fLaC" + struct.pack(">I", 0x80000022) + info + b"".join(parts)


def samples():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    return {
        "png": png(),
        "gif": b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;",
        "jpeg": b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0\xff\xda\0\4\1\0ab\xff\0c\xff\xd9",
        "bmp": struct.pack("<2sIIIIiiHHIIiiII", b"BM", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"abc\0",
        "wav": m.to_wav(b"abc"),
        "pdf": b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF",
        "zip": z.getvalue(),
        "gzip": gzip.compress(b"some text" * 50),
        "mp4": struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 12, b"mdat") + b"abcd",
        "flac": flac(),
    }


def test_each_format_is_known_corrected_and_carved():
    for kind, raw in samples().items():
        name, corrected, inner = m.sniff(raw, "text/plain")
        assert (name, corrected, inner) == (m.TYPES[kind], True, []), kind
        assert m.sniff(raw, m.TYPES[kind])[1] is False
        found = m.sniff(b"junk BM GIF8 RIFF PK\3\4 \xff\xd8\xff " + raw, None)[2]
        assert [(x.kind, x.end - x.start) for x in found] == [(kind, len(raw))], kind


def test_flac_ends_with_its_last_frame():
    for raw in (flac(), flac(told=False), flac(1), flac(40)):
        found = m.items(b"xx" + raw + b"what follows it, of any kind")
        assert [(x.kind, x.start, x.end) for x in found] == [("flac", 2, 2 + len(raw))]
    assert m.items(flac()[:-1]) == [] and m.items(flac()[:60] + b"\1" + flac()[61:]) == []


def test_very_long_values(spark):
    text = "é and more of it, " * 150_000
    (row,) = m.text_media(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    raw = text.encode()
    padded = raw + b"\xff" * (-len(raw) % 576)
    assert (row.n_bytes, row.payload_bytes, row.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
    assert m.sniff(b"x" * 3_000_000 + png() + b"y" * 3_000_000)[2][0][:2] == ("png", 3_000_000)
    assert m.text_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_damage_is_seen():
    raw = bytearray(png())
    raw[20] ^= 1
    assert m.items(bytes(raw)) == []
    for raw in samples().values():
        m.items(raw[:-5])


def test_many_false_starts_are_linear():
    began = time.time()
    for piece in (b"%PDF-1", b"PK\3\4" + b"\1" * 40, b"\xff\xd8\xff\xda\0\2", b"BM", b"RIFF", b"\x1f\x8b\x08\0", b"OggS\0", b"ftyp", b"GIF89a"):
        m.items(piece * 50_000)
    assert time.time() - began < 60


def test_wav_round_trip():
    r = random.Random(0)
    for n in (0, 1, 2, 575, 576, 5000):
        x = r.randbytes(n)
        assert m.from_wav(m.to_wav(x)) == x


def test_rows(spark):
    rows = [(1, None, "a"), (None, "", "b"), (2, "é" * 400, "c"), (2, "x" * 576, "d"), (3, "y" * 300_000, None), (4, "y" * 300_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = sorted(m.text_media(df).collect(), key=lambda r: (r.n_bytes, r.doc_id or 0))
    assert len(got) == 6
    for (_, text, _), r in zip(sorted(rows, key=lambda x: (len((x[1] or "").encode()), x[0] or 0)), got, strict=True):
        raw = (text or "").encode()
        raw += b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]))
        assert r.media_sha256 == hashlib.sha256(m.to_wav(raw)).hexdigest() and r.media_bytes == len(m.to_wav(raw))
        assert r.feature.startswith("type=audio/wav;corrected=1;embedded=;samples=")
    assert got[-1].feature == got[-2].feature
    assert m.text_media(df.where(F.lit(False))).count() == 0


def test_any_media_column(spark):
    df = spark.createDataFrame([(1, bytearray(b"xx" + png()), "image/gif"), (2, bytearray(png()), "image/gif"), (3, None, None)], "id int, media binary, declared string")
    rows = {r.id: r.sniffed for r in m.sniffed(df).collect()}
    assert rows[2].kind == "image/png" and rows[2].corrected and not rows[2].embedded
    assert rows[1].kind == "image/gif" and bytes(rows[1].embedded[0].bytes) == png()
    assert rows[3].kind is None


def test_texts_are_stored_without_batches_in_python(spark, monkeypatch):
    plans, write = [], m.materialize
    monkeypatch.setattr(m, "materialize", lambda df, label, **options: plans.append(df._jdf.queryExecution().toString()) or write(df, label, **options))
    assert m.text_media(spark.createDataFrame([(1, "a")], "doc_id long, text string")).count() == 1
    assert len(plans) == 1 and "Python" not in plans[0] and "InArrow" not in plans[0]


def test_stored_column_is_the_wave_file(spark):
    texts = [None, *["x" * n for n in (0, 1, 2, 219, 220, 475, 476, 575, 576, 577, 1152, 65_500, 70_000, 17_000_000)], "é\0\u4e2d𝄞" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raws = {i: (t or "").encode() for i, t in enumerate(texts)}
    whole = {i: m.to_wav(x + b"\xff" * (576 * max(1, -(-len(x) // 576)) - len(x))) for i, x in raws.items()}
    got = {r.doc_id: (r.size, r.sha) for r in df.select("doc_id", F.octet_length(m.wav_column(F.col("text"))).alias("size"), F.sha2(m.wav_column(F.col("text")), 256).alias("sha")).collect()}
    assert got == {i: (len(x), hashlib.sha256(x).hexdigest()) for i, x in whole.items()}
    (row,) = spark.sql("select 1L doc_id, cast(X'ff61fe00c328' as string) text").select(m.wav_column(F.col("text")).alias("w")).collect()  # bytes that are no UTF-8 stay as they are
    assert bytes(row.w) == m.to_wav(b"\xff\x61\xfe\0\xc3\x28" + b"\xff" * 570)


def test_long_values_are_read_in_little_memory():
    raw = m.to_wav(random.Random(5).randbytes(576) * 40_000)  # 23 MB
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([len(raw) - 44]), pa.array(["audio/wav"]), pa.array([raw], pa.binary())], ["doc_id", "n_bytes", "declared", "media"])
    tracemalloc.start()
    (out,) = m._read(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    x = np.frombuffer(raw[44:], np.uint8).astype(np.int16) - 128
    rms = float(np.sqrt(np.square(x, dtype=np.int64).mean()))
    crossings = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    says = f"samples={len(x)};mean={float(x.mean()):.4f};rms={rms:.4f};crossings={crossings};min={x.min()};max={x.max()}"
    assert out.column(7)[0].as_py().endswith(says)
    assert peak < 4 * len(raw), peak


def test_pieces_change_nothing(monkeypatch):
    r = random.Random(8)
    raw = b"".join(x for kind, x in samples().items()) + r.randbytes(3000)
    whole = m.items(raw), m.feature(np.frombuffer(raw, np.uint8))
    assert len(whole[0]) >= 10
    for size in (1, 2, 3, 7, 64, 1000, len(raw) - 1, len(raw)):
        monkeypatch.setattr(m, "PIECE", size)
        assert (m.items(raw), m.feature(np.frombuffer(raw, np.uint8))) == whole, size
    assert m.items(b"") == []
