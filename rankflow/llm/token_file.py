"""Token files: ids coded by a static range asymmetric numeral system.

Format of a block, little-endian: magic, ids, documents, lanes, words, checkpoints, crc32 of all that follows; then the
documents' ids and lengths, the lanes' states to start from, the checkpoints (step, words read, states) and the words.
Ids are dealt to lanes in turn; a lane is a 64-bit state coded against the shared frequency table and renewed by 32-bit
words, and all lanes of a block take their words from one stream in lane order. Blocks are independent, hold whole
documents, and carry their own checksum, so they are decoded in parallel; within a block, decoding may start at any
checkpoint. The table is in every file's header row.

Files are written as a table of blocks by shard, through Spark, so that they may lie in any store that Spark reaches;
shards follow each other in ascending order of doc_id.

Ids are those of the tokenizers library, special tokens that occur in a text included.

Defined cases: null text is empty and has only the end id; a null doc_id comes first; rows that repeat a doc_id follow
each other in the order of their length and checksum; a text of any length is one document of one block, which may then
hold more ids than others; an empty table gives an empty file; only doc_id and text are read, whatever other columns are
called.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankflow.llm.common import drop, new_path, ranges

_U = np.uint64
SCALE = 20  # bits of the sum of all frequencies
LOW = 1 << 31  # states lie from here up to 2 ** 63
LANES, BLOCK_IDS, CHECKPOINT = 4096, 1 << 20, 128
#: Bytes of ids in a shard, about.
SHARD_BYTES = 16_000_000
#: Bytes of texts that are encoded at a time.
MOST_BYTES = 1_000_000
MAGIC = b"RKT1"
_HEAD = struct.Struct("<4sQIIQII")


#: Letters whose composition and lower case depend on nothing around them, and all other ASCII signs. Anything else goes the long way.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
_PLAIN = re.compile(f"[!-;=-~{_LETTER}]+")
_ENDED = re.compile(f"([{_LETTER}]+)([!-&(-/:;=-@\\[-`{{-~]*)")  # letters, then signs: one piece or two
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9]+")


def _byte_signs() -> list[str]:
    """The sign that byte-level vocabularies write for each byte: itself where it is printable, else the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class WordIds:
    """Ids of a lower-case byte-level vocabulary with word ends, under which no id spans white space.

    Texts are parted at special tokens first: the library takes those out before it looks at anything else, and what lies
    between them is encoded on its own. Words parted by white space are looked up in a cache. Of those that it lacks, plain ones are parted into pieces as
    the vocabulary's pattern says, and the tokenizers library's model encodes each piece that is new; others go through
    the whole tokenizer, parted by a special token. The tests hold both ways to the tokenizer's own result.

    What the caches take is bounded, as each Python worker has its own: ids of pieces are bytes, 32 bits each; pieces are two
    dicts of which the later takes the earlier's place when it has half of the most; the arrays of words have their
    full length from the start and are used again, since what growing arrays give back to the heap stays with the process.
    """

    BLANKS = "\t\n\r\f\v"

    def __init__(self, path: str, most: int = 500_000, most_pieces: int = 340_000, apart: str = "<|endoftext|>"):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.signs = self.tokenizer.model, _byte_signs()
        self.apart, self.apart_id, self.most, self.most_pieces = apart, self.tokenizer.token_to_id(apart), most, most_pieces
        self.pieces: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.part = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")")
        room = most + most // 8
        self.index: dict[str, int] = {"": 0}
        self.start, self.size, self.again = np.zeros(room, np.uint32), np.zeros(room, np.uint32), np.zeros(room, bool)
        self.pool, self.used = np.zeros(4 * room, np.uint32), 0

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that the later dict lacks."""
        found = self.earlier.get(piece)
        if found is None:
            written = piece if piece.isascii() else "".join([self.signs[b] for b in piece.encode()])
            found = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
        self.pieces[piece] = found
        return found

    def _plain_words(self, words: list[str]) -> tuple[list[str], list[bytes], list[str]]:
        """(words of ASCII letters, the ids of each, the other words)."""
        plain, found, others = [], [], []
        known, piece = self.pieces.get, self._piece
        for word in words:
            if word.isalpha() and word.isascii():
                w = word if word.islower() else word.lower()
                found.append(known(w) or piece(w))
                plain.append(word)
            else:
                others.append(word)
        return plain, found, others

    def _learn(self, words: list[str]) -> None:
        if len(self.pieces) >= self.most_pieces // 2:
            self.pieces, self.earlier = {}, self.pieces
        plain, found, words = self._plain_words(words)
        rest, odd = [], []
        ended, plain_word, parted, piece, known = _ENDED.fullmatch, _PLAIN.fullmatch, _PIECE.findall, self._piece, self.pieces.get
        for word in words:
            if m := ended(word):
                ids = known(p := m[1].lower()) or piece(p)
                if p := m[2]:
                    ids = ids + (known(p) or piece(p))
                found.append(ids)
            elif plain_word(word):
                found.append(b"".join([known(p) or piece(p) for p in parted(word.lower())]))
            else:
                (odd if "<|" in word else rest).append(word)
                continue
            plain.append(word)
        parts, more = [np.frombuffer(b"".join(found), np.uint32)], [np.fromiter(map(len, found), np.int64, len(found)) // 4]
        for at in range(0, len(rest), 4096):
            ids = np.array(self.tokenizer.encode_batch_fast([self.apart.join(rest[at : at + 4096])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(np.append(ids, np.uint32(self.apart_id)) == self.apart_id)
            more.append(np.diff(ends, prepend=-1) - 1)
            parts.append(ids[ids != self.apart_id])
        self.tokenizer.encode_special_tokens = True  # as any text: special tokens were taken out before
        for w in odd:
            parts.append(np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32))
            more.append(np.array([len(parts[-1])]))
        self.tokenizer.encode_special_tokens = False
        plain += rest + odd
        ids, sizes = np.concatenate(parts), np.concatenate(more)
        n = len(self.index)
        while n + len(sizes) > len(self.start):
            self.start, self.size, self.again = (np.append(x, np.zeros_like(x)) for x in (self.start, self.size, self.again))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.size[n : n + len(sizes)] = sizes
        self.start[n : n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.index.update(zip(plain, range(n, n + len(sizes)), strict=True))

    def _thin_out(self) -> None:
        """Keep the words that were met again since they were learned."""
        again = self.again[: len(self.index)]
        again[0] = False
        if int(again.sum()) > self.most // 2:
            again[:] = False
        start, size, words = self.start[: len(again)][again], self.size[: len(again)][again].astype(np.int64), list(compress(self.index, again.tobytes()))
        self.index = {"": 0}
        self.index.update(zip(words, range(1, len(words) + 1), strict=True))
        ids = self.pool[ranges(start.astype(np.int64), size)]
        self.size[1 : len(words) + 1] = size
        self.start[1 : len(words) + 1] = np.cumsum(size) - size
        self.pool[: len(ids)] = ids
        self.used = len(ids)
        again[:] = False

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, the number of ids of each text)."""
        if not any("<|" in t and self.part.search(t) for t in texts):
            return self._encode(texts)
        parts = [self.part.split(t) for t in texts]  # plain, special, plain, special, ..., plain
        ids, sizes = self._encode([x for p in parts for x in p[::2]])
        after = np.cumsum([len(p[::2]) for p in parts])
        marks = [[self.special[x] for x in p[1::2]] for p in parts]
        inside = np.delete(np.arange(len(sizes)), after - 1)  # the plain parts that a special token follows
        ids = np.insert(ids, np.cumsum(sizes)[inside], np.array([i for m in marks for i in m], np.uint32))
        whole = np.add.reduceat(sizes, np.append(0, after[:-1])) + np.array([len(m) for m in marks])
        return ids, whole

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > self.most:
            self._thin_out()
        words, counts = [], []
        for t in texts:
            for blank in self.BLANKS:
                if blank in t:
                    t = t.replace(blank, " ")
            own = t.split(" ")
            counts.append(len(own))
            words += own
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        lacking = np.flatnonzero(at < 0).tolist()
        self.again[at[at >= 0]] = True
        if lacking:
            new = [words[i] for i in lacking]
            distinct = list(dict.fromkeys(new))
            for lo in range(0, len(distinct), 1 << 16):
                self._learn(distinct[lo : lo + (1 << 16)])
            at[lacking] = list(map(self.index.__getitem__, new))
        sizes = self.size[at].astype(np.int64)
        ids = self.pool[ranges(self.start[at].astype(np.int64), sizes)]
        edges = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        return ids, np.diff(edges)


@cache
def _words(path: str) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks share the cores; each thread of the library would keep memory of its own
    return WordIds(path)


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts scaled to sum up to 2 ** scale, at least 1 for each id that occurs."""
    total = int(counts.sum())
    present = counts > 0
    if not total:
        return np.zeros(len(counts), np.int64)
    if int(present.sum()) > 1 << scale:
        raise ValueError("more ids than slots")
    out = np.where(present, np.maximum(1, (counts.astype(np.float64) * (1 << scale) / total).astype(np.int64)), 0)
    extra = (1 << scale) - int(out.sum())
    order = np.argsort(-out, kind="stable")
    if extra > 0:
        out[order[0]] += extra
    for i in order if extra < 0 else ():
        cut = min(int(out[i]) - 1, -extra)
        out[i] -= cut
        extra += cut
        if not extra:
            break
    return out


class Table:
    """What coding needs of the frequencies."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale = scale
        self.freq = freq.astype(_U)
        self.low = (np.cumsum(freq) - freq).astype(_U)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]], np.ndarray]:
    """(states to start decoding from, checkpoints (step, words read before it, states), words)."""
    steps = -(-len(ids) // lanes)
    x = np.full(lanes, LOW, _U)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, np.ndarray]] = []
    behind = 0
    for step in range(steps - 1, -1, -1):
        own = ids[step * lanes : (step + 1) * lanes]
        f, y = table.freq[own], x[: len(own)]
        full = y >= f << _U(63 - table.scale)
        if full.any():
            words.append((y[full] & _U(0xFFFFFFFF)).astype(np.uint32))
            behind += len(words[-1])
            y = np.where(full, y >> _U(32), y)
        q = y // f
        x[: len(own)] = (q << _U(table.scale)) + (y - q * f) + table.low[own]
        if step and step % every == 0:
            marks.append((step, behind, x.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    return x, [(s, len(stream) - b, states) for s, b, states in marks[::-1]], stream


def decode_steps(n: int, x: np.ndarray, words: np.ndarray, table: Table, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids of steps from start on, given the states there and the words from there on."""
    lanes = len(x)
    stop = -(-n // lanes) if stop is None else stop
    out = np.empty(max(0, min(n, stop * lanes) - start * lanes), np.uint32)
    x, at, mask, scale = x.copy(), 0, _U((1 << table.scale) - 1), _U(table.scale)
    for step in range(start, stop):
        k = min(lanes, n - step * lanes)
        y = x[:k]
        slot = y & mask
        s = table.symbol[slot]
        y = table.freq[s] * (y >> scale) + slot - table.low[s]
        short = np.flatnonzero(y < _U(LOW))
        if len(short):
            y[short] = (y[short] << _U(32)) | words[at : at + len(short)]
            at += len(short)
        x[:k] = y
        out[(step - start) * lanes : (step - start) * lanes + k] = s
    return out


def pack_block(docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    lanes = max(1, min(LANES, len(ids) // 64))
    x, marks, words = encode_block(ids, table, lanes)
    body = b"".join([docs.astype("<i8").tobytes(), sizes.astype("<u8").tobytes(), x.astype("<u8").tobytes(), *(struct.pack("<QQ", s, w) + m.astype("<u8").tobytes() for s, w, m in marks), words.astype("<u4").tobytes()])
    return _HEAD.pack(MAGIC, len(ids), len(docs), lanes, len(words), len(marks), zlib.crc32(body)) + body


def unpack_block(raw: bytes, table: Table, checkpoint: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, lengths, ids); ids only from a checkpoint on, if one is named."""
    magic, n, n_docs, lanes, n_words, n_marks, crc = _HEAD.unpack_from(raw)
    body = memoryview(raw)[_HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("a block is damaged")
    docs, sizes = np.frombuffer(body, "<i8", n_docs), np.frombuffer(body, "<u8", n_docs, 8 * n_docs).astype(np.int64)
    at = 16 * n_docs
    x = np.frombuffer(body, "<u8", lanes, at)
    at += 8 * lanes
    marks = []
    for _ in range(n_marks):
        marks.append((*struct.unpack_from("<QQ", body, at), np.frombuffer(body, "<u8", lanes, at + 16)))
        at += 16 + 8 * lanes
    words = np.frombuffer(body, "<u4", n_words, at)
    if checkpoint is None:
        return docs, sizes, decode_steps(n, x, words, table)
    step, read, states = marks[checkpoint]
    return docs, sizes, decode_steps(n, states, words[read:], table, step)


def _tokenize(path: str, end_id: int, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts = _words(path), np.zeros(vocabulary, np.int64)
        small = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
        gc.disable()  # the caches hold no cycles, and going through them takes as long as a tenth of the encoding
        try:
            for batch in batches:
                bytes_before = np.append(0, np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(), dtype=np.int64))
                lo = 0
                while lo < batch.num_rows:  # a long text comes alone
                    some = min(256, max(1, int(np.searchsorted(bytes_before, bytes_before[lo] + MOST_BYTES, "right")) - 1 - lo))
                    ids, sizes = encoder.encode([t or "" for t in batch.column(1).slice(lo, some).to_pylist()])
                    ends = np.cumsum(sizes)
                    ids = np.insert(ids, ends, end_id).astype(small)
                    counts += np.bincount(ids, minlength=vocabulary)
                    ends = ends + np.arange(1, len(ends) + 1)
                    raw, width = ids.tobytes(), small.itemsize
                    cut = np.append(0, ends).tolist()
                    blobs = [raw[a * width : z * width] for a, z in zip(cut[:-1], cut[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(sizes)), pa.array(np.diff(cut)), pa.array(blobs, pa.binary())], ["doc_id", "n", "ids"])
                    lo += some
        finally:
            gc.enable()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], ["doc_id", "n", "ids"])

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(0):
            counts = np.frombuffer(x.as_py(), "<i8")
            own = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(counts[own])], ["token", "n"])


_NONE = -(2**63)


def _encode(freq: np.ndarray, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shard, block = Table(freq), TaskContext.get().partitionId(), 0
        small = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
        docs, sizes, parts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), small).astype(np.uint32)
            raw = pack_block(np.array(docs, np.int64), np.array(sizes, np.int64), ids, table)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([raw], pa.binary())], ["shard", "block", "n_ids", "data"])

        for batch in batches:
            for doc, n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                docs.append(_NONE if doc is None else doc)
                sizes.append(n)
                parts.append(x.as_py())
                held += n
                if held >= BLOCK_IDS:
                    yield flush()
                    docs, sizes, parts, held, block = [], [], [], 0, block + 1
        if docs:
            yield flush()

    return run


def _decode(freq: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        for batch in batches:
            for shard, block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                docs, sizes, ids = unpack_block(raw.as_py(), table)
                out, ends = memoryview(ids.astype("<u4").tobytes()), np.append(0, np.cumsum(sizes))
                crc = [zlib.crc32(out[4 * a : 4 * z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                k = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == _NONE), pa.array([shard] * k, pa.int32()), pa.array([block] * k, pa.int32()), pa.array(ends[:-1]), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "shard", "block", "at", "n_tokens", "ids_crc32"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Write the ids of all documents, in ascending order of doc_id, under path: blocks/ and table/."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = max(end_id + 1, Tokenizer.from_file(tokenizer_path).get_vocab_size())
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens_path = new_path(spark, "tokens")
    base.mapInArrow(_tokenize(tokenizer_path, end_id, vocabulary), "doc_id long, n long, ids binary").write.mode("overwrite").parquet(tokens_path)
    tokens = spark.read.schema("doc_id long, n long, ids binary").parquet(tokens_path)
    counted = tokens.where("n < 0").select("ids").mapInArrow(_counts, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, np.int64)
    for r in counted.collect():  # at most the vocabulary
        counts[r.token] = r.n
    freq = frequencies(counts)
    spark.createDataFrame([(SCALE, freq.astype("<u4").tobytes())], "scale int, freq binary").coalesce(1).write.parquet(f"{path}/table")
    # Ranges of documents by the bytes of all ids, which are known by now.
    shards = int(min(1_000_000, max(4, -(-int(counts.sum()) * (2 if vocabulary <= 1 << 16 else 4) // SHARD_BYTES))))
    ordered = tokens.where("n >= 0").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "n", F.crc32("ids"))
    ordered.mapInArrow(_encode(freq, vocabulary), "shard int, block int, n_ids long, data binary").write.option("compression", "none").parquet(f"{path}/blocks")
    drop(spark, tokens_path)


def read_tokens(spark, path: str) -> DataFrame:
    """One row per document of a token file: doc_id, start, n_tokens, ids_crc32."""
    head = spark.read.schema("scale int, freq binary").parquet(f"{path}/table").first()
    freq = np.frombuffer(head.freq, "<u4").astype(np.int64)
    blocks = spark.read.schema("shard int, block int, n_ids long, data binary").parquet(f"{path}/blocks")
    # Shards are summed up first: one row each meets in one task, and a shard's own blocks are set off within it.
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).select("shard", earlier(Window.orderBy("shard")).alias("of_shard"))
    first = blocks.select("shard", "block", earlier(Window.partitionBy("shard").orderBy("block")).alias("of_block")).join(shards, "shard").select("shard", "block", (F.col("of_shard") + F.col("of_block")).alias("first"))
    decoded = blocks.select("shard", "block", "data").mapInArrow(_decode(freq), "doc_id long, shard int, block int, at long, n_tokens long, ids_crc32 long")
    return decoded.join(first, ["shard", "block"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_file(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write a token file of all documents in the shared folder and read it back."""
    path = new_path(docs.sparkSession, "token-file")
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_tokens(docs.sparkSession, path)
