"""Suffix-array dedup: remove every byte covered by a 100-byte string that also starts earlier.

The suffixes are never sorted as a whole. Each text is cut into fragments, so that two equal 100-byte strings always
lie in fragments of one key: a start belongs to the smallest hash among the 32-byte strings inside its 100 bytes, and
a fragment is a run of starts with the same smallest hash together with the 99 bytes that follow it. Then

1. split keys: keys under which very many different fragments meet (a passage that follows a different word in each of
   a billion documents) are found in a sixteenth of the documents, drawn by hash. Their fragments are dealt start by
   start, by a hash of the whole 100 bytes, from the outset, so no task receives such a key. The sample only says how
   rows are dealt: every document's every start takes part.
2. scan: fragments (key, content hash, place) are dealt to buckets by key. A task keeps one of equal fragments and
   settles the copies itself, so that a passage held by a third of the corpus sends one record per task, not one per
   copy.
3. bucket: keys with one fragment hold no repeat, unless it repeats itself. Of equal fragments the first stays, the
   others are repeats as a whole. A key that the sample missed, of more than `hot_fragments` different fragments or
   HOT_BYTES of their text, is dealt anew start by start; equal strings collapse before they are sent and again where
   they meet, so that a run of one letter, or a passage that many fragments hold, is no load of its own.
4. merge: the text of the remaining, distinct fragments is dealt to the same buckets, and worked off in units of whole
   keys, of UNIT + HOT_BYTES at most. A unit has two shards. Each builds its own multi-string Burrows-Wheeler transform
   over symbols of 20 bytes, with a dictionary of its own. The transforms are merged by refining their interleave:
   where each suffix of one shard falls among those of the other starts as everywhere, and a round narrows it by one
   symbol, with two rank queries to the other's transform (how often does this symbol stand before this place in it).
   Nothing is ranked or sorted across shards. After five rounds a place that is still an interval is a common prefix of
   100 bytes; intervals within and across shards give the repeats, and all starts of one but the first are repeats.
5. apply: the covered bytes of each document are removed.

Shards and their merge lie in one task, since sending transforms would take five bytes for each byte of text.

Defined cases: null text is empty; a null doc_id counts as the smallest id; rows that repeat both doc_id and text are
one document and give equal rows, one each; different texts under one doc_id are told apart by their hash, and rank by it; of
equal strings the one that starts first stays; very long texts are worked off in parts that share 99 bytes; empty tables
give empty results; only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import id_and_text, id_back, materialize, ranges

SPAN, GRAM, STEP = 100, 32, 20
#: Starts in a fragment at most; only periodic texts have longer runs.
RUN = 4096
#: Bytes of text hashed at once, fragment records kept before they are sent, bytes of fragments merged at once (about 120 bytes of memory each).
CHUNK, RECORDS, UNIT = 1 << 19, 1 << 19, 1 << 18
#: Bytes of text to a bucket, bytes of fragments and number of settled starts kept before they are sent, bytes sent at once.
BUCKET, CUT, SETTLED, SENT = 6_000_000, 1 << 22, 1 << 17, 1 << 22
#: Text of the distinct fragments of a key from which on it is dealt start by start; keys known beforehand at most; one in so many documents tells them.
HOT_BYTES, MOST_SPLIT, SAMPLE = 1 << 19, 1_000_000, 16
COPY, MERGE, HOT = 0, 1, 2
HOT_SEED = 11

_RECORD = np.dtype([("key", "<u8"), ("hash", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("start", "<u4"), ("starts", "<u2"), ("flag", "u1")])
_PIECE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("start", "<u4"), ("starts", "<u2")])
_SPAN = np.dtype([("doc", "<i8"), ("text", "<i8"), ("a", "<i8"), ("z", "<i8")])
_U = np.uint64


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes at each place, by doubling."""
    h = (b.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
    width = 1
    while width < GRAM:
        right = h[width:]
        h = h[:-width] * _U(0xD6E8FEB86659FD93 + 2 * width) + (right ^ (right >> _U(29)))
        width *= 2
    h ^= h >> _U(31)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(30)
    return h


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    return h if reach == width else np.minimum(h[: -(width - reach)], h[width - reach :])


def fragments(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, number of starts, key, has an inner repeat) of each fragment; ends: where each document ends in b."""
    none = np.zeros(0, np.int64)
    if len(b) < SPAN:
        return none, none, none, none.astype(_U), none.astype(bool)
    grams = _gram_hashes(b)
    least = _window_min(grams, SPAN - GRAM + 1)
    sizes = np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(len(ends)), np.maximum(sizes - SPAN + 1, 0))
    begins = ends - sizes
    s = ranges(begins, np.maximum(sizes - SPAN + 1, 0))
    if not len(s):
        return none, none, none, none.astype(_U), none.astype(bool)
    v = least[s]
    same = (v[1:] == v[:-1]) & (doc[1:] == doc[:-1])
    first = np.flatnonzero(np.concatenate(([True], ~same)))
    long = np.diff(np.append(first, len(s)))
    if (long > RUN).any():
        parts = -(-long // RUN)
        first = np.repeat(first, parts) + RUN * ranges(np.zeros(len(parts), np.int64), parts)
        long = np.diff(np.append(first, len(s)))
    inner = np.append((grams[s[:-1]] == v[:-1]) & same, False)
    return doc[first], s[first] - begins[doc[first]], long, v[first], np.logical_or.reduceat(inner, first)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, hash) of the different fragments of a batch."""
    for batch in batches:
        for records in _batches_of_records(batch):
            both = np.unique(records[["key", "hash"]])
            yield pa.RecordBatch.from_arrays([pa.array(both["key"].view(np.int64)), pa.array(both["hash"].view(np.int64))], ["key", "hash"])


def _batches_of_records(batch: pa.RecordBatch, split: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The fragments of a batch's documents, about CHUNK bytes of text at once."""
    todo, size = [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
        raw = text.as_py()
        if len(raw) < SPAN:
            continue
        name = _signed(xxhash.xxh64_intdigest(raw, 42))  # what Spark's xxhash64 gives
        for at in range(0, len(raw) - SPAN + 1, CHUNK):  # parts of a very long text share 99 bytes
            todo.append((doc, name, at, raw[at : at + CHUNK + SPAN - 1]))
            size += len(todo[-1][3])
            if size > CHUNK:
                yield _records(todo, split)
                todo, size = [], 0
    if todo:
        yield _records(todo, split)


def _scan(buckets: int, split: np.ndarray):
    def pack(records: np.ndarray) -> Iterator[pa.RecordBatch]:
        records = records[np.lexsort((records["start"], records["text"], records["doc"], records["hash"], records["key"]))]
        again = np.append(False, (records["key"][1:] == records["key"][:-1]) & (records["hash"][1:] == records["hash"][:-1]))
        # The first of equal fragments stands for all, marked as repeated; the others are settled here.
        followed = np.append(again[1:], False) & ~again
        records["flag"][followed] |= 1
        records["flag"][again] = 4
        # Copies need no meeting: they go anywhere, evenly, by their place and not by what they hold.
        place = (records["doc"].view(_U) + records["start"]) * _U(0x9E3779B97F4A7C15) >> _U(32)
        to = (np.where(again, place, records["key"]) % _U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        records, to = records[order], to[order]
        cut = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        rows = ((b, records[a:z].tobytes()) for b, a, z in zip(to[cut].tolist(), cut.tolist(), np.append(cut[1:], len(to)).tolist(), strict=True))
        yield from _sent(rows, [("bucket", pa.int32()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for records in _batches_of_records(batch, split):
                held.append(records)
                n += len(records)
                if n > RECORDS:
                    joined, held, n = np.concatenate(held), [], 0
                    yield from pack(joined)
        if n:
            yield from pack(np.concatenate(held))

    return run


def _sent(rows: Iterator[tuple], columns: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Rows whose last value is a blob, about SENT bytes to a batch."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > SENT:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*held, strict=True), columns, strict=True)], [c for c, _ in columns])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*held, strict=True), columns, strict=True)], [c for c, _ in columns])


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _records(todo: list[tuple[int, int, int, bytes]], split: np.ndarray | None = None) -> np.ndarray:
    """The fragments' records; those of split keys (sorted) as one record for each start, keyed by its 100 bytes."""
    joined = b"".join(x[3] for x in todo)
    b = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(x[3]) for x in todo])
    doc, start, starts, key, inner = fragments(b, ends)
    begins = ends - np.array([len(x[3]) for x in todo])
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    alone = np.zeros(len(key), bool)
    if split is not None and len(split) and len(key):
        alone = split[np.minimum(np.searchsorted(split, key), len(split) - 1)] == key
    if alone.any():
        one_doc, one_start = np.repeat(doc[alone], starts[alone]), ranges(start[alone], starts[alone])
        at = begins[one_doc] + one_start
        own, other = (np.array([digest(view[a : a + SPAN], seed) for a in at.tolist()], _U) for seed in (HOT_SEED, HOT_SEED + 1))
        keep = ~alone
        doc, start, starts, key, inner = doc[keep], start[keep], starts[keep], key[keep], inner[keep]
    out = np.zeros(len(doc), _RECORD)
    begin = begins[doc] + start
    out["hash"] = np.array([digest(view[a:z]) for a, z in zip(begin.tolist(), (begin + starts + SPAN - 1).tolist(), strict=True)], _U)
    out["key"], out["starts"], out["flag"], out["start"] = key, starts, inner * 2, start
    if alone.any():
        more = np.zeros(len(own), _RECORD)
        more["key"], more["hash"], more["starts"], more["start"] = own, other, 1, one_start
        out, doc = np.concatenate((out, more)), np.concatenate((doc, one_doc))
    out["start"] += np.array([x[2] for x in todo], np.uint32)[doc]
    out["doc"] = np.array([x[0] for x in todo], np.int64)[doc]
    out["text"] = np.array([x[1] for x in todo], np.int64)[doc]
    return out


_FOUND = "doc_id long, text_hash long, key long, start long, starts int, kind int"


def _bucket(hot: int):
    def run(table: pa.Table) -> pa.Table:
        records = np.concatenate([np.frombuffer(x.as_py(), _RECORD) for x in table.column("blob")])
        copies, records = records[records["flag"] == 4], records[records["flag"] != 4]
        records = records[np.lexsort((records["start"], records["text"], records["doc"], records["hash"], records["key"]))]
        if len(records):
            new_key = np.append(True, records["key"][1:] != records["key"][:-1])
            again = np.append(False, ~new_key[1:] & (records["hash"][1:] == records["hash"][:-1]))
            first = np.flatnonzero(new_key)
            size = np.diff(np.append(first, len(records)))
            group = np.cumsum(new_key) - 1
            # Fragments that meet no other and hold no repeat of their own are done with; so is the first of equal ones.
            distinct = np.add.reduceat((~again).astype(np.int64), first)
            meeting = (distinct > 1) | (np.bitwise_or.reduceat(records["flag"], first) & 2 > 0)
            text = np.add.reduceat(np.where(again, 0, records["starts"].astype(np.int64) + SPAN - 1), first)
            crowded = (distinct > hot) | ((text > HOT_BYTES) & (distinct > 1))
            kind = np.where(again, COPY, np.where(crowded[group], HOT, MERGE))
            keep = meeting[group] | again
            records, kind = records[keep], kind[keep]
        else:
            kind = np.zeros(0, np.int64)
        both = np.concatenate((copies, records))
        kinds = np.concatenate((np.full(len(copies), COPY), kind))
        return pa.table({"doc_id": both["doc"], "text_hash": both["text"], "key": both["key"].view(np.int64), "start": both["start"].astype(np.int64), "starts": both["starts"].astype(np.int32), "kind": kinds.astype(np.int32)})

    return run


def _cut(buckets: int):
    """Documents with their listed fragments -> the fragments' text, dealt to buckets.

    n: so many fragments with their text; below 0: so many spans that are settled, without text. Of the strings of a crowded
    key each is sent once, whatever number of documents or places of a periodic text holds it; the first stands for all.
    """

    def pack(pieces: list[tuple], texts: list[bytes], seen: dict[bytes, tuple], settled: list[tuple]) -> Iterator[pa.RecordBatch]:
        pieces = pieces + [(xxhash.xxh64_intdigest(x, HOT_SEED), *place, 1) for x, place in seen.items()]
        texts = texts + list(seen)

        def rows() -> Iterator[tuple]:
            if pieces:
                known = np.array(pieces, _PIECE)
                to = (known["key"] % _U(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cut = np.flatnonzero(np.append(True, np.diff(to[order]) != 0))
                for b, i in zip(to[order][cut].tolist(), np.split(order, cut[1:]), strict=True):
                    yield b, len(i), known[i].tobytes() + b"".join(texts[j] for j in i.tolist())
            if settled:
                spans = _runs(np.array(settled, np.int64))
                yield int(spans["doc"][0]) % buckets, -len(spans), spans.tobytes()

        yield from _sent(rows(), [("bucket", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, texts, seen, settled, size = [], [], {}, [], 0
        for batch in batches:
            for doc, name, text, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
                raw = text.as_py()
                for x in listed.as_py():
                    part = raw[x["start"] : x["start"] + x["starts"] + SPAN - 1]
                    if x["kind"] == HOT:
                        for i in range(x["starts"]):
                            string, place = part[i : i + SPAN], (doc, name, x["start"] + i)
                            first = seen.setdefault(string, place)
                            if first is place:
                                size += SPAN
                                continue
                            settled.append(max(first, place))
                            if place < first:
                                seen[string] = place
                    else:
                        texts.append(part)
                        pieces.append((x["key"] & (2**64 - 1), doc, name, x["start"], x["starts"]))
                        size += len(part)
                    if size > CUT or len(settled) > SETTLED:
                        yield from pack(pieces, texts, seen, settled)
                        pieces, texts, seen, settled, size = [], [], {}, [], 0
        yield from pack(pieces, texts, seen, settled)

    return run


def _runs(places: np.ndarray) -> np.ndarray:
    """Rows (document, text, start) -> spans of starts that follow each other."""
    places = places[np.lexsort((places[:, 2], places[:, 1], places[:, 0]))]
    new = np.flatnonzero(np.append(True, (places[1:, :2] != places[:-1, :2]).any(axis=1) | (places[1:, 2] > places[:-1, 2] + 1)))
    out = np.empty(len(new), _SPAN)
    out["doc"], out["text"], out["a"] = places[new].T
    out["z"] = places[np.append(new[1:], len(places)) - 1, 2]
    return out


def _blocks(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 20 bytes at each place, as two numbers of eight bytes and one of four."""
    x = np.append(text, np.zeros(STEP, np.uint8)).astype(_U)
    for width in (1, 2):
        x = (x[:-width] << _U(8 * width)) | x[width:]
    eight = (x[:-4] << _U(32)) | x[4:]
    return eight[at], eight[at + 8], x[at + 16]


def _hashed(blocks: tuple[np.ndarray, np.ndarray, np.ndarray], seed: int) -> np.ndarray:
    a, b, c = blocks
    s = _U(seed)
    h = (a ^ (a >> _U(32))) * s
    h = ((h ^ (h >> _U(29))) + b) * s
    h = ((h ^ (h >> _U(32))) + c) * s
    return h ^ (h >> _U(31))


def _same(blocks: tuple, i: np.ndarray, j: np.ndarray) -> bool:
    return all((x[i] == x[j]).all() for x in blocks)


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank from 1): equal keys have equal ranks."""
    order = np.argsort(keys)
    rank = np.empty(len(keys), _U)
    new = np.empty(len(keys), bool)
    new[:1] = True
    sorted_keys = keys[order]
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:])
    rank[order] = np.cumsum(new, dtype=_U)
    return order, rank


class _Transform:
    """A shard's multi-string Burrows-Wheeler transform over symbols of 20 bytes.

    Suffixes start at every byte that a whole symbol follows, and go on in steps of a symbol to their fragment's end;
    what ends sorts first. They are sorted by their first five symbols, by doubling: one, two, four, five.
    """

    def __init__(self, hashes: np.ndarray, blocks: tuple, lo: int, hi: int, local: np.ndarray, count: np.ndarray):
        self.lo, n = lo, hi - lo
        order, self.symbol = _dense(hashes[lo:hi])
        first = np.flatnonzero(np.diff(self.symbol[order], prepend=_U(0)))
        #: The dictionary: hashes of the symbols that occur, ascending, and a place of each.
        self.names, self.at = hashes[lo + order[first]], lo + order[first]
        tied = np.setdiff1d(np.arange(n), first, assume_unique=True)
        self.sound = _same(blocks, lo + order[tied], lo + order[tied - 1])
        self.rest = (count - local)[lo:hi]  # places of the fragment from here on
        behind = lambda rank, k: np.where(self.rest > k, np.append(rank[k:], np.zeros(k, _U))[:n], _U(0))
        _, two = _dense(self.symbol << _U(32) | behind(self.symbol, STEP))
        _, four = _dense(two << _U(32) | behind(two, 2 * STEP))
        self.order, self.five = _dense(four << _U(32) | behind(self.symbol, 4 * STEP))

    def occurrences(self) -> np.ndarray:
        """For each symbol, the places of the transform at which it stands, plus one; 0 for a symbol that nothing follows."""
        place = np.empty(len(self.order), _U)
        place[self.order] = np.arange(1, len(self.order) + 1, dtype=_U)
        n = len(place)
        after = np.where(self.rest > STEP, np.append(place[STEP:], np.zeros(STEP, _U))[:n], _U(0))
        return np.sort(self.symbol << _U(32) | after)


def _interleaved(a: _Transform, b: _Transform, blocks: tuple) -> np.ndarray | None:
    """For each suffix of a: the place in b's order of the suffixes with the same five symbols, -1 if there are none. None if hashes collide."""
    at = np.searchsorted(b.names, a.names)
    known = np.flatnonzero(at < len(b.names))
    known = known[b.names[at[known]] == a.names[known]]
    if not _same(blocks, a.at[known], b.at[at[known]]):
        return None
    there = np.zeros(len(a.names) + 1, bool)
    there[known + 1] = True
    base = np.zeros(len(a.names) + 1, _U)
    base[1:] = (at.astype(_U) + _U(1)) << _U(32)  # b's number of the symbol
    listed = b.occurrences()
    # Only suffixes whose symbol b has can stay intervals; they are asked in a's order, so that queries ascend.
    going = a.order[there[a.symbol[a.order]]]
    n = len(a.symbol)
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    head = base[a.symbol[going]]
    low[going] = np.searchsorted(listed, head)
    high[going] = np.searchsorted(listed, head | _U(len(listed) + 1))
    for _ in range(SPAN // STEP - 1):
        going = going[a.rest[going] > STEP]
        going = going[high[going + STEP] > low[going + STEP]]
        head = base[a.symbol[going]]
        new_low = np.searchsorted(listed, head | (low[going + STEP] + 1).astype(_U))
        new_high = np.searchsorted(listed, head | (high[going + STEP] + 1).astype(_U))
        low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low[going], high[going] = new_low, new_high
    return np.where(high > low, low, -1)


def merged_repeats(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of all starts of all fragments, one after another: does its 100-byte string start earlier in this list?

    text: the fragments one after another; starts: the number of starts of each, in ascending order of their place in the corpus.
    """
    sizes = starts + SPAN - 1
    counts = sizes - STEP + 1  # places with a whole symbol
    n = int(counts.sum())
    count = np.repeat(counts, counts)
    local = ranges(np.zeros(len(starts), np.int64), counts)
    real = local < np.repeat(starts, counts)
    blocks = _blocks(text, ranges(np.cumsum(sizes) - sizes, counts))
    ends = np.cumsum(counts)
    cut = int(ends[np.searchsorted(ends, n // 2)]) if len(starts) > 1 else n  # the shards are whole fragments
    edges = [(0, cut)] + ([(cut, n)] if cut < n else [])
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93):
        hashes = _hashed(blocks, seed)
        shards = [_Transform(hashes, blocks, lo, hi, local, count) for lo, hi in edges]
        if not all(s.sound for s in shards):
            continue
        repeat = np.zeros(n, bool)
        for s, (lo, hi) in zip(shards, edges, strict=True):
            own = np.flatnonzero(real[lo:hi])
            first = np.empty(hi - lo + 1, np.int64)
            first[s.five[own[::-1]]] = own[::-1]  # of equal ones the last written is the earliest
            repeat[lo + own] = first[s.five[own]] != own
        if len(shards) == 2:
            a, b = shards
            met = _interleaved(a, b, blocks)
            if met is None:
                continue
            met = met[real[:cut] & (met >= 0)]
            # What a has too starts earlier there. b's interval is the class of the suffix at its first place.
            seen = np.zeros(n - cut + 1, bool)
            seen[b.five[b.order[met]]] = True
            repeat[cut:] |= seen[b.five] & real[cut:]
        return repeat[real]
    raise RuntimeError("four hash functions collided")


def _settle(rows: np.ndarray, text: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows left, rows that repeat another's string): of fragments of one key and one start, those equal to the key's first."""
    one = np.flatnonzero(rows["starts"] == 1)
    one = one[np.lexsort((rows["start"][one], rows["text"][one], rows["doc"][one], rows["key"][one]))]
    new = np.append(True, rows["key"][one][1:] != rows["key"][one][:-1])[: len(one)]
    head = one[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(one) else one
    again = np.zeros(len(rows), bool)
    follows = np.flatnonzero(~new)
    window = np.arange(SPAN)
    for i in np.array_split(follows, -(-len(follows) // 10_000)) if len(follows) else ():
        again[one[i]] = (text[begin[one[i]][:, None] + window] == text[begin[head[i]][:, None] + window]).all(axis=1)
    return np.flatnonzero(~again), np.flatnonzero(again)


def _merge(table: pa.Table) -> pa.Table:
    rows, texts, settled = [np.zeros(0, _PIECE)], [np.zeros(0, np.uint8)], [np.zeros(0, _SPAN)]
    for n, blob in zip(table.column("n").to_pylist(), table.column("blob"), strict=True):
        blob = blob.as_buffer()
        if n < 0:
            settled.append(np.frombuffer(blob, _SPAN, -n))
            continue
        rows.append(np.frombuffer(blob, _PIECE, n))
        texts.append(np.frombuffer(blob, np.uint8, offset=n * _PIECE.itemsize))
    rows, text = np.concatenate(rows), np.concatenate(texts)
    settled = np.concatenate(settled)
    del texts
    sizes = rows["starts"].astype(np.int64) + SPAN - 1
    begin = np.cumsum(sizes) - sizes
    left, again = _settle(rows, text, begin)
    docs, names = [settled["doc"], rows["doc"][again]], [settled["text"], rows["text"][again]]
    froms, tos = [settled["a"], rows["start"][again]], [settled["z"], rows["start"][again]]
    rows, sizes, begin = rows[left], sizes[left], begin[left]
    by_key = np.argsort(rows["key"], kind="stable")
    last_of_key = np.append(rows["key"][by_key][1:] != rows["key"][by_key][:-1], True)[: len(rows)]
    # A string that is left alone under its key meets no other.
    alone = last_of_key & np.append(True, last_of_key[:-1])[: len(rows)] & (rows["starts"][by_key] == 1)
    by_key, last_of_key = by_key[~alone], last_of_key[~alone]
    # Units: whole keys, of UNIT + HOT_BYTES at most.
    filled = np.cumsum(sizes[by_key])
    cuts, base = [0], 0
    for i in np.flatnonzero(last_of_key).tolist():
        if filled[i] - base >= UNIT or i == len(by_key) - 1:
            cuts.append(i + 1)
            base = filled[i]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        ids = by_key[lo:hi]
        ids = ids[np.lexsort((rows["start"][ids], rows["text"][ids], rows["doc"][ids]))]
        starts = rows["starts"][ids].astype(np.int64)
        repeat = merged_repeats(text[ranges(begin[ids], sizes[ids])], starts)
        owner = np.repeat(np.arange(len(ids)), starts)
        local = ranges(np.zeros(len(ids), np.int64), starts)
        on = np.flatnonzero(repeat)
        if not len(on):
            continue
        new = np.flatnonzero(np.append(True, (on[1:] != on[:-1] + 1) | (owner[on[1:]] != owner[on[:-1]])))
        a, z = on[new], on[np.append(new[1:], len(on)) - 1]
        who = ids[owner[a]]
        docs.append(rows["doc"][who])
        names.append(rows["text"][who])
        froms.append(rows["start"][who] + local[a])
        tos.append(rows["start"][who] + local[z])
    flat = lambda xs: np.concatenate([x.astype(np.int64) for x in xs])
    return pa.table({"doc_id": flat(docs), "text_hash": flat(names), "a": flat(froms), "z": flat(tos)})


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, listed in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
            raw = text.as_py()
            cover: list[list[int]] = []
            for a, z in sorted((x["a"], x["z"] + SPAN) for x in listed.as_py() or ()):
                if cover and a <= cover[-1][1]:
                    cover[-1][1] = max(z, cover[-1][1])
                else:
                    cover.append([a, z])
            kept = hashlib.sha256()
            at = 0
            for a, z in cover:
                kept.update(memoryview(raw)[at:a])
                at = z
            kept.update(memoryview(raw)[at:])
            out.append((doc, len(raw), sum(z - a for a, z in cover), len(cover), kept.hexdigest(), [a for a, _ in cover], [z for _, z in cover]))
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "span_starts", "span_ends"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _split_keys(base: DataFrame, hot_fragments: int) -> np.ndarray:
    """Keys that the sample shows to be crowded, ascending; of very many, those with the most fragments. Others are dealt with in _bucket."""
    some = base.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(SAMPLE)) == 0)
    seen = some.mapInArrow(_keys, "key long, hash long").distinct().groupBy("key").count()
    crowded = seen.where(F.col("count") >= max(2, hot_fragments // (2 * SAMPLE))).orderBy(F.col("count").desc(), "key").limit(MOST_SPLIT)
    return np.sort(np.array([r.key for r in crowded.collect()], np.int64).view(_U))


def suffix_dedup(docs: DataFrame, hot_fragments: int = 50_000, buckets: int | None = None) -> DataFrame:
    """One row per row: n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans (see the module's text).

    hot_fragments: from so many distinct fragments of one key on, that key is dealt by whole 100-byte strings.
    """
    every = id_and_text(docs)
    base = every.dropDuplicates(["doc_id", "text"]) if _repeats_ids(docs) else every
    buckets = buckets or _buckets(every)
    split = _split_keys(base, hot_fragments)
    sent = base.mapInArrow(_scan(buckets, split), "bucket int, blob binary")
    found = materialize(sent.groupBy("bucket").applyInArrow(_bucket(hot_fragments), _FOUND), "suffix-fragments")
    name = lambda df: df.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    listed = found.where(F.col("kind") != COPY).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("key", "start", "starts", "kind")).alias("listed"))
    pieces = name(base).join(listed.hint("shuffle_hash"), ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "listed")
    merged = pieces.mapInArrow(_cut(buckets), "bucket int, n int, blob binary").groupBy("bucket").applyInArrow(_merge, "doc_id long, text_hash long, a long, z long")
    copies = found.where(F.col("kind") == COPY).select("doc_id", "text_hash", F.col("start").alias("a"), (F.col("start") + F.col("starts") - 1).alias("z"))
    spans = merged.unionByName(copies).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("a", "z")).alias("spans"))
    whole = name(every).join(spans.hint("shuffle_hash"), ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans")
    out = whole.mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, span_starts array<long>, span_ends array<long>")
    return out.select(id_back(), *[c for c in out.columns if c != "doc_id"])


def _buckets(every: DataFrame) -> int:
    """By the text itself: files of copies are far smaller than what they hold."""
    total = every.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return int(min(1_000_000, max(8, -(-total // BUCKET))))


def _repeats_ids(docs: DataFrame) -> bool:
    """Whether a doc_id occurs twice; reads one column."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return bool(ids.groupBy("doc_id").count().where("count > 1").limit(1).count())
