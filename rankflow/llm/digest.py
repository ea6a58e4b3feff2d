"""Fingerprints of documents by quartile bucket digests.

Every three bytes in a row of a text are hashed to one of 256 buckets. A digest holds, for each bucket, in which quartile of
the 256 counts its own count lies (two bits), and the text's length in steps of an eighth of each power of two. So a
digest hardly changes where a small part of the text does. Two digests differ by the sum over buckets of how far their
quartiles lie apart (opposite ends count double), and by a bounded number of length steps; the difference is bounded in all,
and likeness is 1 at no difference and 0 at the bound.

To compare each document with the next by descending id, documents are dealt to tasks by ranges of id and sorted there: the
one shuffle of their texts. A task holds one batch and one row before it. Where ranges meet, the last row of one and the
first of the next are kept with their texts, in the same table as all results, and compared afterwards: two
rows a range. Ids that repeat are dealt by a hash of the text too, so no id is a hot group.

Defined cases: null texts are empty; an empty text has count zero everywhere, and texts of one or two bytes count once, as if zero bytes
followed; equal texts have equal digests; rows of one id follow each other by a hash of their texts, then by the texts;
null ids come last; texts of any length are read as a whole, in pieces; a single document is its own next; an empty table gives an empty
result; only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankflow.llm.common import materialize

BUCKETS = 256
#: What a step of length counts, how many steps count at most, and the bound of the whole difference.
STEP, STEPS, BOUND = 28, 12, 512
_MULTIPLIER = 2654435761
#: Bytes counted at once.
_PIECE = 1 << 21
_ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


def counts(texts: list[bytes]) -> np.ndarray:
    """How many triplets of each text fall into each bucket: texts x BUCKETS."""
    out = np.zeros((len(texts), BUCKETS), np.int64)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _PIECE):
            size += len(texts[end])
            end += 1
        if end == at + 1:
            for low in range(0, max(1, size - 2), _PIECE):  # two bytes more than a piece, for its last triplets
                out[at] += _counted([texts[at][low : low + _PIECE + 2]])[0]
        else:
            out[at:end] = _counted(texts[at:end])
        at = end
    return out


def _counted(texts: list[bytes]) -> np.ndarray:
    texts = [t + b"\0" * (3 - len(t)) if 0 < len(t) < 3 else t for t in texts]
    sizes = np.array([len(t) for t in texts])
    # Two bytes after each text; triplets that reach into them are left out.
    b = np.frombuffer(b"\0\0".join([*texts, b""]), np.uint8).astype(np.uint32)
    of = np.repeat(np.arange(len(texts)), np.maximum(sizes - 2, 0))
    starts = np.cumsum(sizes + 2) - (sizes + 2)
    own = np.maximum(sizes - 2, 0)
    at = np.arange(len(of)) + np.repeat(starts - (np.cumsum(own) - own), own)
    bucket = ((b[at] | b[at + 1] << np.uint32(8) | b[at + 2] << np.uint32(16)) * np.uint32(_MULTIPLIER)) >> np.uint32(24)
    return np.bincount(of * BUCKETS + bucket, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)


def codes(counted: np.ndarray) -> np.ndarray:
    """0 to 3 for each bucket: how many of the three quartiles of its text's counts its own count exceeds."""
    s = np.sort(counted, axis=1)
    return sum((counted > s[:, BUCKETS * k // 4 - 1, None]).astype(np.int64) for k in (1, 2, 3))


def length_codes(sizes: np.ndarray) -> np.ndarray:
    """Eight steps for each doubling of the number of bytes; 0 for none."""
    fraction, power = np.frexp(np.asarray(sizes, np.float64))
    return np.where(np.asarray(sizes) > 0, 8 * power + np.floor((fraction - 0.5) * 16), 0).astype(np.int64)


def digests(texts: list[bytes]) -> list[str]:
    """Three hex digits for the length, then one for each two buckets."""
    if not texts:
        return []
    c = codes(counts(texts))
    body = (c[:, 0::4] << 6 | c[:, 1::4] << 4 | c[:, 2::4] << 2 | c[:, 3::4]).astype(np.uint8)
    return [f"{n:03x}{row.tobytes().hex()}" for n, row in zip(length_codes(np.array([len(t) for t in texts])).tolist(), body, strict=True)]


def likenesses(a: list[str], b: list[str]) -> np.ndarray:
    """From 1 (no difference) to 0 (the bound)."""
    if not a:
        return np.zeros(0)

    def read(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        body = np.frombuffer(bytes.fromhex("".join(d[3:] for d in found)), np.uint8).reshape(len(found), -1).astype(np.int64)
        return np.array([int(d[:3], 16) for d in found]), np.stack([body >> 6, body >> 4 & 3, body >> 2 & 3, body & 3], axis=2)

    (size_a, code_a), (size_b, code_b) = read(a), read(b)
    apart = np.abs(code_a - code_b)
    difference = (apart + 3 * (apart == 3)).sum((1, 2)) + STEP * np.minimum(np.abs(size_a - size_b), STEPS)
    return 1 - np.minimum(difference, BOUND) / BOUND


def _compared(ids: list[int | None], texts: list[str], after: list[str], own: list[str], next_own: list[str]) -> list[list]:
    """The columns of _ROWS for documents with their digests, and the texts and digests of those after them."""
    edited = []
    for text, follow in zip(texts, after, strict=True):
        cut = len(text) // 3
        edited.append((text[: len(text) - cut] + follow[:cut]).encode())
    new = digests(edited)
    hashed = [hashlib.sha256(e).hexdigest() for e in edited]
    return [ids, [len(t) for t in texts], hashed, own, new, likenesses(own, new).tolist(), likenesses(own, next_own).tolist()]


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows but the last of a sorted range; the first and the last row with their texts, by `end`."""
    part, held, first = TaskContext.get().partitionId(), None, None

    def rows(columns: list[list], end: str | None, texts: list[str | None]) -> pa.RecordBatch:
        n = len(columns[0])
        arrays = [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * n, pa.int32()), pa.array([end] * n, pa.string()), pa.array(texts, pa.string())], [*_NAMES, "part", "end", "text"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        own = digests([t.encode() for t in texts])
        if held is None:
            first = (ids[0], texts[0], own[0])
        else:
            ids, texts, own = [held[0], *ids], [held[1], *texts], [held[2], *own]
        if len(ids) > 1:
            yield rows(_compared(ids[:-1], texts[:-1], texts[1:], own[:-1], own[1:]), None, [None] * (len(ids) - 1))
        held = (ids[-1], texts[-1], own[-1])
    if held is not None:
        for end, (doc_id, text, own) in (("first", first), ("last", held)):
            yield rows([[doc_id], [len(text)], [None], [own], [None], [None], [None]], end, [text])


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = _compared(*[c.to_pylist() for c in batch.columns])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of each document, without any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(digests([t.encode() for t in texts]), pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return _slim(docs).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def likeness(pairs: DataFrame, left: str, right: str, name: str = "likeness") -> DataFrame:
    """pairs with the likeness of two columns of fingerprints; null where one is missing."""

    @F.pandas_udf("double")
    def of(a, b):
        known = a.notna() & b.notna()
        out = a.astype("object").where(known, None).map(lambda _: np.nan).astype("float64")
        out[known] = likenesses(a[known].tolist(), b[known].tolist())
        return out

    return pairs.withColumn(name, F.nanvl(of(F.col(f"`{left}`"), F.col(f"`{right}`")), F.lit(None).cast("double")))


def document_digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by as much of the beginning of the next document, by descending id.
    """
    slim = _slim(docs).withColumn("_h", F.xxhash64("text"))
    down = F.col("doc_id").desc_nulls_last()
    ordered = slim.repartitionByRange(down, "_h").sortWithinPartitions(down, "_h", "text")
    found = materialize(ordered.select("doc_id", "text").mapInArrow(_within, f"{_ROWS}, part int, end string, text string"), "digests")
    firsts = found.where("end = 'first'").select("part", F.col("text").alias("after"), F.col("fingerprint").alias("next_own"))
    # One row for each range: who comes after whom; the first one after the last.
    everything = Window.orderBy("part")
    follows = firsts.select("part").withColumn("follow", F.coalesce(F.lead("part").over(everything), F.min("part").over(everything)))
    lasts = found.where("end = 'last'").select("part", "doc_id", "text", F.col("fingerprint").alias("own"))
    ends = lasts.join(follows, "part").join(firsts.withColumnRenamed("part", "follow"), "follow").select("doc_id", "text", "after", "own", "next_own")
    return found.where("end IS NULL").select(*_NAMES).unionAll(ends.mapInArrow(_between, _ROWS))


def digest_sql() -> str:
    """The same as document_digests, in DuckDB's SQL, where ids do not repeat."""
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) // 3 AS cut, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS follow,
  coalesce(lead(text) OVER w, first_value(text) OVER w) AS after FROM t WINDOW w AS (ORDER BY doc_id DESC NULLS LAST)),
e AS (SELECT doc_id, text, follow, substr(text, 1, length(text) - cut) || substr(after, 1, cut) AS edited FROM n),
x AS (SELECT doc_id, 0 AS kind, text AS s FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
b AS (SELECT doc_id, kind, octet_length(encode(s)) AS size,
  list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda h: ('0x' || h)::BIGINT) AS l FROM x),
c AS (SELECT doc_id, kind, size, CASE WHEN size IN (1, 2) THEN list_concat(l, [0, 0]) ELSE l END AS l FROM b),
k AS (SELECT doc_id, kind, unnest(list_transform(range(1, CASE WHEN size IN (1, 2) THEN 2 ELSE greatest(size - 1, 1) END),
  lambda i: ((((l[i] + 256 * l[i + 1] + 65536 * l[i + 2]) * {_MULTIPLIER}) & 4294967295) >> 24))) AS bucket FROM c),
g AS (SELECT doc_id, kind, bucket, count(*) AS n FROM k GROUP BY ALL),
f AS (SELECT doc_id, kind, size, r.bucket, coalesce(g.n, 0) AS n FROM b CROSS JOIN range({BUCKETS}) AS r(bucket) LEFT JOIN g USING (doc_id, kind, bucket)),
q AS (SELECT doc_id, kind, list_sort(list(n)) AS s FROM f GROUP BY ALL),
o AS (SELECT doc_id, kind, size, bucket, (n > s[{BUCKETS // 4}])::BIGINT + (n > s[{BUCKETS // 2}])::BIGINT + (n > s[{3 * BUCKETS // 4}])::BIGINT AS code FROM f JOIN q USING (doc_id, kind)),
z AS (SELECT doc_id, kind, list(code ORDER BY bucket) AS codes,
  CASE WHEN any_value(size) = 0 THEN 0 ELSE 8 * length(bin(any_value(size))) + floor((any_value(size) / pow(2, length(bin(any_value(size)))) - 0.5) * 16)::BIGINT END AS steps
 FROM o GROUP BY ALL),
y AS (SELECT doc_id, kind, codes, steps, lpad(lower(to_hex(steps)), 3, '0') ||
  array_to_string(list_transform(range(1, {BUCKETS // 2 + 1}), lambda i: lower(to_hex(4 * codes[2 * i - 1] + codes[2 * i]))), '') AS digest FROM z),
m AS (SELECT e.doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, y0.digest AS fingerprint, y1.digest AS edited_fingerprint,
  y0.codes AS c0, y1.codes AS c1, y2.codes AS c2, y0.steps AS s0, y1.steps AS s1, y2.steps AS s2
 FROM e JOIN y y0 ON y0.doc_id = e.doc_id AND y0.kind = 0 JOIN y y1 ON y1.doc_id = e.doc_id AND y1.kind = 1 JOIN y y2 ON y2.doc_id = e.follow AND y2.kind = 0)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
 1 - least({BOUND}, {STEP} * least(abs(s0 - s1), {STEPS}) + list_sum(list_transform(range(1, {BUCKETS + 1}), lambda i: [0, 1, 2, 6][abs(c0[i] - c1[i]) + 1]))) / {BOUND}.0::DOUBLE AS near_edited,
 1 - least({BOUND}, {STEP} * least(abs(s0 - s2), {STEPS}) + list_sum(list_transform(range(1, {BUCKETS + 1}), lambda i: [0, 1, 2, 6][abs(c0[i] - c2[i]) + 1]))) / {BOUND}.0::DOUBLE AS near_next
FROM m"""
