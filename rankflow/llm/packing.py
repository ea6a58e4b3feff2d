"""Best-fit packing of tokenized documents into sequences by exact-complement hashing.

Only the histogram of piece lengths (at most max_len numbers) is planned on the driver, so planning costs the same for
any corpus. The plan is a list of patterns, each a tuple of lengths and how many sequences it fills: for the largest
length left, the gap is looked up among single lengths, sums of pairs and sums of triples, and combinations that fill
it exactly are consumed as far as their counts allow; what fits nowhere exactly goes by best fit. Pieces then find
their place by their rank among the pieces of their length: ranks are counted within each task, and the tasks' counts
are summed up, so a length that a third of all pieces share is no hot group.

Ids are those of the tokenizers library, special tokens that occur in a text included: `<|endoftext|>` is its one id.

Defined cases: null text is empty and gives one piece holding only the end id; a null doc_id stays null; repeated rows
are packed once each; an empty table gives an empty result; only doc_id and text are read, whatever other columns are
called. Documents longer than max_len, however long, are cut into pieces of max_len, of which the first may be shorter;
pieces of one length are alike, so ties between them change no number of sequences.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankflow.llm.common import materialize


@cache
def _encoder(path: str):
    """text -> ids of a byte-level vocabulary; its ranks file, where there is one beside it, gives the same ids faster."""
    import os

    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if path.endswith(".json") and os.path.exists(ranks_path):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {t.content: i for i, t in Tokenizer.from_file(path).get_added_tokens_decoder().items()}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: v for k, v in ranks.items() if k.decode("utf-8", "replace") not in special}, special_tokens=special)
        return lambda text: np.asarray(encoding.encode_to_numpy(text, allowed_special="all"), np.uint32)
    return _plain_encoder(path)


def _plain_encoder(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def cut(n: int, max_len: int) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    return [n % max_len] * (n % max_len > 0) + [max_len] * (n // max_len)


def _pieces(path: str, max_len: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = _encoder(path), TaskContext.get().partitionId(), np.zeros(max_len + 1, np.int64)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                at = 0
                for k, n in enumerate(cut(len(ids), max_len)):
                    rows.append((doc, k, at, n, zlib.crc32(ids[at : at + n]), part, int(seen[n])))
                    seen[n] += 1
                    at += n
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return run


def plan(counts: np.ndarray, max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, sequences) that use counts[l] pieces of each length l exactly.

    The largest length left is taken up first. While one, two or three of the pieces left fill its gap exactly, they are
    consumed, as many times as their counts allow; only then the rest of that length goes by best fit.
    """
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def take(*lengths: int) -> None:
        need = np.bincount(lengths, minlength=len(left))
        used = np.flatnonzero(need)
        times = int((left[used] // need[used]).min())
        if times:
            left[used] -= times * need[used]
            out.append((lengths, times))

    def best_pair(total: int, *held: int) -> tuple[int, int] | None:
        """The pair of that sum of which most are left besides the pieces held; of an a + a, half as many are."""
        a = np.arange((total + 1) // 2, total)
        if not len(a):
            return None
        free = left if not held else left - np.bincount(held, minlength=len(left))
        most = np.minimum(free[a], free[total - a])
        if total % 2 == 0:
            most[0] //= 2
        at = int(np.argmax(most))
        return (int(a[at]), total - int(a[at])) if most[at] > 0 else None

    if max_len < len(left) and left[max_len]:
        take(max_len)
    for large in range(max_len - 1, 0, -1):
        gap = max_len - large
        if left[large] and left[gap] - (gap == large) > 0:
            take(large, gap)
        while left[large] and (pair := best_pair(gap, large)):
            take(large, *pair)
        if left[large] and gap > 2:
            # Sums that two lengths left could have, as bits: thirds without such a partner need no search.
            there = [int(a) for a in np.flatnonzero(left[1:gap]) + 1]
            bits = sum(1 << a for a in there)
            sums = 0
            for a in there:
                sums |= bits << a
            for a in reversed(there):
                if not left[large]:
                    break
                if not sums >> (gap - a) & 1:
                    continue
                while left[large] and left[a] - (a == large) > 0 and (pair := best_pair(gap - a, large, a)):
                    take(large, a, *pair)
        while left[large]:  # nothing fits exactly: best fit, the largest pieces that fit into what is left
            used = np.zeros_like(left)
            used[large], room, pattern = 1, gap, [large]
            while room:
                fits = np.flatnonzero(left[1 : room + 1] > used[1 : room + 1])
                if not len(fits):
                    break
                best = int(fits[-1]) + 1
                times = int(min(left[best] - used[best], room // best))
                used[best] += times
                pattern += [best] * times
                room -= times * best
            take(*pattern)
    return out


def places(patterns: list[tuple[tuple[int, ...], int]], max_len: int) -> dict[str, np.ndarray]:
    """Where the r-th piece of each length goes: rows (length, first rank, first sequence, offset), sorted by both first."""
    rank = np.zeros(max_len + 1, np.int64)
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            rows.append((n, rank[n], sequence, offset))
            rank[n] += times
            offset += n
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    starts = np.searchsorted(table[:, 0], np.arange(max_len + 2))
    return {"starts": starts, "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def _place(where: dict[str, np.ndarray], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                own, (lo, hi) = length == n, where["starts"][n : n + 2]
                at[own] = lo + np.searchsorted(where["rank"][lo:hi], rank[own], side="right") - 1
            sequence = where["sequence"][at] + rank - where["rank"][at]
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(where["offset"][at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = base.mapInArrow(_pieces(tokenizer_path, max_len, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")
    pieces = materialize(made, "pieces")
    per_task = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(max_len + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most max_len rows
        counts[row.length] = row.n
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base_rank = per_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base_rank, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    where = places(plan(counts, max_len), max_len)
    return ranked.mapInArrow(_place(where, max_len), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
