"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within radius bits of each other share a variant within half the radius of both, and any two that
share one are within the radius, so the collisions on variants are exactly the links. A fingerprint has 2,081 variants
within two bits. They are dealt out by their leading bits: a fingerprint is sent once to each of the few prefixes that
its variants have (37 of 256), and the task of a prefix makes the variants with that prefix and sorts them. Per variant,
the smallest member is linked to the others, never all pairs. Equal fingerprints are one node, so copies meet before
that. A prefix with many fingerprints is worked off in parts by further bits.

Defined cases: null and blank texts have fingerprint zero and are linked like any other; fewer words than a shingle
give one shingle of all of them; a bit that exactly half of the hashes have is 0; a null doc_id is the smallest id; repeated
rows give a row each; texts of any length are read as a whole; an empty table gives an empty result; simhash_classes reads
doc_id and text only, keep_one keeps all columns, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import id_and_text, id_back, materialize
from rankflow.llm.graph import components

_U = np.uint64
_ENTRY = np.dtype([("print", "<u8"), ("node", "<i8")])
#: Variants sorted at once.
ROOM = 1 << 21


def fingerprint(raw: bytes, words_each: int = 4) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    m = max(1, len(words) - words_each + 1)
    view, digest = memoryview(joined), xxhash.xxh64_digest
    last = (start + size)[min(words_each, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, m, 1 << 16):
        d = b"".join([digest(view[a:z], 42) for a, z in zip(start[at : min(at + (1 << 16), m)].tolist(), last[at : at + (1 << 16)].tolist(), strict=False)])
        ones += np.unpackbits(np.frombuffer(d, np.uint8)).reshape(-1, 64).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > m).tobytes(), "big")


def _prints(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(x.as_buffer().to_pybytes(), words_each) for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(made, _U).view(np.int64))], ["doc_id", "print"])

    return run


def _flips(bits: int, most: int) -> np.ndarray:
    """Masks with at most so many ones among the lowest bits, fewest first."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)], _U)


def _deal(bits: int, half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _flips(bits, half)
        for batch in batches:
            entry = np.empty(batch.num_rows, _ENTRY)
            entry["print"] = batch.column(0).to_numpy().view(_U)
            entry["node"] = batch.column(1).to_numpy()
            top = entry["print"] >> _U(64 - bits) if bits else np.zeros(len(entry), _U)
            to = (top[:, None] ^ masks[None, :]).ravel()
            order = np.argsort(to, kind="stable")
            who, to = order // len(masks), to[order]
            cut = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            blobs = [entry[i].tobytes() for i in np.split(who, cut[1:])] if len(to) else []
            yield pa.RecordBatch.from_arrays([pa.array(to[cut].astype(np.int64)) if len(to) else pa.array([], pa.int64()), pa.array(blobs, pa.binary())], ["prefix", "blob"])

    return run


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def collide(prints: np.ndarray, nodes: np.ndarray, prefix: int, bits: int, half: int, room: int = ROOM) -> np.ndarray:
    """Links (larger node, smaller node) of fingerprints that share a variant with the given leading bits."""
    low = 64 - bits
    top = prints >> _U(low) if bits else np.zeros(len(prints), _U)
    away = _popcount(top ^ _U(prefix))
    own = away <= half
    prints, nodes, away = prints[own], nodes[own], away[own]
    sizes = [len(_flips(low, half - k)) for k in range(half + 1)] if low > 12 else [1 << low] * (half + 1)
    if len(prints) < 2:
        return np.zeros((0, 2), np.int64)
    if sum(np.bincount(away, minlength=half + 1) * sizes) > room and low > 16:
        parts = [collide(prints, nodes, prefix * 16 + k, bits + 4, half, room) for k in range(16)]
        return np.unique(np.concatenate(parts), axis=0)
    base = (_U(prefix) << _U(low) if bits else _U(0)) | (prints & _U((1 << low) - 1))
    variants, owners = [], []
    for k in range(half + 1):
        who = np.flatnonzero(away == k)
        masks = _flips(low, half - k)
        variants.append((base[who][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(who, len(masks)))
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variant)
    variant, owner = variant[order], owner[order]
    same = variant[1:] == variant[:-1]
    shared = np.flatnonzero(np.append(False, same) | np.append(same, False))
    if not len(shared):
        return np.zeros((0, 2), np.int64)
    variant, owner = variant[shared], owner[shared]
    first = np.flatnonzero(np.append(True, variant[1:] != variant[:-1]))
    smallest = np.repeat(np.minimum.reduceat(nodes[owner], first), np.diff(np.append(first, len(owner))))
    pairs = np.stack((nodes[owner], smallest), 1)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def _collide(bits: int, half: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        entry = np.concatenate([np.frombuffer(x.as_py(), _ENTRY) for x in table.column("blob")])
        pairs = collide(entry["print"].copy(), entry["node"].copy(), key[0].as_py(), bits, half)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def fingerprints(docs: DataFrame, words_each: int = 4) -> DataFrame:
    """(doc_id, print long): the fingerprint of each document; doc_id is never null, see common.NULL_ID."""
    return id_and_text(docs).mapInArrow(_prints(words_each), "doc_id long, print long")


def ball_links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(print long, node long), distinct prints -> links (a, b) between nodes, enough to connect all within the radius."""
    if radius % 2:
        raise ValueError("the radius must be even")
    half = radius // 2
    n = prints.count()
    bits = int(np.clip(np.ceil(np.log2(max(1, n * len(_flips(64, half)) / ROOM))), 0, 24))
    dealt = prints.select("print", "node").mapInArrow(_deal(bits, half), "prefix long, blob binary")
    return dealt.groupBy("prefix").applyInArrow(_collide(bits, half), "a long, b long")


def _classes(docs: DataFrame, words_each: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, print) of each document, and (print, class, component_id) of each print.

    Links are between prints: rows without an id, or that repeat one, may have nothing else in common. A class is named
    by its smallest print, its component_id is its smallest doc_id.
    """
    prints = materialize(fingerprints(docs, words_each), "prints")
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    found = components(ball_links(nodes.select("print", F.col("print").alias("node")), radius)).withColumnRenamed("node", "print")
    named = nodes.join(found, "print", "left").select("print", "least", F.coalesce("component", "print").alias("class"))
    least = named.groupBy("class").agg(F.min("least").alias("component_id"))
    return prints, named.join(least, "class").select("print", "class", "component_id")


def _hex(print_: str = "print"):
    return F.lpad(F.lower(F.hex(print_)), 16, "0")


def simhash_classes(docs: DataFrame, words_each: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links)."""
    prints, classes = _classes(docs, words_each, radius)
    return prints.join(classes, "print").select(id_back(), _hex().alias("fingerprint"), id_back("component_id"))


def keep_one(docs: DataFrame, words_each: int = 4, radius: int = 4) -> DataFrame:
    """The documents, with their columns, of which each class keeps the one with the smallest doc_id.

    Where a doc_id occurs in several rows, the rows are told apart by their fingerprint and then their text.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if not ids.groupBy("doc_id").count().where("count > 1").limit(1).count():
        classes = simhash_classes(docs, words_each, radius)
        first = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id"))
        return docs.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")), "left_semi")

    @F.pandas_udf("string")
    def own(text: pd.Series) -> pd.Series:
        return pd.Series([f"{fingerprint((t or '').encode(), words_each):016x}" for t in text])

    prints, classes = _classes(docs, words_each, radius)
    chosen = prints.join(classes, "print").groupBy("class").agg(F.min(F.struct("doc_id", _hex().alias("print"))).alias("kept"))
    chosen = chosen.select(id_back("kept.doc_id").alias("kept_id"), F.col("kept.print").alias("kept_print"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), own(F.col("text").cast("string")).alias("print"))
    rows = rows.join(chosen, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("print") == F.col("kept_print")), "left_semi")
    return rows.groupBy("id", "print").agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row")).select("row.*")
