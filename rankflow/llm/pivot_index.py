"""Near-duplicate vectors by a pivot-permutation index.

Vectors are described by their nearest pivots (reference vectors), in order. Inverted lists by pivot bring together the
vectors that name it; pairs that share at least two pivots are candidates and are verified by their cosine in double
precision. A pair is judged only in the list of its smallest shared pivot (of those both are close to, where there is one), so
each link counts once.

What goes through the lists is a vector's id, its pivots and a sketch: on which side of SKETCH planes through the origin, drawn at random,
it lies. Two vectors lie on different sides of a plane with a chance of their angle over pi, so a pair at the threshold differs in
more than the allowed number of bits less than once in a hundred million times (six standard deviations), and hardly any pair of unlike vectors
passes. Shared pivots are counted and sketches compared in the lists; components are sent only where vectors have a pair left, each
vector once to each block in which it has one.

A list longer than a block is parted by the second pivot that a pair shares: each vector in it goes once to each of the
other pivots that it names, and once, if it is close, to those that are close too. So a vector is sent at most nearest x
nearest times, however long the lists are, and the lists of two pivots are far shorter than those of one. A list of two
that is still longer than a block (a large group of near but different vectors) is worked off as pairs of blocks, each a
group of its own, so a group with a third of all vectors is spread over many tasks and is never held as a whole. Of the
links of a group only the counts and one edge per vector (to the smallest vector of its local class) leave the task.
Verifying such a group takes time, and sends its vectors, with the square of its size: every link has to be counted.

Equal vectors are one node with a multiplicity and are never paired with each other. They are told by two 64-bit hashes of their components,
so that rows find their node without their components.

Pivots are the index's bounded sample: twice the square root of the number of vectors, of at most PIVOT_BYTES in all (at 64
dimensions, 131,072 of them, which the square root reaches at four thousand million vectors), the first by a hash of their
id, without those near an earlier one: else a large group of near vectors would draw as large a share of the pivots, all
about equally near to each of its vectors, whose order tells nothing. Two vectors that are both close to a pivot they
name are a candidate pair by that pivot alone. Every vector is indexed. Recall against brute force is measured in the
tests.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths do not link; rows that repeat id and vector count once as links and give a row each; vectors equally
near to several pivots name the first of them; a null vec_id is the smallest id; an empty table gives an empty result;
only vec_id and embedding are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import NULL_ID, drop, id_back, materialize, stored
from rankflow.llm.graph import components

#: Bytes of all pivots at most: what goes to every task.
PIVOT_BYTES = 1 << 26
#: A pivot has no greater cosine than this with an earlier one.
APART = 0.8
#: Planes of a sketch.
SKETCH = 128
#: From this cosine on a vector is close to a pivot. A vector within 0.9 of a pivot links at 0.95 only to such within 0.71.
CLOSE = 0.7


def _unit(vector: list | None) -> np.ndarray | None:
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()  # neither the squares of tiny nor of huge components are lost
    return v / np.linalg.norm(v)


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of a list column, filled up with zeros; their lengths; and which are vectors at all."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
    x = np.zeros((len(sizes), int(sizes.max(initial=0))))
    x[np.arange(x.shape[1]) < sizes[:, None]] = values
    top = np.abs(x).max(1, initial=0)
    ok = np.isfinite(top) & (top > 0)
    x[~ok] = 0
    x /= np.where(ok, top, 1)[:, None]  # neither the squares of tiny nor of huge components are lost
    return x / np.where(ok, np.sqrt((x * x).sum(1)), 1)[:, None], sizes, ok


def _apart(pivots: np.ndarray) -> np.ndarray:
    """The pivots, in order, without those near an earlier one that stays; block by block."""
    kept = pivots[:0]
    for at in range(0, len(pivots), 512):
        block = pivots[at : at + 512]
        if len(kept):
            block = block[(block @ kept.T).max(1) <= APART]
        near = block @ block.T > APART
        stays = np.zeros(len(block), bool)
        for i in range(len(block)):
            stays[i] = not (near[i] & stays).any()
        kept = np.concatenate([kept, block[stays]])
    return kept


def _nearest(sims: np.ndarray, k: int) -> np.ndarray:
    """The k greatest of each row, in order; of equal ones the first."""
    least = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
    on = sims >= least
    plain = on.sum(1) == k
    out = np.empty((len(sims), k), np.int64)
    at = np.nonzero(on[plain])[1].reshape(-1, k)
    out[plain] = np.take_along_axis(at, np.argsort(-np.take_along_axis(sims[plain], at, 1), axis=1, kind="stable"), 1)
    if not plain.all():
        out[~plain] = np.argsort(-sims[~plain], axis=1, kind="stable")[:, :k]
    return out


def _planes(width: int) -> np.ndarray:
    return np.random.default_rng(20).normal(size=(SKETCH, width))


def _describe(pivots: np.ndarray, nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, k = _planes(pivots.shape[1]), min(nearest, len(pivots))
        for batch in batches:
            step = max(1, (1 << 22) // len(pivots))
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                x, _, ok = _units(part.column(2))
                x, part = x[ok], part.filter(pa.array(ok))
                sims = x @ pivots[:, : x.shape[1]].T
                near = _nearest(sims, k)
                close = (np.take_along_axis(sims, near, 1) >= CLOSE).sum(1, dtype=np.int32)  # the first so many
                bits = np.packbits(x @ planes[:, : x.shape[1]].T > 0, axis=1)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(near.astype(np.int32).ravel()), k).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, pa.array(close), pa.array([b.tobytes() for b in bits], pa.binary())], ["node", "copies", "near", "n_close", "sketch"])

    return run


class _List:
    """The vectors of a list, or of two blocks of one: which pairs are judged in it."""

    def __init__(self, key: tuple, table: pa.Table, min_shared: int):
        # second: -1 in the list of one pivot; in one of two, the other; equal to the pivot, that of vectors close to it.
        self.pivot, self.second, left, right = (k.as_py() for k in key)
        self.min_shared = min_shared
        # In a pair of different blocks, links lie between the two; within one block, above the diagonal.
        side = table.column("part").to_numpy()
        order = np.argsort(side, kind="stable")
        self.table, side = table.take(order).combine_chunks(), side[order]
        self.n = n = len(side)
        self.cut = int((side == left).sum()) if left != right else 0
        self.node = self.table.column("node").to_numpy()
        self.near = self.table.column("near").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(n, -1)
        self.n_close = self.table.column("n_close").to_numpy()
        self.near_close = np.where(np.arange(self.near.shape[1]) < self.n_close[:, None], self.near, -1)
        self.close = (self.near_close == self.pivot).any(1)
        self.named, self.named_close = self._named(self.near), self._named(self.near_close)

    def _named(self, near: np.ndarray) -> np.ndarray:
        names = np.unique(near[near >= 0])
        out = np.zeros((self.n, len(names)), np.float32)
        row, place = np.nonzero(near >= 0)
        out[row, np.searchsorted(names, near[row, place])] = 1
        return out

    def blocks(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(lo, hi, first, shared): of the rows lo to hi with those from `first` on, which share pivots enough."""
        n, cut, step = self.n, self.cut, max(1, (1 << 21) // max(1, self.n))
        for lo in range(0, cut or n, step):
            hi, first = min(lo + step, cut or n), cut or lo + 1
            # A pair close to this pivot is judged in the list of its smallest shared close one, any other in that of its smallest.
            by_close = self.close[lo:hi, None] & self.close[None, first:]
            if self.second == self.pivot:
                shared = by_close
            else:
                shared = (self.named[lo:hi] @ self.named[first:].T >= self.min_shared) & (self.named_close[lo:hi] @ self.named_close[first:].T == 0)
                if self.second < 0:
                    shared |= by_close
            yield lo, hi, first, shared

    def judged(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs that share pivots enough, those whose smallest shared ones this list is of."""
        both_close = self.close[a] & self.close[b]
        sure = both_close & ((self.n_close[a] == 1) | (self.n_close[b] == 1))
        ends = [(a[sure], b[sure])]
        for chosen, names in ((both_close & ~sure, self.near_close), (~both_close, self.near)):
            c, d = a[chosen], b[chosen]
            both = (names[c][:, :, None] == names[d][:, None, :]) & (names[c] >= 0)[:, :, None]
            smallest = np.sort(np.where(both.any(2), names[c], np.iinfo(np.int64).max), axis=1)
            ok = smallest[:, 0] == self.pivot
            if self.second >= 0 and names is self.near:  # a pair that is not close meets in several lists of two
                ok &= smallest[:, 1] == self.second
            ends.append((c[ok], d[ok]))
        return tuple(np.concatenate(e) for e in zip(*ends, strict=True))


#: Pairs compared at once.
_PAIRS = 1 << 16


def _left_over(threshold: float, min_shared: int):
    """The vectors of a list that have a pair left when pivots are counted and sketches compared."""
    p = np.arccos(threshold) / np.pi
    most = int(np.ceil(SKETCH * p + 6 * np.sqrt(SKETCH * p * (1 - p))))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        own = _List(key, table, min_shared)
        sketch = np.frombuffer(b"".join(own.table.column("sketch").to_pylist()), np.uint64).reshape(own.n, -1)
        there = np.zeros(own.n, bool)
        for lo, _, first, shared in own.blocks():
            i, j = np.nonzero(shared)
            i, j = i + lo, j + first
            i, j = (x[i < j] for x in (i, j))
            for at in range(0, len(i), _PAIRS):
                a, b = i[at : at + _PAIRS], j[at : at + _PAIRS]
                like = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64) <= most
                a, b = own.judged(a[like], b[like])
                there[a] = there[b] = True
        return own.table.filter(pa.array(there)).drop_columns("sketch")

    return run


def _verify(threshold: float, min_shared: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        own = _List(key, table, min_shared)
        copies, n = own.table.column("copies").to_numpy(), own.n
        x, sizes, _ = _units(own.table.column("embedding").combine_chunks())
        links, root, ends = np.zeros(n, np.int64), np.arange(n), []
        for lo, hi, first, shared in own.blocks():
            dense = 16 * np.count_nonzero(shared) > shared.size
            if dense:
                shared &= x[lo:hi] @ x[first:].T >= threshold
            i, j = np.nonzero(shared)
            i, j = i + lo, j + first
            ok = (i < j) & (sizes[i] == sizes[j])
            i, j = i[ok], j[ok]
            for at in range(0, len(i), _PAIRS):
                a, b = i[at : at + _PAIRS], j[at : at + _PAIRS]
                if not dense:
                    ok = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                    a, b = a[ok], b[ok]
                ends.append(own.judged(a, b))
        if ends:
            a, b = (np.concatenate(e) for e in zip(*ends, strict=True))
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            while len(a):  # the smallest place of each local class
                old = root.copy()
                np.minimum.at(root, a, root[b])
                np.minimum.at(root, b, root[a])
                root = root[root]
                if (old == root).all():
                    break
        least = own.node.copy()
        np.minimum.at(least, root, own.node)
        on = links > 0
        return pa.table({"node": own.node[on], "links": links[on], "least": least[root][on]})

    return run


def near_vectors(embeddings: DataFrame, threshold: float = 0.95, nearest: int = 8, min_shared: int = 2, block: int = 2048) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    if min_shared != 2:
        raise ValueError("lists of two pivots hold all pairs that share two")
    kind = dict(embeddings.dtypes)["embedding"]
    vector = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    every = embeddings.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("vec_id"), vector.alias("embedding"))
    every = every.select("vec_id", "embedding", F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(1), "embedding").alias("g"))
    rows = every.where(F.col("embedding").isNotNull()).groupBy("h", "g", "vec_id").agg(F.any_value("embedding").alias("embedding"))
    nodes = rows.groupBy("h", "g").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.any_value("embedding").alias("embedding"))
    vectors, _ = stored(nodes, "vectors")
    n, widest = vectors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    widest = max(1, widest or 1)
    wanted = int(np.clip(2 * np.sqrt(n), 16, max(16, PIVOT_BYTES // (8 * widest))))
    usable = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    chosen = [r.embedding for r in vectors.where(usable).select("embedding", "node").orderBy(F.xxhash64("node"), "node").limit(wanted).collect()]
    pivots = np.zeros((len(chosen), widest))
    for i, v in enumerate(chosen):
        pivots[i, : len(v)] = _unit(v)
    pivots = _apart(pivots) if len(pivots) else np.zeros((1, widest))
    if len(pivots) < 2:  # a single pivot is shared by all
        min_shared = 1
    about = "node long, copies long, near array<int>, n_close int"
    described, path = stored(vectors.select("node", "copies", "embedding").mapInArrow(_describe(pivots, nearest), f"{about}, sketch binary"), "described")
    posted = described.select("*", F.explode("near").alias("pivot"))
    narrow = described.select(F.explode("near").alias("pivot"))
    long_lists = narrow.groupBy("pivot").count().where(F.col("count") > block).select("pivot", F.lit(True).alias("long")) if min_shared == 2 else narrow.select("pivot", F.lit(True).alias("long")).where("false")
    posted = posted.join(F.broadcast(long_lists), "pivot", "left")  # at most a row for each pivot
    # In a long list: the other pivots that a vector names, and the list's own if it is close to it.
    place = F.array_position("near", F.col("pivot"))
    seconds = F.filter("near", lambda q: (q != F.col("pivot")) | (place <= F.col("n_close")))
    posted = posted.withColumn("second", F.explode(F.when(F.col("long"), seconds).otherwise(F.array(F.lit(-1)))))
    # A pair's second shared pivot is greater than its first, so only greater ones, and the list's own, are of use.
    posted = posted.where((F.col("second") < 0) | (F.col("second") >= F.col("pivot")))
    sizes = posted.select("pivot", "second").groupBy("pivot", "second").count().where(F.col("count") > block)
    parted = posted.join(sizes.select("pivot", "second", F.ceil(F.col("count") / block).cast("int").alias("n_parts")), ["pivot", "second"], "left")
    parted = parted.withColumn("n_parts", F.coalesce("n_parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("n_parts")).cast("int"))
    paired = parted.withColumn("other", F.explode(F.expr("sequence(0, n_parts - 1)")))
    key = ["pivot", "second", "left", "right"]
    grouped = paired.select("pivot", "second", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "part", "node", "copies", "near", "n_close", "sketch")
    left_over = f"pivot int, second int, left int, right int, part int, {about}"
    pairs_left, left_path = stored(grouped.groupBy(*key).applyInArrow(_left_over(threshold, min_shared), left_over), "left-over")
    with_components = pairs_left.join(vectors.select("node", "embedding"), "node")
    found = materialize(with_components.groupBy(*key).applyInArrow(_verify(threshold, min_shared), "node long, links long, least long"), "found")
    drop(embeddings.sparkSession, path, left_path)
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    # Rows find their node by the hashes; nodes that are no vectors at all have no links, and their copies do not link.
    known = vectors.where(usable).select("h", "g", "node", "copies").join(totals, "node", "left").join(classes, "node", "left")
    out = every.select("vec_id", "h", "g").join(known, ["h", "g"], "left")
    component = F.coalesce("component", "node", "vec_id")
    return out.select(
        id_back("vec_id"),
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.when(component != NULL_ID, component).alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
