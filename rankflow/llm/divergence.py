"""Divergence of the sources of each language, by two-dimensional group-block tiling.

Words are counted by (language, source) in the tasks that read the texts, so a source with a third of all rows arrives as
a row per word and task. A language keeps the words of at least 30 of its documents. Every source's share of a word is
(count + 5) / (all + 5 x kept words), as whole thousand-millionths plus one, and sources are compared by the sum of
absolute differences over all kept words of their language.

All pairs: a language's sources are numbered and cut into blocks, its kept words are numbered and cut into chunks. Of each
source and chunk the counts are packed into one row (places and counts). Each packed row is sent to the tiles of its block
with every block of the language, so once per block and never once per pair. A tile is a task's piece of work: it takes
chunk after chunk, spreads the counts of its two blocks into two dense matrices of a chunk's width, and adds the
differences of all its pairs to one submatrix. It holds one chunk at a time, however many words there are; long
vocabularies are also cut into segments, tiles of their own whose submatrices are summed. The result has a row for each pair,
so tiles grow with the square of the sources; their size does not.

Most divergent words: shares against those of the whole language, the top ranks of each source; Spark keeps only those
before its shuffle.

All arithmetic is exact: shares are divided digit by digit in tasks and as decimals in expressions.

Defined cases: null text, language and source are ''; repeated rows count each; a source without words, or a language that keeps none, still has its
pairs; equal values are ranked by item in UTF-8 order; texts of any length count as a whole, in pieces;
counts of one source up to 9 x 10^15 words are exact; an empty table gives an empty result; only text, lang and source are read,
whatever other columns are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.llm.common import drop, materialize, stored
from rankflow.storage import numbered_rows

#: Documents of a language that a kept word is in; what is added to a count; ranks of words.
LEAST_DOCS, PRIOR, RANKS = 30, 5, 50
UNIT = 1_000_000_000
#: A vocabulary of more bytes than this, with 100 for each word, is not broadcast.
BROADCAST_BYTES = 1 << 26
#: Sources in a block, words in a chunk, chunks in a segment.
BLOCK, CHUNK, SEGMENT = 32, 1024, 4
#: Words that a task holds before it passes their counts on; bytes of a text that are cut into words at once.
_HELD, _PIECE = 1 << 19, 1 << 22
#: ASCII capitals become small, all other ASCII but small letters becomes a space; bytes of other characters stay.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, a list for each piece of it."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > _PIECE:
            piece = text[at : at + _PIECE].translate(_LETTERS)
            last = piece.rfind(b" ")
            if last < 0:  # a word longer than a piece: to its end
                end, size = at, _PIECE
                while end < len(text):
                    piece = text[end : end + size].translate(_LETTERS)
                    if (k := piece.find(b" ")) >= 0:
                        end += k
                        break
                    end += len(piece)
            else:
                end = at + last
        yield text[at:end].translate(_LETTERS).split()
        at = end + (end < len(text))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = [None, *(t.decode() for t in n)]  # the row without a word tells that there is such a source
            size = len(terms)
            arrays = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(terms, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])
        groups.clear()

    held = 0
    for batch in batches:
        for text, lang, source in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), set()
            for piece in words(text.encode()):
                n.update(piece)
                own.update(piece)
            docs.update(own)
            held += len(n) - before + 1
            if held >= _HELD:
                yield from rows()
                held = 0
    yield from rows()


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents), summed within tasks only; and rows without a term, which name each source."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(text("text"), text("lang"), text("source")).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")


def _share(n: Column, every: Column, kept: Column) -> Column:
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", wide(n + PRIOR) * F.lit(UNIT), wide(every + PRIOR * kept))


def shares(n: np.ndarray, every: int, kept: int) -> np.ndarray:
    """1 + floor(UNIT x (n + PRIOR) / (every + PRIOR x kept)), by long division, three decimal digits at a time."""
    by = every + PRIOR * kept
    whole, rest = np.divmod(n + PRIOR, by)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, by)
        whole = whole * 1000 + digits
    return whole + 1


class _Tile:
    """One segment of one pair of blocks: the sums of its pairs so far, and the chunk that is being filled."""

    def __init__(self, left: int, right: int, length: int):
        self.left, self.right, self.length = left, right, length
        self.rows: dict[int, list[int]] = {left: [], right: []}
        self.base: dict[int, list[int]] = {left: [], right: []}
        self.of: dict[int, tuple[int, int, int, int]] = {}
        self.sums, self.taken = None, 0

    def member(self, block: int, source: int, every: int, kept: int) -> None:
        self.of[source] = (block, len(self.rows[block]), every, kept)
        self.rows[block].append(source)
        self.base[block].append(int(shares(np.zeros(1, np.int64), every, kept)[0]) if kept else 0)

    def add(self, matrices: dict[int, np.ndarray]) -> None:
        a, b = matrices[self.left], matrices[self.right]
        if self.sums is None:
            self.sums = np.zeros((len(a), len(b)), np.int64)
        for i in range(len(a)):
            self.sums[i] += np.abs(a[i] - b).sum(1)

    def empty(self, width: int) -> dict[int, np.ndarray]:
        return {k: np.repeat(np.array(v, np.int64)[:, None], width, 1) for k, v in self.base.items()}

    def finish(self) -> tuple[list[int], list[int], list[int]]:
        # Words of chunks that no source of the tile has: all their shares are those of a count of zero.
        rest = {k: np.array(v, np.int64)[:, None] for k, v in self.base.items()}
        before = self.sums
        self.sums = None
        self.add(rest)
        sums = self.sums * (self.length - self.taken) + (0 if before is None else before)
        i, j = np.triu_indices(len(sums), 1) if self.left == self.right else (g.ravel() for g in np.indices(sums.shape))
        a, b = np.array(self.rows[self.left], np.int64), np.array(self.rows[self.right], np.int64)
        return a[i].tolist(), b[j].tolist(), sums[i, j].tolist()


def _tiled(width: int):
    """Rows sorted by tile, then chunk of so many words, where chunk -1 names the sources: submatrices of the tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile, at, matrices = None, None, -1, None

        def close_chunk() -> None:
            nonlocal matrices
            if matrices is not None:
                tile.add(matrices)
                tile.taken += matrices[tile.left].shape[1]
                matrices = None

        def result() -> pa.RecordBatch:
            a, b, value = tile.finish()
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(a), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(value, pa.int64())], ["lang", "a", "b", "value"])

        for batch in batches:
            names = batch.schema.names
            *small, places, numbers = (batch.column(names.index(c)) for c in ("lang", "left", "right", "segment", "length", "first", "chunk", "block", "source_no", "every", "kept", "places", "numbers"))
            for row, (lang, left, right, segment, length, first, chunk, block, source, every, kept) in enumerate(zip(*[c.to_pylist() for c in small], strict=True)):
                if key != (lang, left, right, segment):
                    if tile is not None:
                        close_chunk()
                        yield result()
                    key, tile, at = (lang, left, right, segment), _Tile(left, right, length), -1
                if chunk < 0:
                    tile.member(block, source, every, kept)
                    continue
                if chunk != at:
                    close_chunk()
                    at = chunk
                    matrices = tile.empty(min(width, length - (chunk * width - first)))
                _, i, every, kept = tile.of[source]
                matrices[block][i, places[row].values.to_numpy()] = shares(numbers[row].values.to_numpy(), every, kept)
        if tile is not None:
            close_chunk()
            yield result()

    return run


def _pairs(kept: DataFrame, groups: DataFrame, block: int, chunk: int, segment: int) -> DataFrame:
    """lang, a, b (numbers of sources), value: the difference of all pairs a < b of a language's sources."""
    width = chunk * segment
    of_group = groups.withColumn("block", F.expr(f"cast(source_no div {block} as int)")).withColumn("blocks", F.expr(f"cast((of_lang + {block - 1}) div {block} as int)"))
    of_group = of_group.withColumn("segments", F.greatest(F.lit(1), F.expr(f"cast((kept + {width - 1}) div {width} as int)")))
    columns = ["lang", "block", "blocks", "source_no", "every", "kept"]
    members = of_group.select(*columns, F.lit(-1).alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("segments") - 1)).alias("segment"), F.array().cast("array<int>").alias("places"), F.array().cast("array<bigint>").alias("numbers"))
    counted = kept.select("lang", "source", F.expr(f"cast(place div {chunk} as int)").alias("chunk"), F.struct(F.expr(f"cast(place % {chunk} as int)").alias("place"), "n").alias("cell"))
    packed = counted.groupBy("lang", "source", "chunk").agg(F.collect_list("cell").alias("cells"))  # at most so many cells
    packed = packed.join(of_group, ["lang", "source"]).select(*columns, "chunk", F.expr(f"cast(chunk div {segment} as int)").alias("segment"), F.col("cells.place").alias("places"), F.col("cells.n").alias("numbers"))
    sent = members.unionByName(packed).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
    first = F.col("segment").cast("long") * width
    sent = sent.withColumn("first", first).withColumn("length", F.greatest(F.lit(0), F.least(F.lit(width), F.col("kept") - first)))
    tile = ["lang", "left", "right", "segment"]
    sums = sent.drop("other", "blocks").repartition(*tile).sortWithinPartitions(*tile, "chunk", "source_no").mapInArrow(_tiled(chunk), "lang string, a long, b long, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS, block: int = BLOCK, chunk: int = CHUNK, segment: int = SEGMENT) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: how far each source is from each other of its language, and its most divergent words."""
    every, path = stored(counts(docs), "word-counts")
    words_of = every.where("term IS NOT NULL")
    frequent = words_of.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term", "total")
    numbered = numbered_rows(frequent, ["lang", "term"])
    langs = numbered.groupBy("lang").agg(F.min("record_no").alias("first_no"), F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_every"))
    placed = numbered.join(langs.select("lang", "first_no"), "lang").select("lang", "term", "total", (F.col("record_no") - F.col("first_no")).alias("place"))
    placed, vocabulary_path = stored(placed, "vocabulary")
    rows, size = placed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    # Rare words end here: in the tasks that read the counts, where the vocabulary is measured to be small enough to send, else by a shuffle.
    small = F.broadcast(placed) if size + 100 * rows <= BROADCAST_BYTES else placed
    kept = words_of.select("lang", "source", "term", "n").join(small, ["lang", "term"]).groupBy("lang", "source", "term", "total", "place").agg(F.sum("n").alias("n"))
    kept = materialize(kept, "kept-counts")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("every"))
    groups = every.where("term IS NULL").select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs.drop("first_no"), "lang", "left").fillna(0)
    groups = numbered_rows(groups, ["lang", "source"])
    sizes = groups.groupBy("lang").agg(F.min("record_no").alias("first_no"), F.count(F.lit(1)).alias("of_lang"))
    groups = materialize(groups.join(sizes, "lang").withColumn("source_no", F.col("record_no") - F.col("first_no")).drop("record_no", "first_no"), "sources")
    drop(docs.sparkSession, path, vocabulary_path)

    both = _pairs(kept, groups, block, chunk, segment).select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "value").select("lang", "p.a", "p.b", "value")
    names = groups.select("lang", "source", "source_no")
    named = both.join(names.withColumnRenamed("source_no", "a"), ["lang", "a"]).join(names.select("lang", F.col("source").alias("item"), F.col("source_no").alias("b")), ["lang", "b"])
    p, q = _share(F.col("n"), F.col("every"), F.col("kept")), _share(F.col("total"), F.col("lang_every"), F.col("kept"))
    terms = kept.join(groups.select("lang", "source", "every", "kept", "lang_every"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), place.alias("rank"))
    top = ranked(terms, "term").where(F.col("rank") <= ranks)
    return ranked(named, "pair").unionAll(top)


def divergence_sql(least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> str:
    """The same in DuckDB's SQL."""
    p = lambda n, every: f"(1 + ({UNIT}::HUGEINT * ({n} + {PRIOR})) // ({every} + {PRIOR} * v))::BIGINT"
    return rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {least_docs}),
l AS (SELECT lang, count(*) AS v, sum(total) AS all_lang FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS every FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
f AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, {p("coalesce(c.n, 0)", "every")} AS p, {p("total", "all_lang")} AS q
 FROM s JOIN l ON l.lang = s.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN (SELECT fa.lang, fa.source, fb.source AS item, sum(abs(fa.p - fb.p)) AS value FROM f fa JOIN f fb ON fa.lang = fb.lang AND fa.term = fb.term AND fa.source <> fb.source GROUP BY ALL) x
 ON x.lang = a.lang AND x.source = a.source AND x.item = b.source)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term))::INTEGER AS rank FROM f WHERE n > 0 AND p > q QUALIFY rank <= {ranks}"""
