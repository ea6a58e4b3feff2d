"""Sources by URI: text, tables, record files, stores, lists of files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.functions.text import normalize_key
from rankflow.relation import Relation
from rankflow.sources import bucketed, store_index
from rankflow.sources.quoted import quoted_table
from rankflow.storage import numbered_rows

UNSUPPORTED = ("cosmos:", "clip:", "sql:")


def lines(spark: SparkSession, path: str | list[str], skip_blank: bool = False) -> Relation:
    """One record a line; its key is the normalised line. Compression goes by extension."""
    df = spark.read.text(path).select(normalize_key(F.col("value")).alias("key"))
    return Relation(df.where("key <> ''") if skip_blank else df, ("key",), "line", _name(path))


def _name(path: str | list[str]) -> str:
    one = path if isinstance(path, str) else path[0]
    return re.split(r"[/\\]", one.rstrip("/\\"))[-1].split(".")[0] or "source"


def directory(spark: SparkSession, path: str, pattern: str = "*") -> Relation:
    """All files of a folder that match; unreadable ones are left out."""
    df = spark.read.option("pathGlobFilter", pattern).option("ignoreCorruptFiles", "true").text(path)
    return Relation(df.select(normalize_key(F.col("value")).alias("key")), ("key",), "line", _name(path))


def delimited(spark: SparkSession, path: str, separator: str = "\t", header: bool = True, key: str | None = None, schema=None, collapse: bool = False, case: str | None = None, line_ends: bool | None = None) -> Relation:
    """TSV or CSV with doubled quotes and trimmed items; all columns are text unless a schema is given. Files are read in splits.

    line_ends: whether quoted items may hold line ends; without an answer, those of tables parted by TABs may not.
    separator: one mark, or several, of which each parts items. collapse: runs of marks count as one. Both of these read
    plain lines, whose items are not quoted and which may be split at any line end. case: "lower" or "upper" for the
    names in the header. Text that is missing is ''.
    """
    if len(separator) > 1 or collapse:
        text = spark.read.option("lineSep", "\n").text(path)
        first = text.first() if header else None  # one row: names
        marks = "[" + re.escape(separator) + "]" + ("+" if collapse else "")
        line = F.regexp_replace("value", "\r$", "")
        names = re.split(marks, first.value.rstrip("\r")) if first else None
        if names is None:
            width = text.select(F.max(F.size(F.split(line, marks, -1))).alias("n")).first().n or 1
            names = [f"_c{i}" for i in range(width)]
        parts = F.split(line, marks, -1)
        rows = text.where(line != first.value.rstrip("\r")) if first else text
        df = rows.where(line != "").select(*[F.trim(F.coalesce(F.get(parts, F.lit(i)), F.lit(""))).alias(n.strip()) for i, n in enumerate(names)])
    elif separator != "\t" if line_ends is None else line_ends:
        df = quoted_table(spark, path, separator, header, schema)
    else:
        reader = spark.read.option("sep", separator).option("header", header).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        df = (reader.schema(schema) if schema else reader).csv(path)
    df = df.fillna("") if schema is None else df
    # Names may be marked as keys, name=Key.1, name=Key.2 ...
    marks = [re.fullmatch(r"(.*)=Key\.(\d+)", c) for c in df.columns]
    df = df.toDF(*[m[1] if m else c for m, c in zip(marks, df.columns, strict=True)])
    if case:
        df = df.toDF(*[getattr(c, case)() for c in df.columns])
    keys = [c for _, c in sorted((int(m[2]), c) for m, c in zip(marks, df.columns, strict=True) if m)]
    return Relation(df, (key,) if key else tuple(keys) or (df.columns[0],), "table", _name(path))


def xml_table(spark: SparkSession, path: str, row_tag: str, key: str | None = None) -> Relation:
    """An element a row; attributes and child elements are columns."""
    df = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "").load(path)
    return Relation(df, (key or df.columns[0],), "table", _name(path))


def jdbc_options(url: str, table: str, split_by: str | None = None, low: int = 0, high: int = 0, parts: int = 1, fetch: int = 10_000) -> dict[str, str]:
    """Options of a JDBC read: in `parts` ranges of a numeric column between low and high, or by one task without split_by."""
    out = {"url": url, "dbtable": table, "fetchsize": str(fetch)}
    if split_by:
        out |= {"partitionColumn": split_by, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return out


def jdbc_table(spark: SparkSession, url: str, table: str, split_by: str | None = None, low: int = 0, high: int = 0, parts: int = 1, fetch: int = 10_000, **options: str) -> Relation:
    """A database table, or a query in parentheses with a name, by JDBC; split_by reads it in `parts` tasks."""
    df = spark.read.format("jdbc").options(**jdbc_options(url, table, split_by, low, high, parts, fetch), **options).load()
    return Relation(df, (df.columns[0],), "table", table.split(".")[-1])


def records(spark: SparkSession, path: str, key: str | None = None, kind: str = "table") -> Relation:
    """A record file: Parquet."""
    df = spark.read.parquet(path)
    return Relation(df, (key or df.columns[0],), kind, _name(path))


def store(spark: SparkSession, path: str, key: str | None = None) -> Relation:
    """An indexed store: Parquet in ranges of the key, sorted within files, so that key filters skip row groups; its index serves numbers."""
    df = spark.read.parquet(path)
    return Relation(df, (key or df.columns[0],), "table", _name(path))


def multi_file(spark: SparkSession, path: str) -> Relation:
    """The files that a list names; # begins a comment, @ includes another list. Lists are read on the driver."""

    def listed(p: str, seen: frozenset[str] = frozenset()) -> list[str]:
        if p in seen:
            raise ValueError(f"{p} includes itself")
        out = []
        for r in spark.read.text(p).collect():  # a list of files, not data
            line = r.value.strip()
            if line.startswith("@"):
                out += listed(line[1:].strip(), seen | {p})
            elif line and not line.startswith("#"):
                out.append(line)
        return out

    return lines(spark, listed(path))


def endless(spark: SparkSession, n: int = 1 << 40, fixed: bool = False) -> Relation:
    """The debugging source: n random keys, or n times the same. Rows are made as they are asked for, so a limit ends it."""
    key = F.lit("0") if fixed else F.uuid()
    return Relation(spark.range(n).select(key.alias("key")), ("key",), "line", "null")


def user_source(spark: SparkSession, function: Callable[[int, int], Iterator[pd.DataFrame]], schema: str, key: str, parts: int = 8, name: str = "user") -> Relation:
    """A source of the user's own: function(part, parts) yields part's rows as frames; parts are made where they are used, each anew if it is lost."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in batch["id"]:
                yield from function(int(part), parts)

    return Relation(spark.range(0, parts, 1, parts).mapInPandas(run, schema), (key,), "table", name)


def _there(spark: SparkSession, path: str) -> str:
    """The path; where nothing lies at it, the compressed file beside it that there is instead."""
    if re.search(r"[*?\[{]", path):
        return path
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    exists = lambda p: hadoop(p).getFileSystem(conf).exists(hadoop(p))
    return path if exists(path) else next((path + end for end in (".gz", ".bz2", ".zst") if exists(path + end)), path)


def _kind_of(spark: SparkSession, path: str) -> str:
    """What lies at a plain path, by what its folder holds: 'store', 'buckets', 'records', or 'lines' for anything else."""
    if re.search(r"[*?\[{]", path):
        return "lines"
    place, conf = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()
    files = place.getFileSystem(conf)
    if not files.exists(place) or not files.getFileStatus(place).isDirectory():
        return "lines"
    names = [s.getPath().getName() for s in files.listStatus(place)]
    if store_index.INDEX in names or bucketed.ABOUT in names:
        return "store" if store_index.INDEX in names else "buckets"
    return "records" if any(n.endswith(".parquet") for n in names) else "lines"


def open_uri(spark: SparkSession, uri: str) -> Relation:
    """A relation by URI: records:, recs:, store:, tstore:, buckets:, dir:, directory:, multi:, filelist:, xml:<tag>:, or a path by its
    extension, else by what lies there. Where a text file is missing, the compressed one of its name is read."""
    scheme, _, rest = uri.partition(":")
    if uri.lower().startswith(UNSUPPORTED):
        raise ValueError(f"{scheme}: is not supported here; use a path or a JDBC URL with jdbc_table()")
    if scheme in ("records", "recs"):
        return records(spark, rest)
    if scheme in ("store", "tstore"):
        return store(spark, rest)
    if scheme == "buckets":
        return bucketed.buckets(spark, rest)
    if scheme in ("dir", "directory"):
        folder, _, pattern = rest.rpartition("\\") if "\\" in rest else (rest, "", "*")
        return directory(spark, folder, pattern)
    if scheme in ("multi", "filelist"):
        return multi_file(spark, rest)
    if scheme == "xml":
        tag, _, path = rest.partition(":")
        return xml_table(spark, path, tag)
    bare = re.sub(r"\.(gz|bz2|zst|deflate|snappy|lz4)$", "", uri.lower())
    if bare.endswith(".parquet"):
        return records(spark, uri)
    if bare.endswith(".orc"):
        df = spark.read.orc(uri)
        return Relation(df, (df.columns[0],), "table", _name(uri))
    if bare.endswith(".json"):
        df = spark.read.json(uri)
        return Relation(df, (df.columns[0],), "table", _name(uri))
    if bare.endswith(".csv"):
        return delimited(spark, _there(spark, uri), ",")
    if bare.endswith(".tsv"):
        return delimited(spark, _there(spark, uri), "\t")
    kind = _kind_of(spark, uri)
    if kind == "buckets":
        return bucketed.buckets(spark, uri)
    return lines(spark, _there(spark, uri)) if kind == "lines" else (store if kind == "store" else records)(spark, uri)


def get_record(r: Relation, key: str) -> DataFrame:
    """All rows of a key."""
    return r.df.where(r.key() == key)


def get_prefix(r: Relation, prefix: str) -> DataFrame:
    return r.df.where(F.col(f"`{r.keys[0]}`").startswith(prefix))


def numbered(r: Relation) -> DataFrame:
    """Rows with record_no, their place by key (then by the other columns) from 0."""
    return numbered_rows(r.df, [*r.keys, *[c for c in r.df.columns if c not in r.keys]])


def get_record_no(r: Relation, number: int) -> DataFrame:
    """The row of a record number; none if there is no such number. Any relation is sorted for it; a store is not, see stored_record."""
    return numbered(r).where(F.col("record_no") == number)


def stored_record(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The record of a number, with record_no, out of the one file of an indexed store that holds it."""
    return store_index.record_by_no(spark, path, number)


def stored_record_no(spark: SparkSession, path: str, *key: object) -> int:
    """The number of a key's first record in an indexed store; -1 if there is none."""
    return store_index.record_no(spark, path, *key)


def get_or_missing(r: Relation, keys: DataFrame) -> DataFrame:
    """(asked, found, and r's columns) for keys (column key): all rows of each, or one row with found = false and nulls."""
    asked = keys.select(F.col("key").cast("string").alias("asked")).distinct()
    rows = r.df.withColumn("_key", r.key())
    same = F.col("asked") == F.col("_key")
    if len(r.keys) == 1 and (kind := dict(r.df.dtypes)[r.keys[0]]) != "string":
        # Joined in the key's own type, so that filters made from the asked keys reach the scan; the texts decide ('007' is not 7).
        asked = asked.withColumn("_typed", F.col("asked").try_cast(kind))
        same = (F.col("_typed") == F.col(f"`{r.keys[0]}`")) & same
    out = asked.join(rows, same, "left")
    return out.select("asked", F.col("_key").isNotNull().alias("found"), *[F.col(f"`{c}`") for c in r.df.columns])
