"""Ranking data: labels, features, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankflow.storage import numbered_rows, ranged, starts_of

META = "m:"
#: Grades by name.
GRADES = {"definitive": 4, "perfect": 4, "excellent": 3, "good": 2, "fair": 1, "bad": 0, "detrimental": 0, "unjudged": 0, "unknown": -1, "": -1, "highlyrelevant": 2, "relevant": 1, "nonrelevant": 0}


def label_of(text: Column, grades: dict[str, int] = GRADES) -> Column:
    """A grade's number by its name, else the number that the text is, else 0."""
    names = F.create_map(*[F.lit(x) for k, v in grades.items() for x in (k, float(v))])
    known = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.coalesce(F.try_element_at(names, known), known.try_cast("double"), F.lit(0.0))


def labelled(label: Column, unlabelled: float = 0.0) -> Column:
    """Labels below 0 mean no label."""
    return F.when(label < 0, F.lit(unlabelled)).otherwise(label)


def read_ranking(spark: SparkSession, path: str | list[str], separator: str = "\t") -> DataFrame:
    """A ranking file: a header, m: columns of metadata, and features; all text."""
    return spark.read.option("sep", separator).option("header", True).csv(path)


def feature_names(columns: list[str]) -> list[str]:
    return [c for c in columns if not c.lower().startswith(META)]


def feature_columns(df: DataFrame) -> list[Column]:
    """A Column for each feature: numbers (missing: 0), bin:N:name as N columns, sparse:N:name as N columns."""
    out = []
    for c in feature_names(df.columns):
        value, parts = F.col(f"`{c}`"), c.split(":", 2)
        if len(parts) == 3 and parts[0] in ("bin", "sparse") and parts[1].isdigit():
            text = F.coalesce(value.cast("string"), F.lit(""))
            listed = F.split(F.trim(text), " +") if parts[0] == "sparse" else F.array(F.trim(text))
            out += [F.array_contains(listed, str(i)).cast("double").alias(f"{parts[2]}:{i}") for i in range(int(parts[1]))]
        else:
            out.append(F.coalesce(value.try_cast("double"), F.lit(0.0)).alias(c))
    return out


def one_hot(code: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == code).cast("int"))


def binary_features(df: DataFrame, codes: list[tuple[str, int]]) -> list[Column]:
    """A 0/1 column for each code of each feature (column of codes, number of bins); features with a single bin are dropped."""
    return [(F.col(f"`{c}`") == i).cast("int").alias(f"{c}:{i}") for c, bins in codes if bins > 1 for i in range(bins)]


def aligned(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Data sets one after another with the first one's columns, by name; a feature that is missing is 0."""
    out = first
    for df in others:
        have = {c.lower(): c for c in df.columns}
        picked = [F.col(f"`{have[c.lower()]}`").alias(c) if c.lower() in have else F.lit(0).cast(t).alias(c) for c, t in first.dtypes]
        out = out.unionAll(df.select(*picked))
    return out


def without_degenerate(df: DataFrame, group: str, label: str) -> DataFrame:
    """Queries whose labels are not all equal."""
    mixed = df.groupBy(group).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi")).where("_lo <> _hi").select(group)
    return df.join(mixed, group, "left_semi")


def own_groups(df: DataFrame, order: list[str], out: str = "group_no") -> DataFrame:
    """Every row a group of its own, numbered from 0 in an order."""
    return numbered_rows(df, order, out)


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """(group, size, start): sizes, and the rows before each group in the order of ids. Groups, not rows, meet in the running sum."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    parts = ranged(sizes, [group])
    own = F.coalesce(F.sum("size").over(Window.partitionBy("_part").orderBy("_own").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_before", own).join(starts_of(parts, "size"), "_part").select(group, "size", (F.col("_start") + F.col("_before")).alias("start"))
