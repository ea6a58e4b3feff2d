"""Values by table: codes of names, settings that narrower levels inherit from wider ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The file format of each kind of document; any other kind is Unknown.
FORMATS = {"HTML": "html", "PDF": "pdfps", "PS": "pdfps", "IMAGE": "image", "VIDEO": "video", "AUDIO": "audio", "TEXT": "text", "DOC": "word", "PPT": "ppt"}


def mapped(name: Column, values: dict[str, object], default: object = None) -> Column:
    """The value of a name, whatever its case; default for names that the table lacks, and for null."""
    if not values:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k.lower(), v)])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(name))), F.lit(default))


def file_format(kind: Column) -> Column:
    return mapped(kind, FORMATS, "Unknown")


def parsed_settings(lines: DataFrame, defaults: dict[str, str] | None = None, column: str = "value") -> DataFrame:
    """(name, setting) of key=value lines: names in lower case, both trimmed; of several lines of a name the greatest counts;
    comments (#, ;), [sections] and lines without = are left out; defaults stand where no line names them."""
    line = F.trim(F.col(column))
    kept = lines.where(line.contains("=") & ~line.rlike(r"^[#;\[]"))
    found = kept.select(F.lower(F.trim(F.substring_index(line, "=", 1))).alias("name"), F.trim(F.substring(line, F.locate("=", line) + 1, F.length(line))).alias("setting"))
    found = found.groupBy("name").agg(F.max("setting").alias("setting"))
    if not defaults:
        return found
    base = lines.sparkSession.createDataFrame([(k.lower(), v) for k, v in defaults.items()], "name string, default string")
    return base.join(found, "name", "full").select("name", F.coalesce("setting", "default").alias("setting"))


def inherited(df: DataFrame, name: str, levels: list[tuple[DataFrame, list[str]]], default: object = None) -> DataFrame:
    """df with the setting `name` of the first level that has one for the row's keys, else default.

    levels go from the narrowest to the widest; each is a table with its key columns and a column `name`, one row for each
    key at most (of several, the greatest value counts). A level without key columns is a single value for all rows.
    """
    found = []
    for i, (level, keys) in enumerate(levels):
        own = f"_level{i}"
        found.append(F.col(own))
        best = F.max(F.col(f"`{name}`")).alias(own)
        if keys:
            df = df.join(level.groupBy(*keys).agg(best), keys, "left")
        else:
            df = df.join(F.broadcast(level.agg(best)), how="left")  # one row
    out = F.coalesce(*found, F.lit(default))
    return df.withColumn(name, out).drop(*[f"_level{i}" for i in range(len(levels))])
