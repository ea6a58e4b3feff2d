"""Arrays of numbers, and statistics over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.operators.ordering import placed_runs


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def filled(size: int, value: float) -> Column:
    return F.array_repeat(F.lit(float(value)), size)


def span(low: int, high: int, step: int = 1) -> Column:
    """low, low + step, ... below high, as doubles."""
    return F.array(*[F.lit(float(x)) for x in range(low, high, step)]).cast("array<double>")


def sliced(a: Column, start: int, size: int) -> Column:
    """`size` values from a place on, which counts from 0; fewer at the end."""
    return F.slice(a, start + 1, size)


def picked(a: Column, places: list[int]) -> Column:
    """The values at places from 0, in their order; null beyond the end."""
    return F.array(*[F.get(a, F.lit(i)) for i in places])


def compressed(a: Column, mask: Column) -> Column:
    """The values whose place is true in an array of flags."""
    return F.transform(F.filter(F.arrays_zip(a.alias("x"), mask.alias("m")), lambda z: z["m"]), lambda z: z["x"])


def cumulative(df: DataFrame, value: str, by: list[str], order: list[str], out: str = "cumulative") -> DataFrame:
    """Running sums within groups."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def summary(df: DataFrame, value: str, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, sum, population variance, sample deviation, median, least and greatest of a column."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.sum(v).alias("total"), F.var_pop(v).alias("variance"), F.stddev(v).alias("deviation"), F.median(v).alias("median"), F.min(v).alias("least"), F.max(v).alias("greatest")
    )


def summaries(df: DataFrame, values: list[str], by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(by, column, n, mean, deviation): of several columns, in one pass."""
    sums = [x for c in values for x in (F.count(c).alias(f"n:{c}"), F.avg(c).alias(f"mean:{c}"), F.stddev(c).alias(f"sd:{c}"))]
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`n:{c}`").alias("n"), F.col(f"`mean:{c}`").alias("mean"), F.col(f"`sd:{c}`").alias("deviation")) for c in values])
    return df.groupBy(*by).agg(*sums).select(*by, F.inline(parts))


def distance_matrix(df: DataFrame, row: str, vector: str, by: list[str] | tuple[str, ...]) -> DataFrame:
    """(by, i, j, squared): squared distances of all pairs of rows i < j of a matrix; `by` names the matrix a row is of.

    The result is as large as the square of a matrix's rows: every pair is asked for. Rows pair by an equi-join on `by`.
    """
    a = df.select(*by, F.col(row).alias("i"), F.col(vector).alias("_a"))
    b = df.select(*by, F.col(row).alias("j"), F.col(vector).alias("_b"))
    return a.join(b, list(by)).where("i < j").select(*by, "i", "j", squared_distance(F.col("_a"), F.col("_b")).alias("squared"))


def rescaled(df: DataFrame, value: str, low: float, high: float, out: str = "rescaled") -> DataFrame:
    """A column stretched to [low, high]; low where all values are equal. One row of bounds is joined, no window over all rows."""
    bounds = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    scaled = low + (F.col(value) - F.col("_lo")) * (high - low) / (F.col("_hi") - F.col("_lo"))
    return df.crossJoin(F.broadcast(bounds)).withColumn(out, F.when(F.col("_hi") > F.col("_lo"), scaled).otherwise(low)).drop("_lo", "_hi")


def whitened(df: DataFrame, value: str, out: str = "whitened") -> DataFrame:
    """(x - mean) / deviation; 0 where there is no deviation."""
    stats = df.agg(F.avg(value).alias("_mean"), F.stddev(value).alias("_sd"))
    return df.crossJoin(F.broadcast(stats)).withColumn(out, F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mean")) / F.col("_sd")).otherwise(0.0)).drop("_mean", "_sd")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, low, high, n): equal-width bins, closed on the right; the least value is in the first."""
    bounds = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.ceil((F.col(value) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))) - 1).otherwise(0)
    placed = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(bounds)).select(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"), "_lo", "_hi")
    width = (F.col("_hi") - F.col("_lo")) / bins
    return placed.groupBy("bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("_lo") + F.col("bin") * width).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def run_lengths(df: DataFrame, value: str, order: list[str], by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(by, start, length, value): runs of consecutive equal values; start counts rows from 0. Without `by`, over all rows, by ranges."""
    if not by:
        runs = placed_runs(df, value, order)
        return runs.groupBy("_run").agg(F.min("_at").alias("start"), F.count(F.lit(1)).alias("length"), F.any_value(value).alias("value")).drop("_run")
    w = Window.partitionBy(*by).orderBy(*order)
    placed = df.withColumn("_at", F.row_number().over(w) - 1).withColumn("_new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.col("_at") > 0), 0).otherwise(1))
    runs = placed.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "_run").agg(F.min("_at").cast("long").alias("start"), F.count(F.lit(1)).alias("length"), F.first(value).alias("value")).drop("_run")
