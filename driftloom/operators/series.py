"""Shares, sliding means, norms and resampled error traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from driftloom.functions.records import guard_nonnegative
from driftloom.operators.numbering import number_rows

# Points of a series handled together in `sliding_average`.
CHUNK = 4096


def to_proportion(df: DataFrame, group: Sequence[str], value: str, name: str = "share") -> DataFrame:
    """value / sum of its group; negative values make the query fail.

    Sums are pre-aggregated and joined back, so no group is gathered in one task.
    """
    checked = df.withColumn(value, guard_nonnegative(value))
    if not group:
        total = checked.agg(F.sum(value)).scalar()
        return checked.withColumn(name, F.col(value) / total)
    totals = checked.groupBy(*group).agg(F.sum(value).alias("_total"))
    return checked.join(totals, list(group)).withColumn(name, F.col(value) / F.col("_total")).drop("_total")


def normalise_window(df: DataFrame, group: Sequence[str], value: str, name: str = "share") -> DataFrame:
    """The same as one window, for groups known to be small (topics, slices)."""
    total = F.sum(value).over(Window.partitionBy(*group))
    return df.withColumn(name, F.col(value) / total)


def sliding_average(
    df: DataFrame, series: str, at: str, value: str, window: int = 24, name: str = "average"
) -> DataFrame:
    """Mean over `window` consecutive points, complete windows only, labelled by
    the first point. `at` counts the points of a series 0, 1, …

    A long series is cut into chunks that each borrow the first window-1 points
    of the next one, so its length does not bound the parallelism.
    """
    short = df.groupBy(series).count().where(F.col("count") < window)
    if not short.isEmpty():
        raise ValueError(f"a series has fewer than {window} points, so no window is complete")
    chunk = max(CHUNK, window)
    own = F.floor(F.col(at) / chunk)
    borrowed = F.when((F.col(at) % chunk < window - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    spread = df.select(series, at, value, own.alias("_own"), F.explode(borrowed).alias("_chunk"))
    frame = Window.partitionBy(series, "_chunk").orderBy(at).rangeBetween(0, window - 1)
    return (
        spread.withColumn(name, F.avg(value).over(frame))
        .withColumn("_points", F.count("*").over(frame))
        .where((F.col("_points") == window) & (F.col("_own") == F.col("_chunk")))
        .select(series, at, name)
    )


def vector_norms(df: DataFrame, value: str, size: int | None = None) -> DataFrame:
    """L1 and L2 norms; with `size` (zeros included) also the mean entry size."""
    l1 = F.sum(F.abs(value))
    columns = [l1.alias("l1"), F.sqrt(F.sum(F.col(value) * F.col(value))).alias("l2")]
    if size is not None:
        columns.append((l1 / size).alias("mean_size"))
    return df.agg(*columns)


def resample_trace(trace: DataFrame, points: int = 101) -> DataFrame:
    """Linear interpolation of every trial's (elapsed, error) trace on one grid.

    `trace(method, trial, iter, elapsed, error)`, elapsed rising with iter. The
    grid has `points` values from 0 to the longest time of all; a method's part
    ends before its shortest trial. Times before a trial's first point extend
    its first segment. Segments list the grid points they cover, so neither an
    ordered window over a trial nor a range join is needed.
    """
    keys = ["method", "trial"]
    numbered = number_rows(trace.select(*keys, "iter", "elapsed", "error"), ["iter"], keys, "k")
    ahead = numbered.select(*keys, (F.col("k") - 1).alias("k"), F.col("elapsed").alias("e1"), F.col("error").alias("y1"))
    segments = numbered.join(ahead, [*keys, "k"])
    ends = trace.groupBy(*keys).agg(F.max("elapsed").alias("_end"))
    cut = ends.groupBy("method").agg(F.min("_end").alias("_cut"))
    step = ends.agg((F.max("_end") / (points - 1)).alias("_step"))
    limits = cut.withColumn("_step", step.scalar())
    first = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.ceil(F.col("elapsed") / F.col("_step")))
    last = F.ceil(F.col("e1") / F.col("_step")) - 1
    covered = segments.join(limits, "method").select(
        *keys, "elapsed", "error", "e1", "y1", "_cut", "_step",
        F.explode(F.when(first <= last, F.sequence(first, last))).alias("grid"),
    )
    x = F.col("grid") * F.col("_step")
    slope = (F.col("y1") - F.col("error")) / (F.col("e1") - F.col("elapsed"))
    return covered.where(x < F.col("_cut")).select(
        *keys, F.col("grid").cast("int").alias("grid"), x.alias("x"),
        (F.col("error") + (x - F.col("elapsed")) * slope).alias("y"),
    )


def error_band(resampled: DataFrame) -> DataFrame:
    """Mean and population deviation over the trials at each grid point."""
    return resampled.groupBy("method", "grid").agg(
        F.first("x").alias("x"), F.avg("y").alias("mean_error"), F.stddev_pop("y").alias("std_error")
    )
