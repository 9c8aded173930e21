"""Distributed row numbers and per-group top rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftloom.session import settle

# Up to this n Spark limits the rows of a group before the shuffle.
GROUP_LIMIT_SETTING = "spark.sql.optimizer.windowGroupLimitThreshold"
SALTS = 64


def number_rows(
    df: DataFrame, order: Sequence[str], group: Sequence[str] = (), name: str = "pos"
) -> DataFrame:
    """Number rows 0, 1, … in `order`, over all rows or inside each group.

    `group` + `order` must identify a row. Rows are laid out by range on all
    these columns, so one huge group is spread over many tasks; the number of a
    row is its place in its partition plus the rows of its group in earlier
    partitions. The layout is checkpointed because its split points must not
    change between the two passes. Pass key columns only and join the rest.
    """
    group, order = list(group), list(order)
    laid = settle(
        df.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", 33))
    )
    # One row per (partition, group that has rows in it).
    runs = laid.groupBy("_part", *group).agg(
        F.min("_mid").alias("_first"), F.count("*").alias("_rows")
    )
    earlier = Window.partitionBy(*group) if group else Window.partitionBy()
    earlier = earlier.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("_part").alias("_p"),
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    matches = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        matches &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = laid.join(runs, matches).select(
        *df.columns, (F.col("_mid") + F.col("_shift")).cast("bigint").alias(name)
    )
    # Who writes the numbers down may release it.
    out._laid = laid
    return out


def dense_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values of a column with their rank 0, 1, …

    One row per value: meant for slices, files and categories. The single
    ordered window sees the distinct values, never the rows behind them.
    """
    distinct = df.select(column).distinct()
    order = Window.partitionBy().orderBy(column)
    return distinct.withColumn(name, (F.row_number().over(order) - 1).cast("int"))


def top_n_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, name: str = "rank"
) -> DataFrame:
    """The first n rows of each group with their rank 1..n.

    Up to the session's limit Spark keeps n rows per group and task before
    shuffling; the rows are the same either way. Beyond it, groups are first cut inside salted parts, which leaves at most
    n rows per part for the final ranking.
    """
    if n > int(df.sparkSession.conf.get(GROUP_LIMIT_SETTING)):
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
        part = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_r", F.row_number().over(part))
            .where(F.col("_r") <= n)
            .drop("_salt", "_r")
        )
    whole = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(whole)).where(F.col(name) <= n)
