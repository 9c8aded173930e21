"""Key-matching steps: lookups, membership, parameter grids and slice windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftloom.operators.pool import sweep  # noqa: F401 (a grid's jobs)


#: Rows of a table that one task may hold as a hash table.
TASK_ROWS = 2_000_000
#: Tables of so few rows are left to Spark, which may broadcast them.
FEW_ROWS = 100_000


def hashed(table: DataFrame, rows: int) -> DataFrame:
    """`table`, of `rows` rows, as the side of a join that tasks hash, so that neither side is sorted.

    Where a task's share of it may be more than TASK_ROWS the join is left to Spark.
    """
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.hint("shuffle_hash") if FEW_ROWS < rows <= parts * TASK_ROWS else table


def join_term_lookup(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Replace term ids by terms."""
    return rows.join(vocabulary.select("term_id", "term"), "term_id")


def semi_in_vocabulary(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Token rows whose term is in the vocabulary."""
    return tokens.join(vocabulary.select("term"), "term", "left_semi")


def anti_join(rows: DataFrame, unwanted: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a match; Spark broadcasts the other side when it is small."""
    return rows.join(unwanted.select(*on), list(on), "left_anti")


def param_grid(spark: SparkSession, **choices: Sequence) -> DataFrame:
    """One row per combination of parameter values, numbered by `run`."""
    grid = spark.range(1)
    for name, values in choices.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.drop("id")


def zip_by_position(left: DataFrame, right: DataFrame, index: str) -> DataFrame:
    """Pair two tables by an explicit index column."""
    return left.join(right, index)


def window_starts(t, start: int, length: int, slide: int, n_slices):
    """Array of the window starts whose complete windows hold slice t."""
    first = F.greatest(F.lit(0), F.ceil((t - start - (length - 1)) / slide))
    last = F.least(F.floor((t - start) / slide), F.floor((n_slices - length - start) / slide))
    return F.when(
        first <= last, F.transform(F.sequence(first, last), lambda i: (i * slide + start).cast("int"))
    )


def range_window_slices(
    cells: DataFrame, n_slices: int, length: int = 20, slide: int = 10, start: int = 0, at: str = "t"
) -> DataFrame:
    """Each row once per complete window [s, s+length) holding its slice.

    Starts are start, start+slide, … while start + length <= n_slices. A row
    computes its windows itself, so there is no range join.
    """
    starts = window_starts(F.col(at), start, length, slide, F.lit(n_slices))
    return cells.withColumn("window_start", F.explode(starts))
