"""Sparse (time x term x document) tensors as tables of nonzero cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftloom.operators.numbering import dense_index, number_rows
from driftloom.session import settle


def fold_blocks(n: Column, k: int) -> tuple[Column, Column]:
    """Document n to (t, d) = (n div k, n mod k)."""
    return F.floor(n / k).cast("int"), (n % k).cast("int")


def fold_round_robin(n: Column, n_slices: int | Column) -> tuple[Column, Column]:
    """Document n to (t, d) = (n mod T, n div T)."""
    return (n % n_slices).cast("int"), F.floor(n / n_slices).cast("int")


def position_in_slice(docs: DataFrame, slice_column: str, key: str = "doc_id") -> DataFrame:
    """(doc_id, slice column, t, d): slice number and place inside the slice."""
    slices = dense_index(docs, slice_column, "t")
    numbered = number_rows(docs.select(key, slice_column), [key], [slice_column], "d")
    return numbered.join(slices, slice_column).select(key, slice_column, "t", "d")


def concat_time(parts: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """Stack (cells, number of slices) parts along time in the given order."""
    offset, stacked = 0, None
    for cells, n_slices in parts:
        moved = cells.withColumn("t", (F.col("t") + offset).cast("int"))
        stacked = moved if stacked is None else stacked.unionByName(moved)
        offset += n_slices
    return stacked


def slice_time(cells: DataFrame, start: int, length: int) -> DataFrame:
    """Slices start .. start+length-1, counted from 0 again."""
    inside = F.col("t").between(start, start + length - 1)
    return cells.where(inside).withColumn("t", (F.col("t") - start).cast("int"))


def matricize(cells: DataFrame, n_docs: int) -> DataFrame:
    """(v, n, x): term x document matrix with column n = t*D + d."""
    n = F.col("t").cast("bigint") * n_docs + F.col("d")
    return cells.select("v", n.alias("n"), "x")


def unfold_mode(
    cells: DataFrame, mode: str, dims: dict[str, int], transpose: bool = False
) -> DataFrame:
    """(row, col, x): mode unfolding; the other axes count the columns, the
    first of them slowest. `transpose` exchanges rows and columns."""
    column = F.lit(0).cast("bigint")
    for axis, size in dims.items():
        if axis != mode:
            column = column * size + F.col(axis)
    row = F.col(mode).cast("bigint")
    if transpose:
        row, column = column, row
    return cells.select(row.alias("row"), column.alias("col"), "x")


def swap_modes(cells: DataFrame, a: str, b: str) -> DataFrame:
    """Exchange two axes."""
    names = {a: b, b: a}
    return cells.select(*[F.col(c).alias(names.get(c, c)) for c in cells.columns]).select(*cells.columns)


def cp_synthetic_tensor(
    spark: SparkSession, factors: dict[str, DataFrame], dims: dict[str, int], rank: int
) -> DataFrame:
    """Every cell of the tensor with the given factors, summed over all `rank`
    components.

    `factors` maps an axis to a table (axis, u), `dims` to its size. Cells are
    counted out by one distributed range and find their factors by equi-joins.
    """
    cells = spark.range(math.prod(dims.values()))
    stride = 1
    for axis, size in reversed(dims.items()):
        cells = cells.withColumn(axis, F.floor(F.col("id") / stride) % size)
        stride *= size
    model = reconstruct_at_nonzeros(cells.drop("id"), factors, rank)
    return model.select(*[F.col(a).cast("int").alias(a) for a in dims], F.col("xhat").alias("x"))


def product_at(columns: Sequence[str], k: int) -> Column:
    """Product of component k of several factor columns."""
    out = F.col(columns[0])[k]
    for column in columns[1:]:
        out = out * F.col(column)[k]
    return out


def reconstruct_at_nonzeros(cells: DataFrame, factors: dict[str, DataFrame], rank: int) -> DataFrame:
    """The stored cells with the model's value `xhat` beside them."""
    joined = cells
    for axis, table in factors.items():
        joined = joined.join(table.select(axis, F.col("u").alias(f"_{axis}")), axis)
    columns = [f"_{axis}" for axis in factors]
    xhat = sum((product_at(columns, k) for k in range(1, rank)), product_at(columns, 0))
    return joined.withColumn("xhat", xhat).drop(*columns)


#: Blocks that two tables are compared by before any of their rows are.
BLOCKS = 4096


def prints(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(_block, _n, _p, _q): rows of each block of keys, and two sums of their hashes.

    The sums do not depend on the order of rows, and count repeated ones. They are
    128 bits of a block's rows in all; partial sums make the one shuffle small.
    """
    block = F.pmod(F.xxhash64(*keys), F.lit(BLOCKS)).cast("int")
    wide = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)")) for seed in (1, 2)]
    return df.groupBy(block.alias("_block")).agg(F.count("*").alias("_n"), wide[0].alias("_p"), wide[1].alias("_q"))


def differing_blocks(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(_block, _same, _n): every block, whether both sides have the same rows in it, and how many the left has."""
    a, b = (prints(side, keys, columns) for side in (left, right))
    other = b.select("_block", *[F.col(c).alias(f"{c}r") for c in ("_n", "_p", "_q")])
    same = F.col("_n").eqNullSafe(F.col("_nr")) & F.col("_p").eqNullSafe(F.col("_pr")) & F.col("_q").eqNullSafe(F.col("_qr"))
    return a.join(other, "_block", "full_outer").select("_block", same.alias("_same"), "_n")


def _rows_of(df: DataFrame, keys: Sequence[str], blocks: DataFrame) -> DataFrame:
    """Rows of the listed blocks, at most BLOCKS numbers."""
    placed = df.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(BLOCKS)).cast("int"))
    return placed.join(F.broadcast(blocks), "_block", "left_semi").drop("_block")


def matrix_equal(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str = "x") -> DataFrame:
    """(n_cells, n_different): element-wise comparison; absent cells are 0.

    `keys` identify a cell. Blocks of keys are compared by fingerprints; only
    cells of blocks that differ are joined. Both sides are written first, as they
    are read twice.
    """
    left, right = (settle(side.select(*keys, value)) for side in (left, right))
    blocks = settle(differing_blocks(left, right, keys, [*keys, value]))
    apart = blocks.where(~F.col("_same")).select("_block")
    a = _rows_of(left, keys, apart).select(*keys, F.col(value).alias("_a"))
    b = _rows_of(right, keys, apart).select(*keys, F.col(value).alias("_b"))
    both = a.join(b, list(keys), "full_outer")
    differs = F.coalesce("_a", F.lit(0.0)) != F.coalesce("_b", F.lit(0.0))
    seen = both.agg(F.count("*").alias("n_cells"), F.count_if(differs).alias("n_different"))
    alike = blocks.where("_same").select(F.col("_n").alias("n_cells"), F.lit(0).cast("bigint").alias("n_different"))
    sums = seen.union(alike).agg(F.sum("n_cells").alias("n_cells"), F.sum("n_different").alias("n_different"))
    return sums


def vocabulary_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """(only_left, only_right): multiset differences in both directions.

    Blocks of rows are compared by fingerprints; only rows of blocks that differ
    are grouped.
    """
    columns = left.columns
    right = right.select(*columns)
    apart = settle(differing_blocks(left, right, columns, columns)).where(~F.col("_same")).select("_block")
    left, right = (_rows_of(side, columns, apart) for side in (left, right))
    sides = left.select(*columns, F.lit(1).alias("_s")).unionByName(right.select(*columns, F.lit(-1).alias("_s")))
    surplus = sides.groupBy(*columns).agg(F.sum("_s").alias("_s"))
    return surplus.agg(
        F.coalesce(F.sum(F.greatest("_s", F.lit(0))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("_s"), F.lit(0))), F.lit(0)).alias("only_right"),
    )
