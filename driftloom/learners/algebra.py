"""Linear algebra on factor tables.

A factor is a table (axis, u) with one array of `rank` numbers per index of the
axis; data are tables of nonzero cells. Products over cells are joins and sums,
so neither the cells nor a factor need fit in one place. Only rank x rank
matrices come to the driver, and factors that are declared local: those are
broadcast to the tasks and updated on the driver, and more than MODEL_CELLS
numbers in one are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from driftloom.operators.joins import hashed
from driftloom.operators.sampling import hash_uniform
from driftloom.session import is_stored, release, settle

# Numbers of a local factor at most (16 MB).
MODEL_CELLS = 2_000_000
EPSILON = 1e-12


@dataclass(frozen=True)
class Factor:
    """`table(axis, u)` with `size` rows; `values` holds the same numbers when a
    local factor has just been updated on the driver.

    `local` says where the factor lives, whatever its size; one that is not is
    joined as Spark sees fit and updated by DataFrame steps.
    """

    table: DataFrame
    axis: str
    size: int
    rank: int
    values: np.ndarray | None = None
    local: bool = True

    def __post_init__(self) -> None:
        if self.local and self.size * self.rank > MODEL_CELLS:
            raise ValueError(f"factor {self.axis} has over {MODEL_CELLS} numbers: make it with local=False")

    def joinable(self, name: str) -> DataFrame:
        side = self.table.select(self.axis, F.col("u").alias(name))
        return F.broadcast(side) if self.local else hashed(side, self.size)

    def using(self, table: DataFrame, values: np.ndarray | None = None) -> Factor:
        return replace(self, table=table, values=values)

    def gram(self) -> np.ndarray:
        """rank x rank matrix of the column products."""
        if self.values is not None:
            return self.values.T @ self.values
        return gram(self.table, self.rank)


def init_factor(
    index: DataFrame, axis: str, size: int, rank: int, seed: int = 0, local: bool | None = None
) -> Factor:
    """Uniform [0, 1) numbers that depend on axis, index, component and seed only.

    Unless told otherwise a factor is local if it has at most MODEL_CELLS numbers.
    """
    if local is None:
        local = size * rank <= MODEL_CELLS
    u = F.array(*[hash_uniform(F.lit(axis), axis, k, seed) for k in range(rank)])
    return Factor(index.select(axis, u.alias("u")), axis, size, rank, local=local)


def axis_index(spark, axis: str, size: int) -> DataFrame:
    """The indices 0 .. size-1 of an axis."""
    return spark.range(size).select(F.col("id").cast("int").alias(axis))


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a table that every iteration reads in executor memory and disk, unless it is written already."""
    if is_stored(df):
        yield df
        return
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def vector(rank: int, component: Callable[[int], Column]) -> Column:
    return F.array(*[component(k) for k in range(rank)])


def contract(
    cells: DataFrame, factors: Sequence[Factor], by: Sequence[str], rank: int,
    value: Callable[[int], Column] | None = None,
) -> DataFrame:
    """(…by, b): per group, b_k = sum of value_k * product of the factors' k-th
    components. The value is x unless given. Sums are partially aggregated
    before the shuffle, so a group with most of the cells costs no more.
    """
    joined = cells
    for factor in factors:
        joined = joined.join(factor.joinable(f"_{factor.axis}"), factor.axis)

    def product(k: int) -> Column:
        out = F.col("x") if value is None else value(k)
        for factor in factors:
            out = out * F.col(f"_{factor.axis}")[k]
        return out

    sums = joined.groupBy(*by).agg(*[F.sum(product(k)).alias(f"_b{k}") for k in range(rank)])
    return sums.select(*by, vector(rank, lambda k: F.col(f"_b{k}")).alias("b"))


def gram(table: DataFrame, rank: int, column: str = "u") -> np.ndarray:
    """rank x rank matrix of the column products, in one pass: every task adds up its rows."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rank, rank))
        for batch in batches:
            u = batch.column("u").flatten().to_numpy(zero_copy_only=False).reshape(-1, rank)
            total += u.T @ u
        columns = [pa.array(total[:, k]) for k in range(rank)]
        yield pa.record_batch([pa.array(range(rank), pa.int32()), *columns], names=["i", *(f"g{k}" for k in range(rank))])

    schema = ", ".join(["i int", *(f"g{k} double" for k in range(rank))])
    sums = table.select(F.col(column).alias("u")).mapInArrow(work, schema).groupBy("i")
    found = sums.agg(*[F.sum(f"g{k}").alias(f"g{k}") for k in range(rank)]).toArrow()
    out = np.zeros((rank, rank))
    out[found.column("i").to_numpy()] = np.column_stack([found.column(f"g{k}").to_numpy() for k in range(rank)])
    return out


def gram_product(factors: Sequence[Factor]) -> np.ndarray:
    """Element-wise product of the factors' Gram matrices: the Gram matrix of
    their column-wise Kronecker product, which is never formed."""
    out = None
    for factor in factors:
        g = factor.gram()
        out = g if out is None else out * g
    return out


def times(u: Column, matrix: np.ndarray, k: int) -> Column:
    """k-th entry of the row vector u times a small matrix."""
    out = u[0] * float(matrix[0, k])
    for i in range(1, len(matrix)):
        out = out + u[i] * float(matrix[i, k])
    return out


def with_sums(factor: Factor, sums: DataFrame) -> DataFrame:
    """(axis, u, b): every row of the factor beside its sums, 0 where it has none."""
    zeros = F.array(*[F.lit(0.0)] * factor.rank)
    return factor.table.join(sums, factor.axis, "left").select(
        factor.axis, "u", F.coalesce("b", zeros).alias("b")
    )


def multiply_update(factor: Factor, sums: DataFrame, g: np.ndarray) -> Factor:
    """u_k * b_k / (u G)_k, guarded against a zero denominator."""
    u, b = F.col("u"), F.col("b")
    new = vector(factor.rank, lambda k: u[k] * b[k] / (times(u, g, k) + EPSILON))
    return factor.using(settle(with_sums(factor, sums).select(factor.axis, new.alias("u"))))


def to_array(table: DataFrame, axis: str, columns: Sequence[str]) -> tuple[list, list[np.ndarray]]:
    """Rows of a bounded table in axis order, as arrays."""
    rows = table.select(axis, *columns).toArrow()
    order = np.argsort(rows.column(axis).to_numpy(), kind="stable")
    found = []
    for c in columns:
        flat = rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        found.append(flat.reshape(len(order), -1)[order])
    return rows.column(axis).to_numpy()[order].tolist(), found


def array_table(like: Factor, keys: Sequence[int], values: np.ndarray, name: str = "u") -> DataFrame:
    """(axis, name): the rows of an array under the axis of `like`."""
    axis = like.table.select(like.axis).schema
    ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
    rows = pa.table({like.axis: pa.array(keys, pa.int64()), name: pa.ListArray.from_arrays(ends, pa.array(values.ravel()))})
    out = like.table.sparkSession.createDataFrame(rows)
    return out.select(F.col(like.axis).cast(axis[0].dataType).alias(like.axis), name)


def from_array(like: Factor, keys: Sequence[int], values: np.ndarray) -> Factor:
    return like.using(array_table(like, keys, values), values)


def update_columns_array(
    u: np.ndarray, b: np.ndarray, a: np.ndarray, radius: float | None = None, sub_iter: int = 1
) -> np.ndarray:
    """The update of `update_columns` on arrays."""
    u = u.copy()
    for k in range(u.shape[1]):
        for i in range(sub_iter):
            slope = u @ a[:, k] - b[:, k]
            step = 1.0 / ((i + 1) * (a[k, k] + 1.0))
            if radius is not None:
                step *= radius / max(radius, step * np.linalg.norm(slope))
            column = np.maximum(u[:, k] - step * slope, 0.0)
            u[:, k] = column / max(1.0, np.linalg.norm(column))
    return u


def update_columns(
    factor: Factor, sums: DataFrame, a: np.ndarray, radius: float | None = None, sub_iter: int = 1
) -> Factor:
    """Block projected gradient over the columns of a factor.

    Column k moves against (U A_k - b_k) by 1/((i+1)(A_kk+1)), at most `radius`
    far, is clipped at 0 and scaled to length at most 1; later columns see the
    new one. `sums` is the table (axis, b).
    """
    table = with_sums(factor, sums)

    def reach(k: int, i: int, length: float) -> float:
        step = 1.0 / ((i + 1) * (a[k, k] + 1.0))
        return step if radius is None else step * radius / max(radius, step * length)

    if factor.local:
        keys, (u, b) = to_array(table, factor.axis, ["u", "b"])
        return from_array(factor, keys, update_columns_array(u, b, a, radius, sub_iter))

    # The moves so far are numbers for all rows, so a task makes them anew from the
    # rows as they were: they are written once before, and once after.
    table = settle(table)
    moves: list[tuple[int, float, float]] = []
    for k in range(factor.rank):
        for i in range(sub_iter):
            length = 0.0 if radius is None else _length(table, a, moves, k)
            step = reach(k, i, length)
            moves.append((k, step, max(1.0, _length(table, a, moves, k, step))))

    axis, kind = factor.axis, table.schema[factor.axis].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = _moved(*_pair(batch, len(a)), a, moves)
            ends = pa.array(np.arange(len(u) + 1, dtype=np.int32) * len(a))
            yield pa.record_batch([batch.column(axis), pa.ListArray.from_arrays(ends, pa.array(u.ravel()))], names=[axis, "u"])

    out = factor.using(settle(table.mapInArrow(work, f"{axis} {kind}, u array<double>")))
    release(table)
    return out


def _pair(batch: pa.RecordBatch, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The arrays u and b of a batch."""
    return tuple(batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, rank) for c in ("u", "b"))


def _slope(u: np.ndarray, b: np.ndarray, a: np.ndarray, k: int) -> np.ndarray:
    """Column k of u A - b, added up in the order of the columns."""
    return sum(u[:, j] * a[j, k] for j in range(len(a))) - b[:, k]


def _moved(u: np.ndarray, b: np.ndarray, a: np.ndarray, moves: Sequence[tuple[int, float, float]]) -> np.ndarray:
    """u after the moves (column, step, length that divides it)."""
    u = u.copy()
    for k, step, norm in moves:
        u[:, k] = np.maximum(u[:, k] - step * _slope(u, b, a, k), 0.0) / norm
    return u


def _length(
    table: DataFrame, a: np.ndarray, moves: Sequence[tuple[int, float, float]], k: int, step: float | None = None
) -> float:
    """Length over all rows (u, b), after the moves, of the slope of column k, or of that column once it has moved by `step`."""
    done = list(moves)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            u, b = _pair(batch, len(a))
            u = _moved(u, b, a, done)
            column = _slope(u, b, a, k) if step is None else np.maximum(u[:, k] - step * _slope(u, b, a, k), 0.0)
            total += float(column @ column)
        yield pa.record_batch([pa.array([total])], names=["s"])

    return float(np.sqrt(table.select("u", "b").mapInArrow(work, "s double").agg(F.sum("s")).first()[0] or 0.0))
