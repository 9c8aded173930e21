"""Passes over sparse rows: tasks add up their own cells, one small shuffle adds up the tasks.

A factor that every task holds is an array; the one axis whose factor is too long
for that is the rows' own: each row carries its cells and its part of the
factor, `u`. A pass may move every row's `u` by a rule that needs the row's sums
only, and gives the sums of one held axis, the Gram matrix of the rows and the
inner product with the model. No cell is joined or shuffled, and what is shuffled
are at most the numbers of one held factor per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from driftloom.learners.algebra import Factor
from driftloom.session import release, stored

#: Cells worked on at once: with the rank they bound a task's memory.
CELLS = 1 << 18
#: Sums sent in one batch.
SENT = 1 << 15
#: Moves after which the rows are written; up to there a pass makes them anew.
KEPT = 4

#: (rows' u, their sums b, Gram matrix of the others) -> new u.
Rule = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Sums:
    """What a pass added up: (size, rank) of the wanted axis, the rows' Gram matrix, <cells, model>."""

    axis: np.ndarray | None
    gram: np.ndarray
    inner: float


def dense(factor: Factor) -> np.ndarray:
    """The values of a local factor, whose indices must be 0 … size - 1."""
    if factor.values is not None:
        return factor.values
    rows = factor.table.select(factor.axis, "u").toArrow()
    order = np.argsort(rows.column(factor.axis).to_numpy(), kind="stable")
    if not np.array_equal(rows.column(factor.axis).to_numpy()[order], np.arange(factor.size)):
        raise ValueError(f"indices of {factor.axis} are not 0 … {factor.size - 1}")
    return _matrix(rows.column("u").combine_chunks(), factor.rank)[order]


def _matrix(column: pa.Array, rank: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, rank)


def gather(cells: DataFrame, by: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """(by, …axes, x): one row an index, its cells as arrays of one length."""
    held = cells.groupBy(*by).agg(F.collect_list(F.struct(*axes, "x")).alias("_c"))
    return held.select(*by, *[F.col(f"_c.{c}").alias(c) for c in (*axes, "x")])


def with_factor(rows: DataFrame, factor: Factor, axes: Sequence[str]) -> DataFrame:
    """Every row of the factor with its cells beside it, none where it has no cells."""
    names = (*axes, "x")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = factor.table.select(factor.axis, "u").join(rows, factor.axis, "left")
    return out.select(factor.axis, "u", *[F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in names])


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cuts of a batch of rows that hold at most CELLS cells, or one row."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("x")), 0).to_numpy(zero_copy_only=False))
    row = 0
    while row < batch.num_rows:
        before = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, before + CELLS, side="right")))
        yield batch.slice(row, stop - row)
        row = stop


def row_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of rows; an empty stretch sums to 0."""
    ends = np.cumsum(sizes)
    some = np.flatnonzero(sizes > 0)
    out = np.zeros((len(sizes), values.shape[1]))
    if len(some):
        out[some] = np.add.reduceat(values, (ends - sizes)[some], axis=0)
    return out


def place_sums(values: np.ndarray, places: np.ndarray, out: np.ndarray) -> None:
    """Add every row of `values` to the row of `out` at its place."""
    for k in range(values.shape[1]):
        out[:, k] += np.bincount(places, weights=values[:, k], minlength=len(out))


def _lists(values: np.ndarray) -> pa.Array:
    n, rank = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * rank), pa.array(values.ravel()))


def sent(total: np.ndarray | None, gram: np.ndarray, inner: float) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(key, b): sums by index, the Gram matrix's rows at -1 …, the inner product behind them."""
    rank = len(gram)
    last = np.zeros((1, rank))
    last[0, 0] = inner
    yield pa.array(-1 - np.arange(rank + 1)), _lists(np.vstack([gram, last]))
    if total is not None:
        touched = np.flatnonzero(total.any(axis=1))
        for lo in range(0, len(touched), SENT):
            at = touched[lo:lo + SENT]
            yield pa.array(at), _lists(total[at])


def added(sums: DataFrame, rank: int, size: int | None) -> Sums:
    """Add up what the tasks sent."""
    columns = [F.sum(F.col("b")[k]).alias(f"b{k}") for k in range(rank)]
    found = sums.where("key is not null").groupBy("key").agg(*columns).toArrow()
    keys = found.column("key").to_numpy()
    values = np.column_stack([found.column(f"b{k}").to_numpy() for k in range(rank)]) if rank else np.zeros((len(keys), 0))
    table = np.zeros((rank + 1, rank))
    table[-1 - keys[keys < 0]] = values[keys < 0]
    total = None
    if size is not None:
        total = np.zeros((size, rank))
        total[keys[keys >= 0]] = values[keys >= 0]
    return Sums(total, table[:rank], float(table[rank, 0]))


SENT_SCHEMA = "key bigint, b array<double>"


def cell_sums(cells: DataFrame, held: dict[str, np.ndarray], want: str | None) -> Sums:
    """Sums over cells (axes, x) all of whose factors are held: of axis `want`, and the inner product."""
    rank = next(iter(held.values())).shape[1]
    shared = cells.sparkSession.sparkContext.broadcast(held)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = shared.value
        total = None if want is None else np.zeros((len(arrays[want]), rank))
        inner = 0.0
        for batch in batches:
            for lo in range(0, batch.num_rows, CELLS):
                part = batch.slice(lo, CELLS)
                x = part.column("x").to_numpy(zero_copy_only=False)
                product = np.repeat(x[:, None], rank, axis=1)
                for axis, values in arrays.items():
                    if axis != want:
                        product *= values[part.column(axis).to_numpy(zero_copy_only=False)]
                if want is None:
                    inner += float(product.sum())
                else:
                    place_sums(product, part.column(want).to_numpy(zero_copy_only=False), total)
        for key, b in sent(total, np.zeros((rank, rank)), inner):
            yield pa.record_batch([key, b], names=["key", "b"])

    return added(cells.select(*held, "x").mapInArrow(work, SENT_SCHEMA), rank, None if want is None else len(held[want]))


def coded_sums(rows: DataFrame, axis: str, w: np.ndarray, code: Callable[[np.ndarray], np.ndarray]) -> Sums:
    """A = H'H and B = X'H of rows (axis, x), whose codes H come from their sums XW by `code`.

    Coding, A and B are one pass: a row's code is not kept.
    """
    rank = w.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = shared.value
        total, gram = np.zeros(values.shape), np.zeros((rank, rank))
        for batch in batches:
            for part in _parts(batch):
                sizes = pc.list_value_length(part.column("x")).to_numpy(zero_copy_only=False).astype(np.int64)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False)[:, None]
                places = part.column(axis).flatten().to_numpy(zero_copy_only=False)
                h = code(row_sums(values[places] * x, sizes))
                gram += h.T @ h
                place_sums(np.repeat(h, sizes, axis=0) * x, places, total)
        for key, b in sent(total, gram, 0.0):
            yield pa.record_batch([key, b], names=["key", "b"])

    return added(rows.select(axis, "x").mapInArrow(work, SENT_SCHEMA), rank, len(w))


def _moved(
    part: pa.RecordBatch, axes: Sequence[str], rank: int, moves: Sequence[tuple[dict[str, np.ndarray], np.ndarray, Rule]]
) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """(u after the moves, cells a row, their places by axis, their x) of a part of rows."""
    sizes = pc.list_value_length(part.column("x")).to_numpy(zero_copy_only=False).astype(np.int64)
    x = part.column("x").flatten().to_numpy(zero_copy_only=False)
    places = {a: part.column(a).flatten().to_numpy(zero_copy_only=False) for a in axes}
    u = _matrix(part.column("u"), rank).copy()
    for arrays, g, rule in moves:
        product = np.repeat(x[:, None], rank, axis=1)
        for a in axes:
            product *= arrays[a][places[a]]
        u = rule(u, row_sums(product, sizes), g)
    return u, sizes, places, x


class Rows:
    """Rows (by, u, …axes, x) that are moved from pass to pass.

    What a pass reads is written once in KEPT moves. The moves since are the arrays
    that they were made with: a task makes them anew, and so no pass writes cells.
    `grouped` is what `gather` gives of the cells, if it is at hand.
    """

    def __init__(self, cells: DataFrame, factor: Factor, axes: Sequence[str], grouped: DataFrame | None = None):
        self.factor, self.by, self.rank, self.axes = factor, factor.axis, factor.rank, list(axes)
        if grouped is None:
            grouped = gather(cells, [self.by], self.axes)
        self.table = stored(with_factor(grouped, factor, self.axes), "rows")
        self.moves: list[tuple[dict[str, np.ndarray], np.ndarray, Rule]] = []

    def run(self, held: dict[str, np.ndarray], want: str | None, rule: Rule | None = None, g: np.ndarray | None = None) -> Sums:
        """One pass: move the rows if a rule is given, then add up."""
        if rule is not None:
            if len(self.moves) >= KEPT:
                self._write()
            self.moves.append((dict(held), g, rule))
        rank, axes = self.rank, self.axes
        shared, rules = self._sent(held)

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrays, made = shared.value
            moves = [(*m, r) for m, r in zip(made, rules)]
            total = None if want is None else np.zeros((len(arrays[want]), rank))
            gram, inner = np.zeros((rank, rank)), 0.0
            for batch in batches:
                for part in _parts(batch):
                    u, sizes, places, x = _moved(part, axes, rank, moves)
                    gram += u.T @ u
                    product = np.repeat(u, sizes, axis=0) * x[:, None]
                    for a in axes:
                        if a != want:
                            product *= arrays[a][places[a]]
                    if want is None:
                        inner += float(product.sum())
                    else:
                        place_sums(product, places[want], total)
            for key, b in sent(total, gram, inner):
                yield pa.record_batch([key, b], names=["key", "b"])

        return added(self.table.mapInArrow(work, SENT_SCHEMA), rank, None if want is None else len(held[want]))

    def _sent(self, held: dict[str, np.ndarray]) -> tuple[Broadcast, list[Rule]]:
        """What tasks need: held arrays and those of the moves as a broadcast, and the moves' rules."""
        made = [(arrays, g) for arrays, g, _ in self.moves]
        return self.table.sparkSession.sparkContext.broadcast((held, made)), [rule for _, _, rule in self.moves]

    def _after_moves(self, columns: Sequence[str], name: str) -> DataFrame:
        """The columns of the rows, after all moves, written."""
        rank, axes = self.rank, self.axes
        shared, rules = self._sent({})

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            moves = [(*m, r) for m, r in zip(shared.value[1], rules)]
            for batch in batches:
                for part in _parts(batch):
                    u = _moved(part, axes, rank, moves)[0]
                    yield pa.record_batch([_lists(u) if c == "u" else part.column(c) for c in columns], names=list(columns))

        return stored(self.table.mapInArrow(work, self.table.select(*columns).schema), name)

    def _write(self) -> None:
        """Write the rows as they are now, in place of those they came from."""
        before, self.table = self.table, self._after_moves(self.table.columns, "rows")
        self.moves = []
        release(before)

    def result(self) -> Factor:
        """The factor as it is now, written; the rows are given up."""
        out = self.factor.using(self._after_moves([self.by, "u"], "factor"))
        release(self.table)
        return out
