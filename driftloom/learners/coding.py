"""Codes of rows against a fixed dictionary.

A row needs only its own sums b = W'x and the Gram matrix W'W, so coding is one
aggregation over the cells and a small solver applied to Arrow batches of b.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from driftloom.learners.algebra import (
    Factor, contract, gram, gram_product, times, vector,
)
from driftloom.operators.joins import hashed
from driftloom.operators.sampling import hash_int, hash_uniform
from driftloom.session import settle


# Rounds of coordinate descent, after which a code that still moves is an error.
ROUNDS = 100_000


def least_squares_array(b: np.ndarray, g: np.ndarray, alpha: float = 0.0, tolerance: float = 1e-9) -> np.ndarray:
    """h >= 0 minimising |x - W h|^2 / 2 + alpha * sum(h), for every row b = W'x.

    Coordinate descent finds which entries are positive; their values then come
    from the normal equations of those entries.
    """
    target = b - alpha
    h = np.zeros_like(target)
    # Each row stops by its own moves, so no row depends on its batch.
    open_ = np.arange(len(h))
    for _ in range(ROUNDS):
        part, goal = h[open_], target[open_]
        moved = np.zeros(len(open_))
        for k in range(len(g)):
            if g[k, k] <= 0:
                continue
            new = np.maximum(part[:, k] + (goal[:, k] - part @ g[:, k]) / g[k, k], 0.0)
            moved = np.maximum(moved, np.abs(new - part[:, k]))
            part[:, k] = new
        h[open_] = part
        open_ = open_[moved > tolerance * part.max(axis=1)]
        if not len(open_):
            break
    else:
        raise ArithmeticError(f"{len(open_)} codes did not settle in {ROUNDS} rounds")
    supports, member = np.unique(h > 0, axis=0, return_inverse=True)
    for number, support in enumerate(supports):
        rows = np.flatnonzero(member.ravel() == number)
        on = np.flatnonzero(support)
        if len(on) and np.linalg.matrix_rank(g[np.ix_(on, on)]) == len(on):
            exact = np.linalg.solve(g[np.ix_(on, on)], target[np.ix_(rows, on)].T).T
            fits = (exact >= 0).all(axis=1)
            h[np.ix_(rows[fits], on)] = exact[fits]
    return h


def least_squares_codes(b: Column, g: np.ndarray, alpha: float = 0.0, tolerance: float = 1e-9) -> Column:
    """The codes of `least_squares_array` for a column of sums."""

    @F.pandas_udf("array<double>")
    def solve(batch: pd.Series) -> pd.Series:
        if batch.empty:
            return batch
        return pd.Series(list(least_squares_array(np.vstack(batch.to_list()), g, alpha, tolerance)))

    return solve(b)


def sweep_array(h: np.ndarray, b: np.ndarray, g: np.ndarray, sweeps: int = 10, alpha: float = 0.0) -> np.ndarray:
    """The sweeps of `swept_codes` on arrays."""
    h = h.copy()
    for i in range(sweeps):
        for k in range(len(g)):
            slope = h @ g[k] - b[:, k] + alpha
            h[:, k] = np.maximum(h[:, k] - slope / ((i + 1) * (g[k, k] + 1.0)), 0.0)
    return h


def swept_codes(b: Column, h0: Column, g: np.ndarray, sweeps: int = 10, alpha: float = 0.0) -> Column:
    """A fixed number of projected gradient sweeps from h0: entry k moves by
    1/((i+1)(G_kk+1)) in sweep i and is clipped at 0."""

    @F.pandas_udf("array<double>")
    def sweep(batch: pd.Series, start: pd.Series) -> pd.Series:
        if batch.empty:
            return batch
        return pd.Series(list(sweep_array(np.vstack(start.to_list()), np.vstack(batch.to_list()), g, sweeps, alpha)))

    return sweep(b, h0)


def sketched_codes(bs: Column, h0: Column, gs: np.ndarray, alpha: float = 0.0) -> Column:
    """Sweeps of which each has sums and a Gram matrix of its own: bs[i] and gs[i]."""

    @F.pandas_udf("array<double>")
    def sweep(batch: pd.Series, start: pd.Series) -> pd.Series:
        if batch.empty:
            return batch
        target, h = np.stack([np.vstack(r) for r in batch]), np.vstack(start.to_list())
        for i, g in enumerate(gs):
            for k in range(len(g)):
                slope = h @ g[k] - target[:, i, k] + alpha
                h[:, k] = np.maximum(h[:, k] - slope / ((i + 1) * (g[k, k] + 1.0)), 0.0)
        return pd.Series(list(h))

    return sweep(bs, h0)


def sketch(
    cells: DataFrame, factors: Sequence[Factor], by: str, ratio: int, sweeps: int = 10, seed: int = 0
) -> tuple[DataFrame, np.ndarray]:
    """(by, bs) and Gram matrices, a pair for every sweep, from drawn rows of the dictionary.

    The dictionary's rows are the tuples of indices of `factors`. A sweep draws
    one in `ratio` of their number, with replacement, index by index from hashes
    of axis, sweep, draw and seed; a row drawn twice counts twice, as it comes twice.
    Draws are neither counted nor sorted: they are formed once for the Gram matrices
    and once for the one equi-join that finds the cells on them for all sweeps.
    """
    if ratio < 1:
        raise ValueError("one row in `ratio` is drawn: it must be 1 at least")
    rank, axes = factors[0].rank, [f.axis for f in factors]
    n = max(1, math.prod(f.size for f in factors) // ratio)
    turn, draw = F.floor(F.col("id") / n), F.col("id") % n
    drawn = cells.sparkSession.range(sweeps * n).select(
        turn.cast("int").alias("_turn"),
        *[(hash_int(F.lit(f.axis), turn, draw, seed) % f.size).cast("int").alias(f.axis) for f in factors],
    )
    joined = drawn
    # Those that are sent to every task first, so that rows are dealt out by the others once.
    for f in sorted(factors, key=lambda f: not f.local):
        joined = joined.join(f.joinable(f"_{f.axis}"), f.axis)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((sweeps, rank, rank))
        for batch in batches:
            at = batch.column("_turn").to_numpy(zero_copy_only=False)
            product = np.ones((len(at), rank))
            for axis in axes:
                product *= batch.column(f"_{axis}").flatten().to_numpy(zero_copy_only=False).reshape(-1, rank)
            for i in np.unique(at):
                own = product[at == i]
                total[i] += own.T @ own
        flat = total.reshape(sweeps * rank, rank)
        columns = [pa.array(flat[:, k]) for k in range(rank)]
        yield pa.record_batch([pa.array(range(len(flat)), pa.int32()), *columns], names=["i", *(f"g{k}" for k in range(rank))])

    schema = ", ".join(["i int", *(f"g{k} double" for k in range(rank))])
    sent = joined.select("_turn", *[f"_{a}" for a in axes]).mapInArrow(work, schema).groupBy("i")
    found = sent.agg(*[F.sum(f"g{k}").alias(f"g{k}") for k in range(rank)]).toArrow()
    gs = np.zeros((sweeps * rank, rank))
    gs[found.column("i").to_numpy()] = np.column_stack([found.column(f"g{k}").to_numpy() for k in range(rank)])
    # A cell meets every draw of its row; the draws, far more than the cells, are not sorted for that.
    met = drawn.join(hashed(cells, cells.count()), axes)
    sums = contract(met, factors, [by, "_turn"], rank).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("_turn", "b"))).alias("_b"))
    zeros = F.array(*[F.lit(0.0)] * rank)
    every = F.transform(F.sequence(F.lit(0), F.lit(sweeps - 1)), lambda i: F.coalesce(F.try_element_at("_b", i), zeros))
    return sums.select(by, every.alias("bs")), gs.reshape(sweeps, rank, rank)


def _no_sketch(sweeps: int, rank: int) -> Column:
    return F.array(*[F.array(*[F.lit(0.0)] * rank)] * sweeps)


def with_sketch(table: DataFrame, sums: DataFrame, by: str, sweeps: int, rank: int) -> DataFrame:
    """`table` with the sums of every sweep beside it, 0 for a row no drawn cell lies in."""
    return table.join(sums, by, "left").withColumn("bs", F.coalesce("bs", _no_sketch(sweeps, rank)))


def swept_codes_coupled(
    table: DataFrame, axis: str, g: np.ndarray, sweeps: int = 10, alpha: float = 0.0,
    radius: float | None = None, least_move: float | None = None,
) -> DataFrame:
    """The same over a table (axis, u, b) with rules that look at all rows at once.

    A move is at most `radius` long over all rows, and is left out when its
    length is no more than `least_move` times the spectral norm of the codes.
    With a Gram matrix for every sweep (an array of three axes) the table holds
    the sums of every sweep in `bs`.
    """
    each, rank = g if g.ndim == 3 else None, g.shape[-1]
    u = F.col("u")
    for i in range(sweeps):
        g = g if each is None else each[i]
        b = F.col("b") if each is None else F.col("bs")[i]
        size = 0.0
        if least_move is not None:
            size = float(np.sqrt(np.linalg.eigvalsh(gram(table, rank))[-1].clip(0)))
        for k in range(rank):
            slope = times(u, g, k) - b[k] + alpha
            length = table.agg(F.sqrt(F.sum(slope * slope))).first()[0] or 0.0
            step = 1.0 / ((i + 1) * (g[k, k] + 1.0))
            if radius is not None:
                step *= radius / max(radius, step * length)
            if least_move is not None and step * length <= least_move * size:
                step = 0.0
            moved = F.greatest(u[k] - step * slope, F.lit(0.0))
            table = table.withColumn("u", vector(rank, lambda j: moved if j == k else u[j]))
        table = settle(table)
    return table


def code_documents(
    cells: DataFrame, dictionary: Factor, by: str = "doc_id", alpha: float = 0.0,
    documents: DataFrame | None = None,
) -> DataFrame:
    """(by, h): nonnegative codes; alpha > 0 adds the sparsity penalty.

    Rows without cells appear with code 0 only when `documents(by)` is given.
    """
    rank = dictionary.rank
    sums = contract(cells, [dictionary], [by], rank)
    coded = sums.select(by, least_squares_codes(F.col("b"), dictionary.gram(), alpha).alias("h"))
    if documents is None:
        return coded
    zeros = F.array(*[F.lit(0.0)] * rank)
    return documents.select(by).join(coded, by, "left").select(by, F.coalesce("h", zeros).alias("h"))


def nmf_transform(cells: DataFrame, dictionary: Factor, **options) -> DataFrame:
    """Least-squares codes for a given dictionary."""
    return code_documents(cells, dictionary, alpha=0.0, **options)


def sparse_code_transform(cells: DataFrame, dictionary: Factor, alpha: float = 1.0, **options) -> DataFrame:
    """Codes with an L1 penalty."""
    return code_documents(cells, dictionary, alpha=alpha, **options)


def cp_codes(
    cells: DataFrame, factors: list[Factor], by: str, rows: DataFrame, alpha: float = 0.0,
    sweeps: int = 10, seed: int = 0, least_move: float | None = None, subsample_ratio: int | None = None,
) -> DataFrame:
    """(by, h): codes against a CP dictionary, which is given by its factors.

    `rows(by)` lists all rows to be coded; each starts from a hashed random
    code. `least_move` turns on the rule that leaves out small moves, which
    looks at all rows together. With `subsample_ratio` every sweep sees one in so
    many rows of the dictionary, drawn anew.
    """
    rank = factors[0].rank
    zeros = F.array(*[F.lit(0.0)] * rank)
    start = vector(rank, lambda k: hash_uniform(F.lit("code"), by, k, seed))
    if subsample_ratio is not None:
        sums, gs = sketch(cells, factors, by, subsample_ratio, sweeps, seed)
        table = with_sketch(rows.select(by, start.alias("u")), sums, by, sweeps, rank)
        if least_move is None:
            return table.select(by, sketched_codes(F.col("bs"), F.col("u"), gs, alpha).alias("h"))
        swept = swept_codes_coupled(table, by, gs, sweeps, alpha, least_move=least_move)
        return swept.select(by, F.col("u").alias("h"))
    sums = contract(cells, factors, [by], rank)
    table = rows.select(by).join(sums, by, "left").select(
        by, start.alias("u"), F.coalesce("b", zeros).alias("b")
    )
    g = gram_product(factors)
    if least_move is None:
        return table.select(by, swept_codes(F.col("b"), F.col("u"), g, sweeps, alpha).alias("h"))
    swept = swept_codes_coupled(table, by, g, sweeps, alpha, least_move=least_move)
    return swept.select(by, F.col("u").alias("h"))
