"""Online learners: matrices (ONMF, tensor unfoldings) and CP dictionaries.

The state carried from step to step is the dictionary, the rank x rank matrix A
and the table B. A step codes one batch, folds the batch into A and B with a
falling weight, and updates the dictionary from them.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, functions as F

from driftloom.learners.algebra import (
    Factor, array_table, contract, from_array, gram, gram_product, to_array, update_columns, update_columns_array, vector,
)
from driftloom.learners.coding import cp_codes, least_squares_array, least_squares_codes
from driftloom.learners.factorise import reconstruction_error
from driftloom.learners.passes import coded_sums, dense, gather
from driftloom.operators.sampling import draws, sample_time_patches
from driftloom.operators.tensor import slice_time
from driftloom.session import release, settle, stored


@dataclass
class MatrixState:
    """Dictionary `terms`, A and B(axis, b) of a matrix learner after `t` steps."""

    terms: Factor
    a: np.ndarray
    b: DataFrame | None = None
    t: int = 0


def fold_in(old: DataFrame | None, new: DataFrame, keys: Sequence[str], weight: float, rank: int) -> DataFrame:
    """(keys, b): (1 - weight) * old + weight * new, checkpointed."""
    scaled = new.select(*keys, vector(rank, lambda k: F.col("b")[k] * weight).alias("b"))
    if old is not None and weight < 1.0:
        faded = old.select(*keys, vector(rank, lambda k: F.col("b")[k] * (1.0 - weight)).alias("b"))
        both = faded.unionByName(scaled).groupBy(*keys)
        sums = both.agg(*[F.sum(F.col("b")[k]).alias(f"_{k}") for k in range(rank)])
        scaled = sums.select(*keys, vector(rank, lambda k: F.col(f"_{k}")).alias("b"))
    return settle(scaled)


def _no_sums(factor: Factor) -> DataFrame:
    return factor.table.select(factor.axis, F.array(*[F.lit(0.0)] * factor.rank).alias("b")).limit(0)


def onmf_step(
    batch: DataFrame, state: MatrixState, t: int, beta: float = 1.0, alpha: float = 1.0,
    by: str = "draw", use_fresh_stats: bool = False,
) -> tuple[DataFrame, MatrixState]:
    """One step on `batch(by, axis, x)`: (codes(by, u), new state).

    The dictionary is updated from the statistics *before* this batch, unless
    `use_fresh_stats` asks for the textbook order. Rows without cells have code
    0 and add nothing, so they need not be listed.
    """
    terms, rank = state.terms, state.terms.rank
    sums = contract(batch, [terms], [by], rank)
    g = terms.gram()
    codes = settle(sums.select(by, least_squares_codes(F.col("b"), g, alpha).alias("u")))
    weight = float(t) ** -beta
    a = (1.0 - weight) * state.a + weight * gram(codes, rank)
    joined = batch.join(codes, by)
    new = joined.groupBy(terms.axis).agg(*[F.sum(F.col("x") * F.col("u")[k]).alias(f"_{k}") for k in range(rank)])
    new = new.select(terms.axis, vector(rank, lambda k: F.col(f"_{k}")).alias("b"))
    b = fold_in(state.b, new, [terms.axis], weight, rank)
    used_a, used_b = (a, b) if use_fresh_stats else (state.a, state.b)
    updated = update_columns(terms, _no_sums(terms) if used_b is None else used_b, used_a)
    return codes, MatrixState(updated, a, b, t)


def sufficient_stats(batch: DataFrame, codes: DataFrame, rank: int, axis: str, by: str) -> tuple[np.ndarray, DataFrame]:
    """(A, B) of a batch: A = H H', B(axis, b) = H X'. `codes` is (by, u)."""
    joined = batch.join(codes, by)
    sums = joined.groupBy(axis).agg(*[F.sum(F.col("x") * F.col("u")[k]).alias(f"_{k}") for k in range(rank)])
    return gram(codes, rank), sums.select(axis, vector(rank, lambda k: F.col(f"_{k}")).alias("b"))


def _batches(entries: DataFrame, column: str, population: int, steps: int, size: int, seed: int) -> DataFrame:
    """All batches of a run in one pass over the data: (iter, draw, …entries).

    At most steps x size rows of the matrix are taken, whatever its length.
    """
    drawn = draws(entries.sparkSession, steps, size, population, seed).withColumnRenamed("pos", column)
    return drawn.join(entries, column).drop(column)


def _steps(
    entries: DataFrame, column: str, population: int, state: MatrixState, first: int, steps: int, size: int,
    beta: float, alpha: float, seed: int, use_fresh_stats: bool = False,
) -> MatrixState:
    """`steps` steps, numbered from `first`, on batches drawn by `column` from entries(column, axis, x).

    A step reads its own batch only: batches are written by their number. With a
    local dictionary a batch is rows of cells, and a step one pass over them.
    """
    terms, axis = state.terms, state.terms.axis
    batches = _batches(entries, column, population, steps, size, seed)
    if not terms.local:
        batches = stored(batches.repartitionByRange("iter", "draw"), "batches", "iter")
        for i in range(steps):
            batch, before = batches.where(F.col("iter") == i + 1).drop("iter"), state
            codes, state = onmf_step(batch, before, first + i, beta, alpha, use_fresh_stats=use_fresh_stats)
            # The state that came in is the caller's; those in between are read by the next step only.
            release(codes, *([before.terms.table, before.b] if i else []))
        release(batches)
        return state
    rows = gather(batches, ["iter", "draw"], [axis]).repartitionByRange("iter", "draw")
    rows = stored(rows, "batches", "iter")
    w, a, b = dense(terms), state.a, np.zeros((terms.size, terms.rank))
    if state.b is not None:
        keys, (values,) = to_array(state.b, axis, ["b"])
        b[keys] = values
    for i in range(steps):
        code = partial(least_squares_array, g=w.T @ w, alpha=alpha)
        sums = coded_sums(rows.where(F.col("iter") == i + 1), axis, w, code)
        weight = float(first + i) ** -beta
        new_a, new_b = (1.0 - weight) * a + weight * sums.gram, (1.0 - weight) * b + weight * sums.axis
        w = update_columns_array(w, new_b, new_a) if use_fresh_stats else update_columns_array(w, b, a)
        a, b = new_a, new_b
    release(rows)
    if not steps:
        return state
    every = range(terms.size)
    return MatrixState(from_array(terms, every, w), a, array_table(terms, every, b, "b"), first + steps - 1)


def onmf_slice(
    entries: DataFrame, n_docs: int, number: int, state: MatrixState, iterations: int = 500,
    batch_size: int = 100, beta: float = 1.0, alpha: float = 1.0, seed: int = 0, use_fresh_stats: bool = False,
) -> MatrixState:
    """iterations - 1 steps on batches drawn from slice `number`, entries(pos, axis, x)."""
    return _steps(
        entries, "pos", n_docs, state, number * iterations + 1, iterations - 1, batch_size, beta, alpha,
        seed + number, use_fresh_stats,
    )


def onmf_train(
    slices: Iterable[tuple[DataFrame, int]], terms: Factor, get_dicts: Sequence[int] = (),
    state: MatrixState | None = None, **options,
) -> tuple[MatrixState, dict[int, DataFrame]]:
    """Learn over slices in order; each is (entries(pos, axis, x), documents).

    Options are those of `onmf_slice`. Returns the last state and the
    dictionaries after the slices listed in `get_dicts` (0 = start).
    """
    state = state or MatrixState(terms, np.zeros((terms.rank, terms.rank)))
    versions = {0: state.terms.table} if 0 in get_dicts else {}
    for number, (entries, n_docs) in enumerate(slices):
        before, state = state, onmf_slice(entries, n_docs, number, state, **options)
        if number and before is not state:
            release(before.b, None if number in get_dicts else before.terms.table)
        if number + 1 in get_dicts:
            versions[number + 1] = state.terms.table
    return state, versions


def ontf_train(
    unfolding: DataFrame, n_columns: int, rows: Factor, iterations: int = 500, batch_size: int = 100,
    alpha: float = 2.0, seed: int = 0, state: MatrixState | None = None,
) -> MatrixState:
    """Online learning on an unfolding (row, col, x) with weights 1/t.

    `rows.axis` is the unfolding's row axis. A state given continues its count.
    """
    state = state or MatrixState(rows, np.zeros((rows.rank, rows.rank)))
    entries = unfolding.withColumnRenamed("row", rows.axis)
    return _steps(entries, "col", n_columns, state, state.t + 1, iterations - 1, batch_size, 1.0, alpha, seed)


# ---- CP dictionaries --------------------------------------------------------


@dataclass
class CPState:
    """Factors by axis, A and B(axes, b) of a CP learner after `t` steps."""

    factors: dict[str, Factor]
    a: np.ndarray
    b: DataFrame | None = None
    t: int = 0
    codes: list[DataFrame] = field(default_factory=list)
    trace: list[tuple[int, float, float]] = field(default_factory=list)

    @property
    def rank(self) -> int:
        return next(iter(self.factors.values())).rank


def cp_gram(a: np.ndarray, factors: dict[str, Factor], axis: str) -> np.ndarray:
    """A times, element-wise, the Gram matrices of the other factors."""
    others = [f for name, f in factors.items() if name != axis]
    return a * gram_product(others) if others else a


def cp_mttkrp_agg(b: DataFrame, factors: dict[str, Factor], axis: str, rank: int) -> DataFrame:
    """(axis, b): the table B contracted with all other factors."""
    others = [f for name, f in factors.items() if name != axis]
    return contract(b, others, [axis], rank, value=lambda k: F.col("b")[k])


def ocpd_update_factors(
    factors: dict[str, Factor], a: np.ndarray, b: DataFrame, radius: float | None = None, sub_iter: int = 1
) -> dict[str, Factor]:
    """Update axis after axis; later axes see the earlier updates."""
    factors = dict(factors)
    rank = len(a)
    for axis in factors:
        sums = cp_mttkrp_agg(b, factors, axis, rank)
        factors[axis] = update_columns(factors[axis], sums, cp_gram(a, factors, axis), radius, sub_iter)
    return factors


def ocpd_step(
    batch: DataFrame, rows: DataFrame, state: CPState, t: int, by: str, beta: float | None = None,
    alpha: float = 0.0, radius_const: float = 10_000.0, sub_iter: int = 1, sweeps: int = 10,
    seed: int = 0, least_move: float | None = None, subsample_ratio: int | None = None,
) -> tuple[DataFrame, CPState]:
    """One step on `batch(axes, by, x)`, whose items are listed in `rows(by)`.

    Codes, then A and B with weight t^-beta, then the factors from the new A and
    B within a radius that falls with t. Without beta the weight is 1/t and the
    radius does not fall by beta. With `subsample_ratio` codes come from drawn rows
    of the dictionary; A, B and the factors see all cells of the batch.
    """
    rank = state.rank
    factors = list(state.factors.values())
    axes = list(state.factors)
    codes = settle(cp_codes(batch, factors, by, rows, alpha, sweeps, seed + t, least_move, subsample_ratio))
    weight = float(t) ** -(1.0 if beta is None else beta)
    a = (1.0 - weight) * state.a + weight * gram(codes, rank, "h")
    joined = batch.join(codes, by)
    sums = joined.groupBy(*axes).agg(*[F.sum(F.col("x") * F.col("h")[k]).alias(f"_{k}") for k in range(rank)])
    new = sums.select(*axes, vector(rank, lambda k: F.col(f"_{k}")).alias("b"))
    b = fold_in(state.b, new, axes, weight, rank)
    radius = radius_const * (t + 1.0) ** -(1.0 if beta is None else beta) / np.log(t + 2.0)
    updated = ocpd_update_factors(state.factors, a, b, radius, sub_iter)
    return codes, replace(state, factors=updated, a=a, b=b, t=t)


def ocpd_train(
    cells: DataFrame, factors: dict[str, Factor], batch_axis: str, n_items: int, iterations: int = 500,
    batch_size: int | None = 20, beta: float | None = None, alpha: float = 0.0, seed: int = 0,
    sub_iter: int = 1, sweeps: int = 10, radius_const: float = 10_000.0, state: CPState | None = None,
    with_trace: bool = False, subsample_ratio: int | None = None,
) -> CPState:
    """iterations - 1 steps over the items of `batch_axis`.

    `factors` belong to the other axes. Each step draws `batch_size` items with
    replacement, or takes all of them when it is None. `state` resumes a run.
    The codes of the steps are kept in `state.codes`; see `accumulated_codes`.
    """
    spark = cells.sparkSession
    rank = next(iter(factors.values())).rank
    state = state or CPState(dict(factors), np.zeros((rank, rank)))
    state = replace(state, codes=list(state.codes), trace=list(state.trace))
    start, spent = state.t, 0.0
    axes = list(factors)
    if batch_size is None:
        batch_all = cells.select(*axes, F.col(batch_axis).alias("draw"), "x").persist()
        rows = spark.range(n_items).select(F.col("id").cast("int").alias("draw"))
        items = rows.withColumn(batch_axis, F.col("draw"))
    else:
        drawn = draws(spark, iterations - 1, batch_size, n_items, seed).withColumnRenamed("pos", batch_axis)
        batch_all = drawn.join(cells, batch_axis).select("iter", "draw", *axes, "x")
        batch_all = stored(batch_all.repartitionByRange("iter", "draw"), "batches", "iter")
    for i in range(1, iterations):
        begin = time.perf_counter()
        if batch_size is None:
            batch = batch_all
        else:
            batch = batch_all.where(F.col("iter") == i).drop("iter")
            items = drawn.where(F.col("iter") == i).select("draw", batch_axis)
            rows = items.select("draw")
        codes, state = ocpd_step(
            batch, rows, state, start + i, "draw", beta, alpha, radius_const, sub_iter, sweeps, seed,
            subsample_ratio=subsample_ratio,
        )
        # An item drawn twice in a batch is added once: its last draw counts.
        last = items.groupBy(batch_axis).agg(F.max("draw").alias("draw"))
        state.codes.append(codes.join(last, "draw").select(batch_axis, "h"))
        spent += time.perf_counter() - begin
        if with_trace:
            items_all = spark.range(n_items).select(F.col("id").cast("int").alias(batch_axis))
            code = settle(cp_codes(cells, list(state.factors.values()), batch_axis, items_all, alpha, sweeps, seed))
            full = Factor(code.withColumnRenamed("h", "u"), batch_axis, n_items, rank, local=False)
            error, _ = reconstruction_error(cells, {**state.factors, batch_axis: full})
            state.trace.append((i, spent, error))
    if batch_size is None:
        batch_all.unpersist()
    return state


def accumulated_codes(state: CPState, batch_axis: str) -> DataFrame:
    """(batch_axis, h): sum of the codes an item received over the steps."""
    table = state.codes[0]
    for more in state.codes[1:]:
        table = table.unionByName(more)
    rank = state.rank
    sums = table.groupBy(batch_axis).agg(*[F.sum(F.col("h")[k]).alias(f"_{k}") for k in range(rank)])
    return sums.select(batch_axis, vector(rank, lambda k: F.col(f"_{k}")).alias("h"))


def ocpd_train_patches(
    cells: DataFrame, n_docs: int, factors: dict[str, Factor], patch_docs: int, iterations: int = 50,
    sub_iterations: int = 20, beta: float | None = None, alpha: float = 0.0, history: int = 0,
    seed: int = 0, state: CPState | None = None,
) -> CPState:
    """Warm-started learning from random patches of `patch_docs` documents.

    `factors` have the axes t, v and d, d counting the documents of a patch;
    the patch is the one item of the batch. All patches are taken in one pass
    over `cells(t, v, d, x)`: iterations x patch_docs documents, whatever their number.
    """
    drawn = None
    for turn in range(iterations):
        rows = draws(cells.sparkSession, 1, patch_docs, n_docs, seed + turn).select(
            F.lit(turn).alias("turn"), F.col("pos").alias("d"), F.col("draw").cast("int").alias("_place")
        )
        drawn = rows if drawn is None else drawn.unionByName(rows)
    patches = settle(drawn.join(cells, "d").select(
        "turn", "t", "v", F.col("_place").alias("d"), "x", F.lit(0).alias("patch")
    ))
    for turn in range(iterations):
        patch = patches.where(F.col("turn") == turn).drop("turn")
        state = _turn(patch, 1, turn, factors, sub_iterations, beta, alpha, history, seed, state)
    return state


def _turn(
    patch: DataFrame, n_items: int, turn: int, factors: dict[str, Factor], sub_iterations: int, beta: float | None,
    alpha: float, history: int, seed: int, state: CPState | None,
) -> CPState:
    """sub_iterations - 1 steps on all items of one turn, patch(axes, patch, x), from the turn before."""
    rank = next(iter(factors.values())).rank
    if state is None:
        state = CPState(dict(factors), np.zeros((rank, rank)), t=history)
    else:
        state = replace(state, t=history + turn, codes=[])
    return ocpd_train(patch, factors, "patch", n_items, sub_iterations, None, beta, alpha, seed + turn, state=state)


def ocpd_train_windows(
    cells: DataFrame, n_slices: int, length: int, patches: int, factors: dict[str, Factor], iterations: int = 50,
    sub_iterations: int = 20, beta: float | None = None, alpha: float = 0.0, history: int = 0, seed: int = 0,
    state: CPState | None = None,
) -> CPState:
    """Warm-started learning from random windows of `length` slices, `patches` of them a turn as one batch.

    `factors` have the axes t, v and d, t counting the slices of a window.
    `cells(t, v, d, x)` are written by slice once, and a turn reads the slices of
    its own windows only.
    """
    by_slice = stored(cells.repartition("t", F.pmod(F.xxhash64("v"), F.lit(SLICE_PARTS))), "slices", "t")
    for turn in range(iterations):
        # One number a window.
        starts = [r.pos for r in draws(cells.sparkSession, 1, patches, n_slices - length, seed + turn).collect()]
        needed = sorted({s + k for s in starts for k in range(length)})
        patch = sample_time_patches(by_slice.where(F.col("t").isin(needed)), n_slices, length, patches, seed + turn)
        state = _turn(patch, patches, turn, factors, sub_iterations, beta, alpha, history, seed, state)
    return state


#: Parts that the cells of one slice are written in.
SLICE_PARTS = 16


def windows(n_slices: int, length: int, slide: int) -> list[int]:
    """Starts of the complete windows."""
    return list(range(0, n_slices - length + 1, slide))


def ocpd_window(
    cells: DataFrame, start: int, number: int, n_docs: int, factors: dict[str, Factor],
    state: CPState | None, length: int = 20, patch_docs: int = 20, iterations: int = 50,
    sub_iterations: int = 2, refresh_history_as: int | None = None, beta: float | None = None,
    alpha: float = 0.0, seed: int = 0,
) -> CPState:
    """Learn window `number`, slices start .. start+length-1, from the window before.

    Its count starts at `refresh_history_as`, or at (number + 1) * iterations.
    """
    history = (number + 1) * iterations if refresh_history_as is None else refresh_history_as
    # Drawn documents are the only ones read, in one pass: nothing to keep.
    part = slice_time(cells, start, length)
    before = None if state is None else replace(state, t=history, codes=[])
    state = ocpd_train_patches(
        part, n_docs, factors, patch_docs, iterations, sub_iterations, beta, alpha, history,
        seed + number * iterations, before,
    )
    return state


def ocpd_train_sequential(
    cells: DataFrame, n_slices: int, n_docs: int, factors: dict[str, Factor], length: int = 20,
    slide: int = 10, **options,
) -> list[tuple[int, CPState]]:
    """One dictionary per complete window, each warm-started from the last.
    Options are those of `ocpd_window`."""
    out, state = [], None
    for number, start in enumerate(windows(n_slices, length, slide)):
        state = ocpd_window(cells, start, number, n_docs, factors, state, length, **options)
        out.append((start, state))
    return out


def loading_table(state: CPState, window: int = 0) -> DataFrame:
    """(window_id, mode, idx, u): all factors in one table."""
    table = None
    for axis, factor in state.factors.items():
        rows = factor.table.select(
            F.lit(window).alias("window_id"), F.lit(axis).alias("mode"), F.col(axis).cast("bigint").alias("idx"), "u"
        )
        table = rows if table is None else table.unionByName(rows)
    return table
