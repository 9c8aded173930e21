"""Trials of learners side by side: a bounded pool of Spark jobs over shared cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from driftloom.learners.algebra import MODEL_CELLS
from driftloom.learners.factorise import Fit, cp_als, cp_mu, init_factors
from driftloom.learners.online import ocpd_train
from driftloom.learners.passes import gather
from driftloom.operators.pool import run_all
from driftloom.session import is_stored, release, stored

TRACE = "method string, run int, trial int, iter int, elapsed double, error double"


def fit(
    cells: DataFrame, dims: dict[str, int], method: str, rank: int = 2, iterations: int = 2, seed: int = 0,
    beta: float | None = None, alpha: float = 0.0, sweeps: int = 10, subsample_ratio: int | None = None,
    batch_axis: str | None = None, batch_size: int | None = None, grouped: DataFrame | None = None,
) -> list[tuple[int, float, float]]:
    """(iter, elapsed, error) of one run of "mu", "als" or "online" from a start by `seed`.

    "online" learns the axes other than `batch_axis` (the last one unless given),
    with the regulariser `alpha`. `grouped` is that of `cp_mu`.
    """
    factors = init_factors(cells.sparkSession, dims, rank, seed)
    if method == "mu":
        return cp_mu(cells, factors, iterations, with_trace=True, grouped=grouped).trace
    if method == "als":
        out: Fit = cp_als(
            cells, factors, iterations, beta, sweeps=sweeps, with_trace=True, subsample_ratio=subsample_ratio, seed=seed,
            grouped=grouped,
        )
        return out.trace
    if method != "online":
        raise ValueError(f"no method {method!r}")
    axis = batch_axis or list(dims)[-1]
    held = {a: f for a, f in factors.items() if a != axis}
    state = ocpd_train(
        cells, held, axis, dims[axis], iterations + 1, batch_size, beta, alpha, seed, sweeps=sweeps, with_trace=True,
        subsample_ratio=subsample_ratio,
    )
    return [(i - 1, elapsed, error) for i, elapsed, error in state.trace]


def _long_axis(dims: dict[str, int], run: dict) -> str | None:
    """The axis by which a run gathers its cells: that of the one factor too long to be held."""
    rowwise = run["method"] in ("mu", "als") and run.get("beta") is None and run.get("subsample_ratio") is None
    found = [axis for axis, n in dims.items() if n * run.get("rank", 2) > MODEL_CELLS]
    return found[0] if rowwise and len(found) == 1 else None


def learner_trials(
    cells: DataFrame, dims: dict[str, int], runs: Sequence[dict], trials: int = 1, seed: int = 0, workers: int = 4
) -> DataFrame:
    """(method, run, trial, iter, elapsed, error): error traces of every run, `trials` times each.

    `runs` are options of `fit`, numbered in their order; trial k starts from
    `seed` + k. The cells are written once and read by all, and so are the cells
    gathered by the axis of a long factor. But for the times the rows do not depend
    on `workers` or on which trial ends first. One row a step: the traces are a
    bounded table of the driver's.
    """
    places = [(run, trial) for run in range(len(runs)) for trial in range(trials)]
    spark = cells.sparkSession
    shared = cells if is_stored(cells) else stored(cells, "cells")
    by = [_long_axis(dims, run) for run in runs]
    grouped: dict[str | None, DataFrame | None] = {
        axis: stored(gather(shared, [axis], [a for a in dims if a != axis]), "grouped") for axis in set(by) - {None}
    }
    jobs = [lambda r=r, k=k: fit(shared, dims, seed=seed + k, grouped=grouped.get(by[r]), **runs[r]) for r, k in places]
    traces = run_all(spark, jobs, workers)
    release(*grouped.values(), None if shared is cells else shared)
    rows = [
        (runs[r]["method"], r, k, int(i), float(elapsed), float(error))
        for (r, k), trace in zip(places, traces) for i, elapsed, error in trace
    ]
    return spark.createDataFrame(rows, TRACE)
