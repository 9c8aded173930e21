"""Batch factorisation: matrices (NMF) and tensors (CP), starts and errors."""

from __future__ import annotations

import time
from collections.abc import Sequence
from contextlib import nullcontext
from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, functions as F

from driftloom.learners.algebra import (
    EPSILON, Factor, axis_index, contract, from_array, gram_product, init_factor, kept, multiply_update, vector,
    with_sums,
)
from driftloom.learners.coding import sketch, sketched_codes, sweep_array, swept_codes, swept_codes_coupled, with_sketch
from driftloom.learners.passes import Rows, Rule, Sums, cell_sums, dense
from driftloom.learners.singular import leading_of_axes, leading_vectors
from driftloom.session import release, settle


@dataclass
class Fit:
    """Learned factors by axis and, when asked for, (iter, elapsed, error) rows."""

    factors: dict[str, Factor]
    trace: list[tuple[int, float, float]] = field(default_factory=list)

    def trace_table(self, method: str, trial: int = 0) -> DataFrame:
        spark = next(iter(self.factors.values())).table.sparkSession
        rows = [(method, trial, *row) for row in self.trace]
        return spark.createDataFrame(rows, "method string, trial int, iter int, elapsed double, error double")


def init_factors(
    spark, dims: dict[str, int], rank: int, seed: int = 0, local: bool | None = None
) -> dict[str, Factor]:
    """Hashed uniform factors for axes counted 0 .. size-1."""
    return {axis: init_factor(axis_index(spark, axis, n), axis, n, rank, seed, local) for axis, n in dims.items()}


def _others(factors: dict[str, Factor], axis: str) -> list[Factor]:
    return [f for name, f in factors.items() if name != axis]


def _passes(cells, factors, axes, iterations, rule, with_trace, grouped=None) -> Fit:
    """Sweeps in passes over the cells, or over the rows of the one factor that is not local.

    The rows' own move waits for the next pass, which needs it first. `rule`
    takes (u, b, Gram matrix, step), for rows in a task and for a held factor alike.
    """
    fit, spent = Fit(dict(factors)), 0.0
    by = next((axis for axis, f in factors.items() if not f.local), None)
    held = {axis: dense(f) for axis, f in factors.items() if axis != by}
    grams = {axis: u.T @ u for axis, u in held.items()}
    rows = None if by is None else Rows(cells, factors[by], list(held), grouped)
    if by is not None:
        grams[by] = factors[by].gram()
    waits: Rule | None = None

    def g_of(axis: str) -> np.ndarray:
        return np.prod([grams[a] for a in factors if a != axis], axis=0)

    def run(want: str | None) -> Sums:
        nonlocal waits
        if rows is None:
            return cell_sums(cells, held, want)
        out = rows.run(held, want, waits, None if waits is None else g_of(by))
        grams[by], waits = out.gram, None
        return out

    with kept(cells) if by is None else nullcontext(cells) as cells:
        norm2 = (cells.agg(F.sum(F.col("x") * F.col("x"))).first()[0] or 0.0) if with_trace else 0.0
        for step in range(iterations):
            start = time.perf_counter()
            for axis in axes:
                if axis == by:
                    waits = partial(rule, step=step)
                    continue
                sums = run(axis).axis
                held[axis] = rule(held[axis], sums, g_of(axis), step=step)
                grams[axis] = held[axis].T @ held[axis]
            spent += time.perf_counter() - start
            if with_trace:
                inner = run(None).inner
                model2 = np.prod(list(grams.values()), axis=0).sum()
                fit.trace.append((step, spent, float(np.sqrt(max(norm2 - 2.0 * inner + model2, 0.0)))))
        if waits is not None:
            run(None)
    fit.factors = {
        axis: rows.result() if axis == by else from_array(f, range(f.size), held[axis]) for axis, f in factors.items()
    }
    return fit


def _sweeps(cells, factors, axes, iterations, update, with_trace, rule=None, grouped=None) -> Fit:
    """Passes where a rule for rows is given and at most one factor is not local; else a join and an update an axis."""
    if rule is not None and sum(not f.local for f in factors.values()) <= 1:
        return _passes(cells, factors, axes, iterations, rule, with_trace, grouped)
    factors = dict(factors)
    fit, spent = Fit(factors), 0.0
    # Only the factor just updated needs a new Gram matrix.
    grams = {axis: factor.gram() for axis, factor in factors.items()}
    with kept(cells) as cells:
        for step in range(iterations):
            start = time.perf_counter()
            for axis in axes:
                others = _others(factors, axis)
                sums = contract(cells, others, [axis], factors[axis].rank)
                g = np.prod([grams[f.axis] for f in others], axis=0)
                factors[axis] = update(factors[axis], sums, g, step)
                grams[axis] = factors[axis].gram()
            spent += time.perf_counter() - start
            if with_trace:
                fit.trace.append((step, spent, reconstruction_error(cells, factors)[0]))
    return fit


def cp_mu(
    cells: DataFrame, factors: dict[str, Factor], iterations: int = 100,
    order: Sequence[str] | None = None, with_trace: bool = False, grouped: DataFrame | None = None,
) -> Fit:
    """Nonnegative CP by multiplicative updates, one axis after the other.

    `grouped` are the cells gathered by the one axis that is not local, if at hand.
    """

    def update(factor: Factor, sums: DataFrame, g: np.ndarray, step: int) -> Factor:
        return multiply_update(factor, sums, g)

    def rule(u: np.ndarray, b: np.ndarray, g: np.ndarray, step: int) -> np.ndarray:
        return u * b / (u @ g + EPSILON)

    return _sweeps(cells, factors, order or list(factors), iterations, update, with_trace, rule, grouped)


def cp_als(
    cells: DataFrame, factors: dict[str, Factor], iterations: int = 100, beta: float | None = None,
    radius_const: float = 1000.0, sweeps: int = 10, least_move: float | None = None, with_trace: bool = False,
    subsample_ratio: int | None = None, seed: int = 0, grouped: DataFrame | None = None,
) -> Fit:
    """Alternating least squares by projected gradient sweeps.

    With `beta` a step stays within radius_const * (step+1)^-beta / ln(step+2)
    of the factor it starts from. With `subsample_ratio` every sweep sees one in
    so many rows of the other factors' product, drawn anew by `seed`. `grouped` is
    that of `cp_mu`.
    """
    if subsample_ratio is not None:
        return _sketched_als(
            cells, factors, iterations, beta, radius_const, sweeps, least_move, with_trace, subsample_ratio, seed
        )

    def update(factor: Factor, sums: DataFrame, g: np.ndarray, step: int) -> Factor:
        table = with_sums(factor, sums)
        radius = _radius(beta, radius_const, step)
        if radius is None and least_move is None:
            new = swept_codes(F.col("b"), F.col("u"), g, sweeps)
            return factor.using(settle(table.select(factor.axis, new.alias("u"))))
        table = swept_codes_coupled(table, factor.axis, g, sweeps, radius=radius, least_move=least_move)
        return factor.using(table.select(factor.axis, "u"))

    def rule(u: np.ndarray, b: np.ndarray, g: np.ndarray, step: int) -> np.ndarray:
        return sweep_array(u, b, g, sweeps)

    rowwise = beta is None and least_move is None
    return _sweeps(cells, factors, list(factors), iterations, update, with_trace, rule if rowwise else None, grouped)


def _radius(beta: float | None, radius_const: float, step: int) -> float | None:
    return None if beta is None else radius_const * (step + 1.0) ** -beta / np.log(step + 2.0)


def _sketched_als(cells, factors, iterations, beta, radius_const, sweeps, least_move, with_trace, ratio, seed) -> Fit:
    factors = dict(factors)
    fit, spent = Fit(factors), 0.0
    with kept(cells) as cells:
        for step in range(iterations):
            start = time.perf_counter()
            for place, axis in enumerate(list(factors)):
                factor, others = factors[axis], _others(factors, axis)
                sums, gs = sketch(cells, others, axis, ratio, sweeps, seed + step * len(factors) + place)
                table = with_sketch(factor.table.select(axis, "u"), sums, axis, sweeps, factor.rank)
                radius = _radius(beta, radius_const, step)
                if radius is None and least_move is None:
                    table = table.select(axis, sketched_codes(F.col("bs"), F.col("u"), gs).alias("u"))
                else:
                    table = swept_codes_coupled(table, axis, gs, sweeps, radius=radius, least_move=least_move).select(axis, "u")
                factors[axis] = factor.using(settle(table))
            spent += time.perf_counter() - start
            if with_trace:
                fit.trace.append((step, spent, reconstruction_error(cells, factors)[0]))
    return fit


def nmf_batch(
    cells: DataFrame, terms: Factor, documents: Factor, iterations: int = 200, with_trace: bool = False
) -> Fit:
    """Matrix factorisation by multiplicative updates, codes before dictionary.

    The document codes stay a table, one row per document.
    """
    factors = {documents.axis: documents, terms.axis: terms}
    return cp_mu(cells, factors, iterations, with_trace=with_trace)


def reconstruction_error(cells: DataFrame, factors: dict[str, Factor]) -> tuple[float, float]:
    """(error, relative error) in the Frobenius norm, from the nonzero cells.

    |X - M|^2 = |X|^2 - 2 <X, M> + |M|^2, the last from the Gram matrices.
    """
    parts = list(factors.values())
    rank = parts[0].rank
    inner = contract(cells, parts, [], rank)
    products = inner.first()["b"]
    norm2 = cells.agg(F.sum(F.col("x") * F.col("x"))).first()[0] or 0.0
    model2 = gram_product(parts).sum()
    error = float(np.sqrt(max(norm2 - 2.0 * sum(p or 0.0 for p in products) + model2, 0.0)))
    return error, error / float(np.sqrt(norm2)) if norm2 else 0.0


def nndsvd_init(
    cells: DataFrame, terms: Factor, documents: Factor, iterations: int = 10
) -> tuple[Factor, Factor]:
    """Nonnegative start from the singular vectors: of each pair of vectors the
    stronger sign part is kept. Returns (terms, documents). `iterations` is that of `leading_vectors`."""
    rank = terms.rank
    left, right, values = leading_vectors(cells, terms, [documents.axis], iterations)
    u = F.col("u")

    def part_norms(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        def square(k: int, sign: int):
            part = F.greatest(sign * u[k], F.lit(0.0))
            return F.sqrt(F.sum(part * part))

        row = table.agg(*[square(k, s) for s in (1, -1) for k in range(rank)]).first()
        return np.array(row[:rank], float), np.array(row[rank:], float)

    (lp, ln), (rp, rn) = part_norms(left), part_norms(right)

    def factor(like: Factor, table: DataFrame, positive: np.ndarray, negative: np.ndarray) -> Factor:
        def component(k: int):
            plus, minus = lp[k] * rp[k], ln[k] * rn[k]
            if k == 0:
                return float(np.sqrt(values[0])) * F.abs(u[0])
            sign, norm, mass = (1, positive[k], plus) if plus >= minus else (-1, negative[k], minus)
            scale = np.sqrt(values[k] * mass) / norm if norm > 0 else 0.0
            return float(scale) * F.greatest(sign * u[k], F.lit(0.0))

        start = table.select(like.axis, vector(rank, component).alias("u"))
        zeros = F.array(*[F.lit(0.0)] * rank)
        every = like.table.select(like.axis).join(start, like.axis, "left")
        return like.using(settle(every.select(like.axis, F.coalesce("u", zeros).alias("u"))))

    return factor(terms, left, lp, ln), factor(documents, right, rp, rn)


def cp_svd_init(cells: DataFrame, factors: dict[str, Factor], iterations: int = 10) -> dict[str, Factor]:
    """Nonnegative start: absolute leading vectors of every unfolding. `iterations` is that of `leading_vectors`."""
    out = {}
    for axis, left in leading_of_axes(cells, factors, iterations).items():
        factor = factors[axis]
        positive = vector(factor.rank, lambda k: F.abs(F.col("u")[k]))
        zeros = F.array(*[F.lit(0.0)] * factor.rank)
        every = factor.table.select(axis).join(left.select(axis, positive.alias("u")), axis, "left")
        out[axis] = factor.using(settle(every.select(axis, F.coalesce("u", zeros).alias("u"))))
        release(left)
    return out
