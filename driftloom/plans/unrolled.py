"""Oracle SQL of the learners at rank 2: every step written out as table
expressions. A factor is a table (idx, u0, u1); sums are (idx, b0, b1)."""

from __future__ import annotations

from driftloom.plans.oracle import hashed, uniform

RANK = 2
K = range(RANK)


def start(name: str, axis: str, index: str, seed: int, prefix: str | None = None) -> str:
    """Hashed start over the ids of `index`, a query with one column idx."""
    us = ", ".join(f"{uniform(repr(prefix or axis), 'idx', k, seed)} AS u{k}" for k in K)
    return f"{name} AS MATERIALIZED (SELECT idx, {us} FROM ({index}))"


def sums(name: str, cells: str, by: str, others: dict[str, str], value=lambda k: "c.x") -> str:
    """(idx, b0, b1) per `by`; `others` maps a column of `cells` to its factor."""
    joins = " ".join(f"JOIN {f} ON {f}.idx = c.{column}" for column, f in others.items())
    bs = ", ".join(
        f"sum({' * '.join([value(k), *[f'{f}.u{k}' for f in others.values()]])}) AS b{k}" for k in K
    )
    return f"{name} AS MATERIALIZED (SELECT c.{by} AS idx, {bs} FROM {cells} c {joins} GROUP BY 1)"


def gram(name: str, factors: list[str], times: str | None = None) -> str:
    """g00, g01, g10, g11: product of the factors' Gram matrices (and of `times`)."""
    def entry(i, j):
        parts = [f"(SELECT coalesce(sum(u{i} * u{j}), 0) FROM {f})" for f in factors]
        if times:
            parts.append(f"(SELECT g{i}{j} FROM {times})")
        return " * ".join(parts) + f" AS g{i}{j}"

    return f"{name} AS MATERIALIZED (SELECT {', '.join(entry(i, j) for i in K for j in K)})"


def multiply(name: str, factor: str, b: str, g: str) -> str:
    us = ", ".join(
        f"u{k} * coalesce(b{k}, 0) / (u0 * g0{k} + u1 * g1{k} + 1e-12) AS u{k}" for k in K
    )
    return f"{name} AS MATERIALIZED (SELECT idx, {us} FROM {factor} LEFT JOIN {b} USING (idx), {g})"


def least_squares(name: str, b: str, g: str, alpha: float = 0.0) -> str:
    """The four active sets of a two-column nonnegative problem."""
    return f"""{name} AS MATERIALIZED (SELECT idx,
      CASE WHEN h0 >= 0 AND h1 >= 0 THEN h0 WHEN p0 * p0 / g00 >= p1 * p1 / g11 THEN p0 / g00 ELSE 0 END AS u0,
      CASE WHEN h0 >= 0 AND h1 >= 0 THEN h1 WHEN p0 * p0 / g00 >= p1 * p1 / g11 THEN 0 ELSE p1 / g11 END AS u1
      FROM (SELECT *, (a0 * g11 - a1 * g01) / (g00 * g11 - g01 * g01) AS h0,
          (a1 * g00 - a0 * g01) / (g00 * g11 - g01 * g01) AS h1, greatest(a0, 0) AS p0, greatest(a1, 0) AS p1
        FROM (SELECT idx, b0 - {alpha} AS a0, b1 - {alpha} AS a1 FROM {b}), {g}))"""


def swept(name: str, begin: str, b: str, g: str, sweeps: int, alpha: float = 0.0) -> list[str]:
    """Projected gradient sweeps from the codes `begin`."""
    out = [f"{name}_s0 AS (SELECT idx, u0, u1, coalesce(b0, 0) AS b0, coalesce(b1, 0) AS b1 FROM {begin} LEFT JOIN {b} USING (idx))"]
    last = f"{name}_s0"
    for i in range(sweeps):
        for k in K:
            other = 1 - k
            move = f"greatest(u{k} - (u0 * g0{k} + u1 * g1{k} - b{k} + {alpha}) / ({i + 1} * (g{k}{k} + 1)), 0)"
            new = f"{name}_s{i}_{k}"
            out.append(f"{new} AS MATERIALIZED (SELECT idx, {move} AS u{k}, u{other}, b0, b1 FROM {last}, {g})")
            last = new
    out.append(f"{name} AS MATERIALIZED (SELECT idx, u0, u1 FROM {last})")
    return out


def sketched(
    name: str, begin: str, cells: str, by: str, factors: dict[str, str], sizes: dict[str, str], ratio: int, sweeps: int, seed: int
) -> list[str]:
    """Sweeps from the codes `begin`, each on drawn rows of the factors' product; `sizes` are the axes' sizes as SQL."""
    n = f"greatest(1, ({' * '.join(f'({s})::BIGINT' for s in sizes.values())}) // {ratio})"
    picks = ", ".join(f"({hashed(repr(a), 'i', 'j', seed)} % ({s}))::INT AS {a}" for a, s in sizes.items())
    axes = ", ".join(factors)
    joins = " ".join(f"JOIN {f} ON {f}.idx = c.{a}" for a, f in factors.items())
    product = [" * ".join(f"{f}.u{k}" for f in factors.values()) for k in K]
    out = [
        f"""{name}_m AS MATERIALIZED (SELECT i, {axes}, count(*) AS m FROM
            (SELECT i, {picks} FROM range({sweeps}) a(i), (SELECT unnest(range({n})) AS j) b) GROUP BY ALL)""",
        f"{name}_p AS MATERIALIZED (SELECT c.i, m, {', '.join(f'{p} AS p{k}' for k, p in zip(K, product))} FROM {name}_m c {joins})",
        f"""{name}_b AS MATERIALIZED (SELECT c.{by} AS idx, i, {', '.join(f'sum(x * m * {p}) AS b{k}' for k, p in zip(K, product))}
            FROM {cells} c JOIN {name}_m USING ({axes}) {joins} GROUP BY ALL)""",
    ]
    last = begin
    for i in range(sweeps):
        entries = ", ".join(f"coalesce(sum(m * p{a} * p{b}), 0) AS g{a}{b}" for a in K for b in K)
        out.append(f"{name}_g{i} AS MATERIALIZED (SELECT {entries} FROM {name}_p WHERE i = {i})")
        out.append(f"""{name}_s{i} AS MATERIALIZED (SELECT idx, u0, u1, coalesce(b0, 0) AS b0, coalesce(b1, 0) AS b1
            FROM {last} LEFT JOIN (SELECT * EXCLUDE (i) FROM {name}_b WHERE i = {i}) USING (idx))""")
        last = f"{name}_s{i}"
        for k in K:
            move = f"greatest(u{k} - (u0 * g0{k} + u1 * g1{k} - b{k}) / ({i + 1} * (g{k}{k} + 1)), 0)"
            out.append(f"{name}_s{i}_{k} AS MATERIALIZED (SELECT idx, {move} AS u{k}, u{1 - k}, b0, b1 FROM {last}, {name}_g{i})")
            last = f"{name}_s{i}_{k}"
        out.append(f"{name}_h{i} AS (SELECT idx, u0, u1 FROM {last})")
        last = f"{name}_h{i}"
    out.append(f"{name} AS (SELECT idx, u0, u1 FROM {last})")
    return out


def columns(name: str, factor: str, b: str, a: str, radius: float | None = None) -> list[str]:
    """Column after column: step, clip, length at most 1."""
    out = [f"{name}_c AS (SELECT idx, u0, u1, coalesce(b0, 0) AS b0, coalesce(b1, 0) AS b1 FROM {factor} LEFT JOIN {b} USING (idx))"]
    last = f"{name}_c"
    for k in K:
        other = 1 - k
        step = f"(1 / (g{k}{k} + 1))"
        slopes = f"{name}_g{k} AS MATERIALIZED (SELECT *, u0 * g0{k} + u1 * g1{k} - b{k} AS slope FROM {last}, {a})"
        if radius is not None:
            length = f"(SELECT sqrt(sum(slope * slope)) FROM {name}_g{k})"
            step = f"({step} * {radius!r} / greatest({radius!r}, {step} * {length}))"
        moved = f"{name}_p{k} AS MATERIALIZED (SELECT *, greatest(u{k} - {step} * slope, 0) AS p FROM {name}_g{k})"
        norm = f"(SELECT greatest(1, sqrt(sum(p * p))) FROM {name}_p{k})"
        last = f"{name}_n{k}"
        out += [slopes, moved, f"{last} AS MATERIALIZED (SELECT idx, p / {norm} AS u{k}, u{other}, b0, b1 FROM {name}_p{k})"]
    out.append(f"{name} AS MATERIALIZED (SELECT idx, u0, u1 FROM {last})")
    return out


def blend(name: str, old: str | None, new: str, weight: float) -> str:
    """Weighted mean of two matrices g."""
    def entry(i, j):
        first = f"{1 - weight!r} * (SELECT g{i}{j} FROM {old}) + " if old else ""
        return f"{first}{weight!r} * (SELECT g{i}{j} FROM {new}) AS g{i}{j}"

    return f"{name} AS MATERIALIZED (SELECT {', '.join(entry(i, j) for i in K for j in K)})"


def fold_in(name: str, old: str | None, new: str, keys: str, weight: float) -> str:
    """Weighted mean of two tables (keys, b0, b1), absent rows counting 0."""
    parts = [f"SELECT {keys}, {weight!r} * b0 AS b0, {weight!r} * b1 AS b1 FROM {new}"]
    if old:
        parts.append(f"SELECT {keys}, {1 - weight!r} * b0, {1 - weight!r} * b1 FROM {old}")
    union = " UNION ALL ".join(parts)
    return f"{name} AS MATERIALIZED (SELECT {keys}, sum(b0) AS b0, sum(b1) AS b1 FROM ({union}) GROUP BY ALL)"


def long(factor: str, idx: str = "idx", value: str = "w", digits: int = 6, **constants: str) -> str:
    """SELECT of (…constants, idx, topic, value)."""
    extra = "".join(f"{v} AS {k}, " for k, v in constants.items())
    return " UNION ALL ".join(
        f"SELECT {extra}idx AS {idx}, {k} AS topic, round(u{k}, {digits}) AS {value} FROM {factor}" for k in K
    )


def zero_gram(name: str) -> str:
    return f"{name} AS (SELECT {', '.join(f'0.0::DOUBLE AS g{i}{j}' for i in K for j in K)})"


def matrix_step(tag: str, batch: str, terms: str, a: str, b: str | None, t: int, beta: float, alpha: float,
                by: str = "draw", axis: str = "term_id") -> list[str]:
    """One online matrix step; leaves tables {tag}_w, {tag}_a, {tag}_b, {tag}_h."""
    weight = float(t) ** -beta
    empty = f"{tag}_none AS (SELECT idx, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM {terms})"
    return [
        sums(f"{tag}_s", batch, by, {axis: terms}), gram(f"{tag}_g", [terms]),
        least_squares(f"{tag}_h", f"{tag}_s", f"{tag}_g", alpha), gram(f"{tag}_hh", [f"{tag}_h"]),
        blend(f"{tag}_a", a, f"{tag}_hh", weight),
        sums(f"{tag}_hx", batch, axis, {by: f"{tag}_h"}),
        fold_in(f"{tag}_b", b, f"{tag}_hx", "idx", weight), empty,
        *columns(f"{tag}_w", terms, b or f"{tag}_none", a),
    ]


def cp_step(tag: str, batch: str, rows: str, factors: dict[str, str], a: str | None, b: str | None, t: int,
            beta: float, radius: float, sweeps: int, seed: int, by: str = "draw") -> tuple[list[str], dict[str, str]]:
    """One online CP step on `batch(by, axes, x)`: (tables, names of the new factors)."""
    weight = float(t) ** -beta
    axes = ", ".join(factors)
    out = [
        start(f"{tag}_h0", "code", rows, seed + t), sums(f"{tag}_s", batch, by, factors),
        gram(f"{tag}_g", list(factors.values())),
        *swept(f"{tag}_h", f"{tag}_h0", f"{tag}_s", f"{tag}_g", sweeps), gram(f"{tag}_hh", [f"{tag}_h"]),
        blend(f"{tag}_a", a, f"{tag}_hh", weight),
        f"""{tag}_hx AS (SELECT {axes}, sum(x * u0) AS b0, sum(x * u1) AS b1 FROM {batch} c
            JOIN {tag}_h ON {tag}_h.idx = c.{by} GROUP BY {axes})""",
        fold_in(f"{tag}_b", b, f"{tag}_hx", axes, weight),
    ]
    current = dict(factors)
    for axis in factors:
        others = {c: f for c, f in current.items() if c != axis}
        out += [
            sums(f"{tag}_b_{axis}", f"{tag}_b", axis, others, value=lambda k: f"c.b{k}"),
            gram(f"{tag}_a_{axis}", list(others.values()), times=f"{tag}_a"),
            *columns(f"{tag}_u_{axis}", current[axis], f"{tag}_b_{axis}", f"{tag}_a_{axis}", radius),
        ]
        current[axis] = f"{tag}_u_{axis}"
    return out, current
