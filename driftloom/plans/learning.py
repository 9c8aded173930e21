"""Queries over the topic learners. Those that SQL can follow run at rank 2."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from driftloom.learners import coding, factorise, lda, online, trials
from driftloom.learners.algebra import MODEL_CELLS, Factor, gram, init_factor, kept, update_columns
from driftloom.operators import series, tensor, topics
from driftloom.operators.joins import join_term_lookup
from driftloom.operators.numbering import number_rows
from driftloom.operators.vocabulary import bag_of_words, counts_in_documents, document_terms, log2_tfidf
from driftloom.plans import unrolled as sql
from driftloom.plans.corpus import Corpus, cells, corpus, dims, english, slices, written_cells
from driftloom.plans.oracle import with_corpus
from driftloom.plans.registry import query
from driftloom.plans.sources_and_text import SEED, draws_sql
from driftloom.plans.tables_and_topics import CONDENSED, NUMBERED, _recursive, top_sql
from driftloom.session import release, scratch_path, settle, stored
from driftloom.sources import store

RANK = 2
VOCAB_IDS, DOC_IDS = "SELECT term_id AS idx FROM vocab", "SELECT doc_id AS idx FROM docs"
SLICE_IDS, PLACE_IDS = "SELECT DISTINCT t AS idx FROM slices", "SELECT DISTINCT d::INT AS idx FROM slices"
ENTRIES = "entries AS MATERIALIZED (SELECT doc_id, term_id, x FROM tfidf)"
TENSOR = "tensor AS MATERIALIZED (SELECT * FROM cells)"

W0 = sql.start("w0", "term_id", VOCAB_IDS, SEED)
H0 = sql.start("h0", "doc_id", DOC_IDS, SEED)
UT, UV, UD = (sql.start(f"u_{a}", a, ids, SEED) for a, ids in (("t", SLICE_IDS), ("v", VOCAB_IDS), ("d", PLACE_IDS)))


def _long(factor: DataFrame, axis: str, name: str | None = None, value: str = "w", column: str = "u") -> DataFrame:
    rows = factor.select(F.col(axis).alias(name or axis), F.posexplode(column).alias("topic", value))
    return rows.withColumn(value, F.round(value, 6))


def _start(spark, folder, rank: int = RANK, data: Corpus | None = None):
    """(corpus, cells(doc_id, term_id, x), terms, documents)."""
    data = data or corpus(spark, folder)
    entries = data.entries
    terms = init_factor(data.vocabulary.select("term_id"), "term_id", data.n_terms, rank, SEED)
    documents = init_factor(data.docs.select("doc_id"), "doc_id", data.n_docs, rank, SEED, local=False)
    return data, entries, terms, documents


def _tensor(spark, folder, rank: int = RANK, data: Corpus | None = None):
    """(corpus, cells(t, v, d, x), factors)."""
    data = data or corpus(spark, folder)
    return data, written_cells(data), factorise.init_factors(spark, dims(data), rank, SEED)


def _two_part(parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    out = None
    for name, (table, axis) in parts.items():
        rows = table.select(
            F.lit(name).alias("part"), F.col(axis).cast("bigint").alias("id"), F.posexplode("u").alias("topic", "w")
        ).withColumn("w", F.round("w", 6))
        out = rows if out is None else out.unionByName(rows)
    return out


def _part_sql(**factors: str) -> str:
    return " UNION ALL ".join(sql.long(f, "id", part=f"'{part}'") for part, f in factors.items()).replace(
        "idx AS id", "idx::BIGINT AS id"
    )


# ---- starts, codes ----------------------------------------------------------


@query("init_factors", with_corpus(_part_sql(terms="w0", documents="h0"), W0, H0, upto="vocab"))
def init_factors(spark, folder):
    _, _, terms, documents = _start(spark, folder)
    return _two_part({"terms": (terms.table, "term_id"), "documents": (documents.table, "doc_id")})


def _coding_sql(alpha: float) -> str:
    return with_corpus(
        sql.long("h", "doc_id", "h"), ENTRIES, W0, sql.sums("b", "entries", "doc_id", {"term_id": "w0"}),
        sql.gram("g", ["w0"]), sql.least_squares("h", "b", "g", alpha), upto="tfidf",
    )


@query("nmf_transform", _coding_sql(0.0))
def nmf_transform(spark, folder):
    _, entries, terms, _ = _start(spark, folder)
    return _long(coding.nmf_transform(entries, terms), "doc_id", value="h", column="h")


@query("sparse_code_transform", _coding_sql(1.0))
def sparse_code_transform(spark, folder):
    _, entries, terms, _ = _start(spark, folder)
    return _long(coding.sparse_code_transform(entries, terms), "doc_id", value="h", column="h")


# ---- batch NMF and CP -------------------------------------------------------


def _nmf_steps() -> tuple[list[str], str, str]:
    """(tables of two iterations, name of the last W, of the last H)."""
    steps, w, h = [], "w0", "h0"
    for i in (1, 2):
        steps += [
            sql.sums(f"bh{i}", "entries", "doc_id", {"term_id": w}), sql.gram(f"gw{i}", [w]),
            sql.multiply(f"h{i}", h, f"bh{i}", f"gw{i}"),
            sql.sums(f"bw{i}", "entries", "term_id", {"doc_id": f"h{i}"}), sql.gram(f"gh{i}", [f"h{i}"]),
            sql.multiply(f"w{i}", w, f"bw{i}", f"gh{i}"),
        ]
        w, h = f"w{i}", f"h{i}"
    return steps, w, h


def _nmf_sql() -> str:
    steps, w, h = _nmf_steps()
    return with_corpus(_part_sql(terms=w, documents=h), ENTRIES, W0, H0, *steps, upto="tfidf")


def fit_nmf(
    spark, folder, rank: int = RANK, iterations: int = 2, with_trace: bool = False, data: Corpus | None = None
):
    data, entries, terms, documents = _start(spark, folder, rank, data)
    return data, factorise.nmf_batch(entries, terms, documents, iterations, with_trace)


@query("nmf_batch", _nmf_sql())
def nmf_batch(spark, folder):
    _, fit = fit_nmf(spark, folder)
    return _two_part({a: (fit.factors[c].table, c) for a, c in (("terms", "term_id"), ("documents", "doc_id"))})


# From a fitted model to its report. Weights are rounded before they are ranked.
def _report_sql(query: str, *more: str) -> str:
    steps, w, h = _nmf_steps()
    named = f"""profile AS (SELECT topic, term, round(w, 6) AS w FROM ({sql.long(w, "term_id", digits=15)}) JOIN vocab USING (term_id))"""
    codes = f"codes AS (SELECT doc_id, topic, h FROM ({sql.long(h, 'doc_id', 'h', digits=15)}))"
    return with_corpus(query, ENTRIES, W0, H0, *steps, named, codes, *more, upto="slices")


def _named_weights(data: Corpus, fit) -> DataFrame:
    weights = topics.weights_long(fit.factors["term_id"].table, "term_id").withColumn("w", F.round("w", 6))
    return join_term_lookup(weights, data.vocabulary).select("topic", "term", "w")


@query("nmf_report_labels", _recursive(_report_sql("""SELECT topic, string_agg(term, ', ' ORDER BY r) || ': ' || topic AS label FROM
    (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY w DESC, term) AS r FROM condensed)
    WHERE r <= 3 GROUP BY topic""", top_sql(20), CONDENSED)))
def nmf_report_labels(spark, folder):
    """Fitted topics -> keywords -> bigrams that take over their words -> labels."""
    data, fit = fit_nmf(spark, folder)
    return topics.topic_labels(topics.condense_keywords(_named_weights(data, fit)))


@query("nmf_report_prevalence", _report_sql("""SELECT t AS slice, topic, round(m / sum(m) OVER (PARTITION BY t), 6) AS prevalence FROM
    (SELECT t, topic, sum(h) / any_value(n) AS m FROM codes JOIN slices USING (doc_id)
      JOIN (SELECT t, count(*) AS n FROM slices GROUP BY t) USING (t) GROUP BY t, topic)"""))
def nmf_report_prevalence(spark, folder):
    """Share of each fitted topic in each slice."""
    data, fit = fit_nmf(spark, folder)
    places = slices(data).select("doc_id", F.col("t").alias("slice"))
    codes = topics.weights_long(fit.factors["doc_id"].table, "doc_id", "h").join(places, "doc_id")
    per_slice = places.groupBy("slice").agg(F.count("*").alias("n_docs"))
    return topics.topic_prevalence(codes, per_slice).select("slice", "topic", F.round("prevalence", 6).alias("prevalence"))


FACTORS = {"t": "u_t", "v": "u_v", "d": "u_d"}


def _mode_table(factors: dict[str, Factor]) -> DataFrame:
    return _two_part({axis: (f.table, axis) for axis, f in factors.items()})


def _others(factors: dict[str, str], axis: str) -> dict[str, str]:
    return {a: f for a, f in factors.items() if a != axis}


def _mu_tables(sweeps: int) -> tuple[list[str], list[dict[str, str]]]:
    current, steps, history = dict(FACTORS), [], []
    for i in range(sweeps):
        for axis in FACTORS:
            others = _others(current, axis)
            tag = f"{axis}{i}"
            steps += [
                sql.sums(f"b_{tag}", "tensor", axis, others), sql.gram(f"g_{tag}", list(others.values())),
                sql.multiply(f"f_{tag}", current[axis], f"b_{tag}", f"g_{tag}"),
            ]
            current[axis] = f"f_{tag}"
        history.append(dict(current))
    return steps, history


def _error_tables(tag: str, factors: dict[str, str]) -> list[str]:
    (t, v, d) = (factors[a] for a in "tvd")
    inner = " + ".join(f"{t}.u{k} * {v}.u{k} * {d}.u{k}" for k in sql.K)
    return [
        sql.gram(f"{tag}_g", [t, v, d]),
        f"""{tag} AS (SELECT sqrt((SELECT sum(x * x) FROM tensor) - 2 * (SELECT sum(x * ({inner})) FROM tensor c
            JOIN {t} ON {t}.idx = c.t JOIN {v} ON {v}.idx = c.v JOIN {d} ON {d}.idx = c.d)
            + (SELECT g00 + g01 + g10 + g11 FROM {tag}_g)) AS error, sqrt((SELECT sum(x * x) FROM tensor)) AS norm)""",
    ]


MU_STEPS, MU_HISTORY = _mu_tables(2)


@query("cp_mu", with_corpus(_part_sql(**MU_HISTORY[-1]), TENSOR, UT, UV, UD, *MU_STEPS))
def cp_mu(spark, folder):
    _, tensor_cells, factors = _tensor(spark, folder)
    return _mode_table(factorise.cp_mu(tensor_cells, factors, 2).factors)


def _als_sql() -> str:
    current, steps = dict(FACTORS), []
    for axis in FACTORS:
        others = _others(current, axis)
        steps += [
            sql.sums(f"b_{axis}", "tensor", axis, others), sql.gram(f"g_{axis}", list(others.values())),
            *sql.swept(f"f_{axis}", current[axis], f"b_{axis}", f"g_{axis}", 4),
        ]
        current[axis] = f"f_{axis}"
    return with_corpus(_part_sql(**current), TENSOR, UT, UV, UD, *steps)


@query("cp_als", _als_sql())
def cp_als(spark, folder):
    _, tensor_cells, factors = _tensor(spark, folder)
    return _mode_table(factorise.cp_als(tensor_cells, factors, 1, sweeps=4).factors)


@query("reconstruct_at_nonzeros", with_corpus(
    "SELECT t, v, d, round(xhat, 6) AS xhat FROM (SELECT c.t, c.v, c.d, "
    + " + ".join(f"u_t.u{k} * u_v.u{k} * u_d.u{k}" for k in sql.K)
    + " AS xhat FROM tensor c JOIN u_t ON u_t.idx = c.t JOIN u_v ON u_v.idx = c.v JOIN u_d ON u_d.idx = c.d)",
    TENSOR, UT, UV, UD))
def reconstruct_at_nonzeros(spark, folder):
    _, tensor_cells, factors = _tensor(spark, folder)
    model = tensor.reconstruct_at_nonzeros(tensor_cells, {a: f.table for a, f in factors.items()}, RANK)
    return model.select("t", "v", "d", F.round("xhat", 6).alias("xhat"))


@query("reconstruction_error", with_corpus(
    "SELECT round(error, 6) AS error, round(error / norm, 6) AS relative_error FROM e",
    TENSOR, UT, UV, UD, *_error_tables("e", FACTORS)))
def reconstruction_error(spark, folder):
    _, tensor_cells, factors = _tensor(spark, folder)
    with kept(tensor_cells) as tensor_cells:
        error, relative = factorise.reconstruction_error(tensor_cells, factors)
    return spark.createDataFrame([(round(error, 6), round(relative, 6))], "error double, relative_error double")


@query("error_trace", with_corpus(
    " UNION ALL ".join(
        f"SELECT 'cp_mu' AS method, 0 AS trial, {i} AS iter, round(error, 6) AS error FROM e{i}" for i in range(2)),
    TENSOR, UT, UV, UD, *MU_STEPS, *_error_tables("e0", MU_HISTORY[0]), *_error_tables("e1", MU_HISTORY[1])))
def error_trace(spark, folder):
    """The elapsed column is left out: it differs from run to run."""
    _, tensor_cells, factors = _tensor(spark, folder)
    fit = factorise.cp_mu(tensor_cells, factors, 2, with_trace=True)
    return fit.trace_table("cp_mu").select("method", "trial", "iter", F.round("error", 6).alias("error"))


RUNS = [dict(method="mu"), dict(method="als", sweeps=2)]
TRIALS = 2


def _trials_sql() -> str:
    """Two steps of both methods from two starts: tables run(method, run, trial, iter, error)."""
    steps, rows = [TENSOR], []
    for trial in range(TRIALS):
        start = {a: f"u{trial}_{a}" for a in FACTORS}
        ids = {"t": SLICE_IDS, "v": VOCAB_IDS, "d": PLACE_IDS}
        steps += [sql.start(start[a], a, ids[a], SEED + trial) for a in FACTORS]
        for run, method in enumerate(("mu", "als")):
            current = dict(start)
            for i in range(2):
                for axis in FACTORS:
                    tag = f"{method}{trial}{i}{axis}"
                    others = _others(current, axis)
                    steps += [sql.sums(f"b_{tag}", "tensor", axis, others), sql.gram(f"g_{tag}", list(others.values()))]
                    if method == "mu":
                        steps.append(sql.multiply(f"f_{tag}", current[axis], f"b_{tag}", f"g_{tag}"))
                    else:
                        steps += sql.swept(f"f_{tag}", current[axis], f"b_{tag}", f"g_{tag}", 2)
                    current[axis] = f"f_{tag}"
                steps += _error_tables(f"e_{method}{trial}{i}", current)
                rows.append(f"SELECT '{method}' AS method, {run} AS run, {trial} AS trial, {i} AS iter, error FROM e_{method}{trial}{i}")
    return steps, " UNION ALL ".join(rows)


TRIAL_STEPS, TRIAL_ROWS = _trials_sql()


def _trials(spark, folder):
    data = corpus(spark, folder)
    size, tensor_cells = dims(data), written_cells(data)
    out = trials.learner_trials(tensor_cells, size, RUNS, TRIALS, SEED)
    release(tensor_cells)
    return out


@query("learner_trials", with_corpus(
    f"SELECT method, run, trial, iter, round(error, 6) AS error FROM ({TRIAL_ROWS})", *TRIAL_STEPS))
def learner_trials(spark, folder):
    """Error traces of two methods from two starts, learned side by side; the times are left out."""
    return _trials(spark, folder).select("method", "run", "trial", "iter", F.round("error", 6).alias("error"))


@query("learner_trials_band", with_corpus(
    """SELECT method, g::INT AS grid, round(avg(y), 6) AS mean_error, round(stddev_pop(y), 6) AS std_error FROM
    (SELECT method, trial, g, min_by(error, iter) + (g / 4.0::DOUBLE) * (max_by(error, iter) - min_by(error, iter)) AS y
      FROM traces, range(4) r(g) GROUP BY method, trial, g) GROUP BY method, g""",
    *TRIAL_STEPS, f"traces AS ({TRIAL_ROWS})"))
def learner_trials_band(spark, folder):
    """Mean error and its deviation over the trials of each method, at five even points of two steps."""
    traces = _trials(spark, folder).withColumn("elapsed", F.col("iter").cast("double"))
    band = series.error_band(series.resample_trace(traces, 5))
    return band.select("method", "grid", F.round("mean_error", 6).alias("mean_error"), F.round("std_error", 6).alias("std_error"))


@query("nndsvd_init")
def nndsvd_init(spark, folder):
    _, entries, terms, documents = _start(spark, folder, 3)
    w, h = factorise.nndsvd_init(entries, terms, documents)
    return _two_part({"terms": (w.table, "term_id"), "documents": (h.table, "doc_id")})


@query("cp_svd_init")
def cp_svd_init(spark, folder):
    _, tensor_cells, factors = _tensor(spark, folder)
    return _mode_table(factorise.cp_svd_init(tensor_cells, factors))


# ---- online NMF -------------------------------------------------------------

STATS_STEPS = [
    ENTRIES, W0, sql.sums("b", "entries", "doc_id", {"term_id": "w0"}), sql.gram("g", ["w0"]),
    sql.least_squares("h", "b", "g", 0.0), sql.gram("hh", ["h"]), sql.sums("hx", "entries", "term_id", {"doc_id": "h"}),
]


def _codes_and_stats(spark, folder):
    _, entries, terms, _ = _start(spark, folder)
    codes = settle(coding.nmf_transform(entries, terms).withColumnRenamed("h", "u"))
    a, b = online.sufficient_stats(entries, codes, RANK, "term_id", "doc_id")
    return terms, a, b


@query("sufficient_stats", with_corpus(
    " UNION ALL ".join(
        [f"SELECT 'A' AS part, {i}::BIGINT AS id, {j} AS topic, round(g{i}{j}, 6) AS value FROM hh" for i in sql.K for j in sql.K]
        + [f"SELECT 'B', idx::BIGINT, {k}, round(b{k}, 6) FROM hx" for k in sql.K]),
    *STATS_STEPS, upto="tfidf"))
def sufficient_stats(spark, folder):
    _, a, b = _codes_and_stats(spark, folder)
    small = spark.createDataFrame(
        [("A", i, j, float(a[i, j])) for i in range(RANK) for j in range(RANK)],
        "part string, id bigint, topic int, value double",
    )
    large = b.select(F.lit("B").alias("part"), F.col("term_id").cast("bigint").alias("id"), F.posexplode("b").alias("topic", "value"))
    return small.unionByName(large).withColumn("value", F.round("value", 6))


@query("onmf_update_dict", with_corpus(
    sql.long("w1", "term_id"), *STATS_STEPS, *sql.columns("w1", "w0", "hx", "hh"), upto="tfidf"))
def onmf_update_dict(spark, folder):
    terms, a, b = _codes_and_stats(spark, folder)
    return _long(update_columns(terms, b, a).table, "term_id")


@query("onmf_step", with_corpus(
    sql.long("two_w", "term_id"), ENTRIES, W0, sql.zero_gram("a0"),
    *sql.matrix_step("one", "entries", "w0", "a0", None, 1, 0.7, 1.0, "doc_id"),
    *sql.matrix_step("two", "entries", "one_w", "one_a", "one_b", 2, 0.7, 1.0, "doc_id"), upto="tfidf"))
def onmf_step(spark, folder):
    """Two steps with all documents as the batch."""
    _, entries, terms, _ = _start(spark, folder)
    state = online.MatrixState(terms, np.zeros((RANK, RANK)))
    with kept(entries) as entries:
        for t in (1, 2):
            _, state = online.onmf_step(entries, state, t, 0.7, 1.0, by="doc_id")
    return _long(state.terms.table, "term_id")


N_SLICES, STEPS_PER_SLICE, BATCH = 3, 2, 60
ONMF = dict(iterations=STEPS_PER_SLICE + 1, batch_size=BATCH, beta=0.7, alpha=1.0, seed=SEED)


def _round_robin(spark, folder, data: Corpus | None = None):
    """(corpus, entries(slice, pos, term_id, x), documents per slice)."""
    data = data or corpus(spark, folder)
    numbered = number_rows(data.docs.select("doc_id"), ["doc_id"], name="n")
    t, d = tensor.fold_round_robin(F.col("n"), N_SLICES)
    places = numbered.select("doc_id", t.alias("slice"), d.cast("bigint").alias("pos"))
    entries = data.entries.join(places, "doc_id").select("slice", "pos", "term_id", "x")
    sizes = [(data.n_docs - s + N_SLICES - 1) // N_SLICES for s in range(N_SLICES)]
    return data, entries, sizes


def _onmf_steps() -> tuple[list[str], str]:
    """(tables of all steps of all slices, name of the last dictionary)."""
    steps, w, a, b = [sql.zero_gram("a0")], "w0", "a0", None
    for j in range(N_SLICES):
        population = f"SELECT count(*) FROM numbered WHERE n % {N_SLICES} = {j}"
        steps.append(draws_sql(STEPS_PER_SLICE, BATCH, population, SEED + j).replace("draws AS", f"draws{j} AS"))
        for i in range(1, STEPS_PER_SLICE + 1):
            tag = f"s{j}_{i}"
            steps.append(f"""{tag}_x AS MATERIALIZED (SELECT draw, term_id, x FROM draws{j}
                JOIN numbered ON n = pos * {N_SLICES} + {j} JOIN tfidf USING (doc_id) WHERE iter = {i})""")
            steps += sql.matrix_step(tag, f"{tag}_x", w, a, b, i + j * (STEPS_PER_SLICE + 1), 0.7, 1.0)
            w, a, b = f"{tag}_w", f"{tag}_a", f"{tag}_b"
    return steps, w


def _train_sql(first: bool = True) -> str:
    """With `first` also the starting dictionary, both labelled by version."""
    steps, w = _onmf_steps()
    if not first:
        return with_corpus(sql.long(w, "term_id"), NUMBERED, W0, *steps, upto="tfidf")
    last = sql.long(w, "term_id", version=f"{N_SLICES}")
    return with_corpus(sql.long("w0", "term_id", version="0") + " UNION ALL " + last, NUMBERED, W0, *steps, upto="tfidf")


def fit_onmf(spark, folder, rank: int = RANK, get_dicts=(), data: Corpus | None = None):
    own = data is None
    data, entries, sizes = _round_robin(spark, folder, data)
    terms = init_factor(data.vocabulary.select("term_id"), "term_id", data.n_terms, rank, SEED)
    entries = stored(entries, "by-slice", "slice")
    if own:
        data.give_up("entries")
    slices = [(entries.where(F.col("slice") == s).drop("slice"), sizes[s]) for s in range(N_SLICES)]
    state, versions = online.onmf_train(slices, terms, get_dicts, **ONMF)
    release(entries)
    return data, state, versions


@query("onmf_train", _train_sql())
def onmf_train(spark, folder):
    _, _, versions = fit_onmf(spark, folder, get_dicts=[0, N_SLICES])
    out = None
    for version, table in versions.items():
        rows = _long(table, "term_id").withColumn("version", F.lit(version))
        out = rows if out is None else out.unionByName(rows)
    return out


def _ontf_sql() -> str:
    steps = [
        'unfolded AS MATERIALIZED (SELECT v AS "row", t::BIGINT * (SELECT max(d) + 1 FROM slices) + d AS col, x FROM cells)',
        draws_sql(2, BATCH, "SELECT (max(t) + 1) * (max(d) + 1) FROM slices"), sql.zero_gram("a0"),
        sql.start("r0", "row", VOCAB_IDS, SEED),
    ]
    w, a, b = "r0", "a0", None
    for i in (1, 2):
        steps.append(f'x{i} AS MATERIALIZED (SELECT draw, "row" AS r, x FROM draws JOIN unfolded ON col = pos WHERE iter = {i})')
        steps += sql.matrix_step(f"s{i}", f"x{i}", w, a, b, 4 + i, 1.0, 0.1, axis="r")
        w, a, b = f"s{i}_w", f"s{i}_a", f"s{i}_b"
    return with_corpus(sql.long(w, "term_id"), *steps)


@query("ontf_train", _ontf_sql())
def ontf_train(spark, folder):
    """Term mode of the tensor, resumed after four steps that left no statistics."""
    data = corpus(spark, folder)
    size = dims(data)
    unfolding = tensor.unfold_mode(cells(data), "v", size)
    index = data.vocabulary.select(F.col("term_id").cast("bigint").alias("row"))
    rows = init_factor(index, "row", size["v"], RANK, SEED)
    state = online.MatrixState(rows, np.zeros((RANK, RANK)), t=4)
    state = online.ontf_train(unfolding, size["t"] * size["d"], rows, 3, BATCH, 0.1, SEED, state)
    return _long(state.terms.table.withColumn("row", F.col("row").cast("int")), "row", "term_id")


# ---- online CP --------------------------------------------------------------

CP_FACTORS = {"t": "u_t", "v": "u_v"}


def _two_modes(factors):
    return {a: factors[a] for a in ("t", "v")}


@query("ocpd_code", with_corpus(
    sql.long("h", "d", "h"), TENSOR, UT, UV, sql.start("c0", "code", PLACE_IDS, SEED),
    sql.sums("b", "tensor", "d", CP_FACTORS), sql.gram("g", ["u_t", "u_v"]), *sql.swept("h", "c0", "b", "g", 3)))
def ocpd_code(spark, folder):
    _, tensor_cells, factors = _tensor(spark, folder)
    rows = factors["d"].table.select("d")
    codes = coding.cp_codes(tensor_cells, list(_two_modes(factors).values()), "d", rows, sweeps=3, seed=SEED)
    return _long(codes, "d", value="h", column="h")


SIZES = {"t": "SELECT max(t) + 1 FROM slices", "v": "SELECT count(*) FROM vocab", "d": "SELECT max(d) + 1 FROM slices"}


@query("ocpd_code_sketched", with_corpus(
    sql.long("h", "d", "h"), TENSOR, UT, UV, sql.start("c0", "code", PLACE_IDS, SEED),
    *sql.sketched("h", "c0", "tensor", "d", CP_FACTORS, {a: SIZES[a] for a in "tv"}, 50, 3, SEED)))
def ocpd_code_sketched(spark, folder):
    """Codes of which every sweep sees one in fifty rows of the dictionary."""
    _, tensor_cells, factors = _tensor(spark, folder)
    rows = factors["d"].table.select("d")
    two = list(_two_modes(factors).values())
    codes = coding.cp_codes(tensor_cells, two, "d", rows, sweeps=3, seed=SEED, subsample_ratio=50)
    return _long(codes, "d", value="h", column="h")


def _sketched_als_sql() -> str:
    current, steps = dict(FACTORS), []
    for place, axis in enumerate(FACTORS):
        others = _others(current, axis)
        steps += sql.sketched(f"f_{axis}", current[axis], "tensor", axis, others, {a: SIZES[a] for a in others}, 20, 2, SEED + place)
        current[axis] = f"f_{axis}"
    return with_corpus(_part_sql(**current), TENSOR, UT, UV, UD, *steps)


@query("cp_als_sketched", _sketched_als_sql())
def cp_als_sketched(spark, folder):
    _, tensor_cells, factors = _tensor(spark, folder)
    fit = factorise.cp_als(tensor_cells, factors, 1, sweeps=2, subsample_ratio=20, seed=SEED)
    return _mode_table(fit.factors)


CODED = [
    TENSOR, UT, UV, UD, sql.gram("a", ["u_d"]),
    "b AS (SELECT t, v, sum(x * u0) AS b0, sum(x * u1) AS b1 FROM tensor JOIN u_d ON idx = d GROUP BY t, v)",
]


def _aggregates(spark, folder):
    """(factors t and v, A, B, cells) with the document factor taken as the codes."""
    _, tensor_cells, factors = _tensor(spark, folder)
    a = gram(factors["d"].table, RANK)
    codes = factors["d"].table
    joined = tensor_cells.join(codes, "d")
    sums = joined.groupBy("t", "v").agg(*[F.sum(F.col("x") * F.col("u")[k]).alias(f"_{k}") for k in range(RANK)])
    return _two_modes(factors), a, sums.select("t", "v", F.array("_0", "_1").alias("b")), tensor_cells


def _written_aggregates(spark, folder):
    """The same with B, which is read by every mode, written in place of the cells."""
    factors, a, b, tensor_cells = _aggregates(spark, folder)
    b = stored(b, "sums")
    release(tensor_cells)
    return factors, a, b


@query("cp_gram", with_corpus(
    " UNION ALL ".join(
        f"SELECT '{axis}' AS mode, {i} AS i, {j} AS j, round(g{i}{j}, 6) AS a FROM a_{axis}"
        for axis in "tv" for i in sql.K for j in sql.K),
    *CODED, sql.gram("a_t", ["u_v"], "a"), sql.gram("a_v", ["u_t"], "a")))
def cp_gram(spark, folder):
    factors, a, _, _ = _aggregates(spark, folder)
    rows = [
        (axis, i, j, round(float(online.cp_gram(a, factors, axis)[i, j]), 6))
        for axis in factors for i in range(RANK) for j in range(RANK)
    ]
    return spark.createDataFrame(rows, "mode string, i int, j int, a double")


@query("cp_mttkrp_agg", with_corpus(
    " UNION ALL ".join(f"SELECT '{axis}' AS mode, idx::BIGINT AS id, {k} AS topic, round(b{k}, 6) AS b FROM b_{axis}"
                       for axis in "tv" for k in sql.K),
    *CODED, sql.sums("b_t", "b", "t", {"v": "u_v"}, lambda k: f"c.b{k}"),
    sql.sums("b_v", "b", "v", {"t": "u_t"}, lambda k: f"c.b{k}")))
def cp_mttkrp_agg(spark, folder):
    factors, _, b = _written_aggregates(spark, folder)
    out = None
    for axis in factors:
        rows = online.cp_mttkrp_agg(b, factors, axis, RANK).select(
            F.lit(axis).alias("mode"), F.col(axis).cast("bigint").alias("id"), F.posexplode("b").alias("topic", "b")
        )
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("b", F.round("b", 6))


def _update_sql(radius: float) -> str:
    return with_corpus(
        _part_sql(t="n_t", v="n_v"), *CODED,
        sql.sums("b_t", "b", "t", {"v": "u_v"}, lambda k: f"c.b{k}"), sql.gram("a_t", ["u_v"], "a"),
        *sql.columns("n_t", "u_t", "b_t", "a_t", radius),
        sql.sums("b_v", "b", "v", {"t": "n_t"}, lambda k: f"c.b{k}"), sql.gram("a_v", ["n_t"], "a"),
        *sql.columns("n_v", "u_v", "b_v", "a_v", radius),
    )


@query("ocpd_update_factors", _update_sql(0.5))
def ocpd_update_factors(spark, folder):
    """A radius this small cuts the steps short, so the cut is exercised."""
    factors, a, b = _written_aggregates(spark, folder)
    updated = online.ocpd_update_factors(factors, a, b, 0.5)
    release(b)
    return _mode_table(updated)


STEP_TABLES, STEP_FACTORS = sql.cp_step(
    "s", "tensor", PLACE_IDS, CP_FACTORS, None, None, 1, 0.7, float(np.float64(10_000.0) * 2.0 ** -0.7 / np.log(3.0)), 10, SEED, "d")


@query("ocpd_step", with_corpus(_part_sql(**STEP_FACTORS), TENSOR, UT, UV, *STEP_TABLES))
def ocpd_step(spark, folder):
    _, tensor_cells, factors = _tensor(spark, folder)
    two = _two_modes(factors)
    state = online.CPState(two, np.zeros((RANK, RANK)))
    with kept(tensor_cells) as tensor_cells:
        _, state = online.ocpd_step(
            tensor_cells, factors["d"].table.select("d"), state, 1, "d", 0.7, seed=SEED
        )
    return _mode_table(state.factors)


def _ocpd_steps() -> tuple[list[str], dict[str, str]]:
    """(tables of two steps on drawn documents, names of the last factors)."""
    steps, current, a, b = [draws_sql(2, 8, "SELECT max(d) + 1 FROM slices")], dict(CP_FACTORS), None, None
    for i in (1, 2):
        steps.append(f"x{i} AS MATERIALIZED (SELECT draw, t, v, x FROM draws JOIN tensor ON d = pos WHERE iter = {i})")
        radius = float(10_000.0 * (i + 1.0) ** -0.7 / np.log(i + 2.0))
        more, current = sql.cp_step(
            f"s{i}", f"x{i}", f"SELECT draw AS idx FROM draws WHERE iter = {i}", current, a, b, i, 0.7, radius, 10, SEED)
        steps += more
        a, b = f"s{i}_a", f"s{i}_b"
    return steps, current


def _ocpd_train_sql() -> str:
    steps, current = _ocpd_steps()
    codes = """codes AS (SELECT pos AS idx, sum(u0) AS u0, sum(u1) AS u1 FROM
        (SELECT iter, pos, max(draw) AS draw FROM draws GROUP BY iter, pos) JOIN
        (SELECT 1 AS iter, * FROM s1_h UNION ALL SELECT 2, * FROM s2_h) h ON h.iter = draws_iter AND h.idx = draw GROUP BY pos)"""
    codes = codes.replace("SELECT iter, pos, max(draw)", "SELECT iter AS draws_iter, pos, max(draw)")
    return with_corpus(_part_sql(**current, code="codes"), TENSOR, UT, UV, *steps, codes)


def fit_ocpd(spark, folder, data: Corpus | None = None) -> online.CPState:
    _, tensor_cells, factors = _tensor(spark, folder, data=data)
    with kept(tensor_cells) as tensor_cells:
        return online.ocpd_train(tensor_cells, _two_modes(factors), "d", factors["d"].size, 3, 8, 0.7, seed=SEED)


@query("ocpd_train", _ocpd_train_sql())
def ocpd_train(spark, folder):
    """Two steps on drawn documents: the factors and the codes they received."""
    state = fit_ocpd(spark, folder)
    codes = online.accumulated_codes(state, "d").withColumnRenamed("h", "u")
    return _mode_table(state.factors).unionByName(_two_part({"code": (codes, "d")}))


PATCH_DOCS = 6
WINDOWED = dict(
    patch_docs=PATCH_DOCS, iterations=1, sub_iterations=2, refresh_history_as=1, beta=0.7, seed=SEED
)


PATCH_STARTS = [
    sql.start("p_t", "t", "SELECT i::INT AS idx FROM range({n}) r(i)", SEED), UV,
    sql.start("p_d", "d", f"SELECT i::INT AS idx FROM range({PATCH_DOCS}) r(i)", SEED),
]
PATCH_FACTORS = {"t": "p_t", "v": "u_v", "d": "p_d"}


def _patch_step_sql(tag, cells_sql, factors, a, b, t, seed):
    """Draw a patch and take one step on it."""
    steps = [
        draws_sql(1, PATCH_DOCS, "SELECT max(d) + 1 FROM slices", seed).replace("draws AS", f"{tag}_draws AS"),
        f"""{tag}_x AS MATERIALIZED (SELECT 0 AS patch, c.t, v, draw::INT AS d, x FROM ({cells_sql}) c
            JOIN {tag}_draws ON c.d = pos)""",
    ]
    radius = float(10_000.0 * (t + 1.0) ** -0.7 / np.log(t + 2.0))
    more, new = sql.cp_step(
        tag, f"{tag}_x", "SELECT 0 AS idx", factors, a, b, t, 0.7, radius, 10, seed, "patch")
    return steps + more, new


def _mode_sql(factors: dict[str, str], **constants: str) -> str:
    return " UNION ALL ".join(
        sql.long(f, **constants, mode=f"'{axis}'").replace("idx AS idx", "idx::BIGINT AS idx")
        for axis, f in factors.items())


def _patches_sql() -> str:
    steps = [PATCH_STARTS[0].replace("{n}", "20"), *PATCH_STARTS[1:]]
    current, a, b = PATCH_FACTORS, None, None
    for turn in range(2):
        more, current = _patch_step_sql(f"s{turn}", "SELECT * FROM tensor", current, a, b, turn + 1, SEED + turn)
        steps += more
        a, b = f"s{turn}_a", f"s{turn}_b"
    return with_corpus(_mode_sql(current), TENSOR, *steps)


def _sequential_sql() -> str:
    steps = [PATCH_STARTS[0].replace("{n}", "10"), *PATCH_STARTS[1:]]
    current, a, b, parts = PATCH_FACTORS, None, None, []
    for window in range(3):
        low = 5 * window
        part = f"SELECT t - {low} AS t, v, d, x FROM tensor WHERE t BETWEEN {low} AND {low + 9}"
        more, current = _patch_step_sql(f"s{window}", part, current, a, b, 2, SEED + window)
        steps += more
        a, b = f"s{window}_a", f"s{window}_b"
        parts.append(_mode_sql(current, window_id=f"{window}"))
    return with_corpus(" UNION ALL ".join(parts), TENSOR, *steps)


def _patch_factors(spark, n_slices: int, n_terms: int):
    return factorise.init_factors(spark, {"t": n_slices, "v": n_terms, "d": PATCH_DOCS}, RANK, SEED)


def _loading_long(table: DataFrame, *columns: str) -> DataFrame:
    return table.select(*columns, "idx", F.posexplode("u").alias("topic", "w")).withColumn("w", F.round("w", 6))


@query("ocpd_train_patches", _patches_sql())
def ocpd_train_patches(spark, folder):
    data = corpus(spark, folder)
    size = dims(data)
    with kept(written_cells(data)) as tensor_cells:
        state = online.ocpd_train_patches(
            tensor_cells, size["d"], _patch_factors(spark, size["t"], size["v"]), PATCH_DOCS, 2, 2, 0.7, seed=SEED
        )
    return _loading_long(online.loading_table(state), "mode")


WINDOW, N_WINDOWS = 5, 3


def _windows_sql() -> str:
    radius = float(10_000.0 * 2.0 ** -0.7 / np.log(3.0))
    steps = [
        PATCH_STARTS[0].replace("{n}", f"{WINDOW}"), UV, UD, draws_sql(1, N_WINDOWS, f"SELECT max(t) + 1 - {WINDOW} FROM slices"),
        f"""windowed AS MATERIALIZED (SELECT draw::INT AS patch, (t - pos)::INT AS t, v, d, x FROM tensor
            JOIN draws ON t BETWEEN pos AND pos + {WINDOW - 1})""",
    ]
    more, last = sql.cp_step(
        "s", "windowed", "SELECT draw::INT AS idx FROM draws", {"t": "p_t", "v": "u_v", "d": "u_d"}, None, None, 1, 0.7,
        radius, 10, SEED, "patch")
    return with_corpus(_mode_sql(last), TENSOR, *steps, *more)


@query("ocpd_train_windows", _windows_sql())
def ocpd_train_windows(spark, folder):
    """One step on three random windows of five slices."""
    data = corpus(spark, folder)
    size = dims(data)
    factors = factorise.init_factors(spark, {"t": WINDOW, "v": size["v"], "d": size["d"]}, RANK, SEED)
    state = online.ocpd_train_windows(written_cells(data), size["t"], WINDOW, N_WINDOWS, factors, 1, 2, 0.7, seed=SEED)
    return _loading_long(online.loading_table(state), "mode")


@query("ocpd_train_sequential", _sequential_sql())
def ocpd_train_sequential(spark, folder):
    data = corpus(spark, folder)
    size = dims(data)
    with kept(written_cells(data)) as tensor_cells:
        fits = online.ocpd_train_sequential(
            tensor_cells, size["t"], size["d"], _patch_factors(spark, 10, size["v"]), 10, 5, **WINDOWED
        )
    out = None
    for number, (_, state) in enumerate(fits):
        rows = online.loading_table(state, number)
        out = rows if out is None else out.unionByName(rows)
    return _loading_long(out, "window_id", "mode")


# ---- LDA, comparison, stored models -----------------------------------------


class Topics:
    """LDA of the bags, or of weights(doc_id, term_id, x). The list of terms and the
    model come to the driver if they are no more than a local factor may have; else
    both stay tables."""

    def __init__(self, spark, folder, n_topics: int = 4, passes: int = 5, weights=None, data: Corpus | None = None):
        self.spark, self.data = spark, data or corpus(spark, folder)
        self.long = self.data.n_terms > MODEL_CELLS
        if self.long:
            self._fit_long(folder, n_topics, passes, weights)
            return
        if weights is None:
            terms = [r.term for r in self.data.vocabulary.orderBy("term_id").select("term").collect()]
            bags = lda.bag_vectors(document_terms(english(spark, folder)), terms)
            self.vectors = bags.select("doc_id", "source", "features").persist()
        else:
            self.vectors = lda.weight_vectors(weights(self.data), self.data.n_terms).persist()
        self.model = lda.lda_topics(self.vectors, n_topics, passes, SEED)

    def _fit_long(self, folder, n_topics, passes, weights) -> None:
        data = self.data
        if weights is None:
            # Rows of one doc_id are documents of their own; their numbers are kept, as a second scan may number them anew.
            docs = stored(document_terms(english(self.spark, folder)).withColumn("row", F.monotonically_increasing_id()), "bags")
            self.documents = docs.select("row", "doc_id")
            counts = counts_in_documents(docs.select("row", "terms"))
            cells = bag_of_words(counts, data.vocabulary).select("row", "term_id", F.col("n").cast("double").alias("x"))
        else:
            # The rows without an id are one document here, as where weights are made vectors.
            cells = weights(data).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63)).cast("bigint")))
        self.key = cells.columns[0]
        self.cells = stored(cells, "cells")
        self.model = lda.long_topics(self.cells, data.vocabulary, n_topics, passes, SEED, self.key)

    def terms(self) -> DataFrame:
        """(topic, term_id, p)."""
        return self.model.topic_terms() if self.long else lda.lda_topic_terms(self.spark, self.model)

    def shares(self) -> DataFrame:
        """(doc_id, topic, p)."""
        if self.long:
            return self.model.doc_topics(self.cells, self.documents, self.key).select("doc_id", "topic", "p")
        return lda.lda_doc_topics(self.model, self.vectors).select("doc_id", "topic", "p")

    def close(self) -> None:
        if not self.long:
            self.vectors.unpersist()


# SQL cannot fit the model: these have no oracle, tests hold what must be true of them.


@query("lda_topics")
def lda_topics(spark, folder):
    """The ten strongest terms of each topic."""
    fit = Topics(spark, folder)
    fit.close()
    weights = fit.terms().withColumnRenamed("p", "w")
    top = topics.topic_keywords(join_term_lookup(weights, fit.data.vocabulary).select("topic", "term", "w"), 10)
    return top.withColumn("w", F.round("w", 6))


@query("lda_topics_weighted")
def lda_topics_weighted(spark, folder):
    """The same for a model of n * log2(N / df) weights of length 1, instead of counts."""
    fit = Topics(spark, folder, weights=lambda data: log2_tfidf(data.counts, data.vocabulary, data.n_docs).select("doc_id", "term_id", "x"))
    fit.close()
    found = fit.terms().withColumnRenamed("p", "w")
    top = topics.topic_keywords(join_term_lookup(found, fit.data.vocabulary).select("topic", "term", "w"), 10)
    return top.withColumn("w", F.round("w", 6))


@query("lda_doc_topics")
def lda_doc_topics(spark, folder):
    """Every document's share of every topic. A document without any known term has no topics."""
    fit = Topics(spark, folder)
    path = store.save_tables(fit.shares(), scratch_path(spark, "shares"), [])
    fit.close()
    return store.load_table(spark, path, "doc_id bigint, topic int, p double").withColumn("p", F.round("p", 6))


@query("lda_topic_terms")
def lda_topic_terms(spark, folder):
    """Every topic's distribution over the terms."""
    fit = Topics(spark, folder)
    fit.close()
    return fit.terms().select(F.col("topic").cast("int").alias("topic"), "term_id", "p")


# Keywords and prevalence of several learners over one corpus, in one table:
# (part, method, slice, topic, rank, term, value).
KEYWORDS = 5


def _keyword_rows(method: str, weights: DataFrame, data: Corpus) -> DataFrame:
    named = join_term_lookup(weights.withColumn("w", F.round("w", 6)), data.vocabulary).select("topic", "term", "w")
    return topics.topic_keywords(named, KEYWORDS).select(
        F.lit("keyword").alias("part"), F.lit(method).alias("method"), F.lit(None).cast("int").alias("slice"),
        F.col("topic").cast("int").alias("topic"), F.col("rank").cast("int").alias("rank"), "term", F.col("w").alias("value"),
    )


def _prevalence_rows(method: str, shares: DataFrame) -> DataFrame:
    return shares.select(
        F.lit("prevalence").alias("part"), F.lit(method).alias("method"), F.col("slice").cast("int").alias("slice"),
        F.col("topic").cast("int").alias("topic"), F.lit(None).cast("int").alias("rank"),
        F.lit(None).cast("string").alias("term"), F.round("share", 6).alias("value"),
    )


def _from_codes(codes: DataFrame, data: Corpus) -> DataFrame:
    """(slice, topic, share) of document codes (doc_id, topic, h)."""
    places = slices(data).select("doc_id", F.col("t").alias("slice"))
    per_slice = places.groupBy("slice").agg(F.count("*").alias("n_docs"))
    shares = topics.topic_prevalence(codes.join(places, "doc_id"), per_slice)
    return shares.select("slice", "topic", F.col("prevalence").alias("share"))


def _from_time(factor: Factor) -> DataFrame:
    """(slice, topic, share) of a time factor."""
    return topics.normalize_rows(factor.table, "t").withColumnRenamed("t", "slice")


def _compared(spark, folder, data: Corpus) -> DataFrame:
    """Rows of the four learners whose steps do not depend on how the data are split."""
    _, nmf = fit_nmf(spark, folder, data=data)
    _, onmf, _ = fit_onmf(spark, folder, data=data)
    _, tensor_cells, factors = _tensor(spark, folder, data=data)
    cp = factorise.cp_mu(tensor_cells, factors, 2).factors
    ocpd = fit_ocpd(spark, folder, data).factors
    entries = data.entries
    coded = coding.nmf_transform(entries, onmf.terms)
    of_terms = lambda f: topics.weights_long(f.table.withColumnRenamed("v", "term_id"), "term_id")
    tables = [
        _keyword_rows("nmf", of_terms(nmf.factors["term_id"]), data),
        _prevalence_rows("nmf", _from_codes(topics.weights_long(nmf.factors["doc_id"].table, "doc_id", "h"), data)),
        _keyword_rows("onmf", of_terms(onmf.terms), data),
        _prevalence_rows("onmf", _from_codes(topics.weights_long(coded.withColumnRenamed("h", "u"), "doc_id", "h"), data)),
        _keyword_rows("ncpd", of_terms(cp["v"]), data), _prevalence_rows("ncpd", _from_time(cp["t"])),
        _keyword_rows("ocpd", of_terms(ocpd["v"]), data), _prevalence_rows("ocpd", _from_time(ocpd["t"])),
    ]
    return reduce(DataFrame.unionByName, tables)


def _comparison_sql() -> str:
    nmf, w, h = _nmf_steps()
    onmf, dictionary = _onmf_steps()
    ocpd, factors = _ocpd_steps()
    mu = MU_HISTORY[-1]
    terms = {"nmf": w, "onmf": dictionary, "ncpd": mu["v"], "ocpd": factors["v"]}
    parts = [f"""SELECT 'keyword' AS part, '{m}' AS method, NULL::INT AS slice, topic, rank, term, w AS value FROM
        (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY w DESC, term)::INT AS rank FROM
          (SELECT topic, term, w FROM ({sql.long(f, 'term_id')}) JOIN vocab USING (term_id))) WHERE rank <= {KEYWORDS}"""
             for m, f in terms.items()]
    parts += [f"""SELECT 'prevalence', '{m}', t, topic, NULL, NULL, round(m / sum(m) OVER (PARTITION BY t), 6) FROM
        (SELECT t, topic, sum(h) / any_value(n) AS m FROM ({sql.long(f, 'doc_id', 'h', 15)}) JOIN slices USING (doc_id)
          JOIN (SELECT t, count(*) AS n FROM slices GROUP BY t) USING (t) GROUP BY t, topic)""" for m, f in (("nmf", h), ("onmf", "oc_h"))]
    parts += [f"""SELECT 'prevalence', '{m}', t, topic, NULL, NULL, round(w / sum(w) OVER (PARTITION BY t), 6) FROM
        ({sql.long(f, 't', digits=15)})""" for m, f in (("ncpd", mu["t"]), ("ocpd", factors["t"]))]
    coded = [sql.sums("oc_b", "entries", "doc_id", {"term_id": dictionary}), sql.gram("oc_g", [dictionary]),
             sql.least_squares("oc_h", "oc_b", "oc_g", 0.0)]
    return with_corpus(" UNION ALL ".join(parts), ENTRIES, TENSOR, NUMBERED, W0, H0, UT, UV, UD, *nmf, *onmf, *coded, *MU_STEPS, *ocpd)


@query("method_comparison", _comparison_sql())
def method_comparison(spark, folder):
    """NMF, online NMF, CP and online CP side by side: keywords of each topic and its prevalence over time."""
    return _compared(spark, folder, corpus(spark, folder))


@query("method_comparison_lda")
def method_comparison_lda(spark, folder):
    """The rows of the same table for LDA, whose fit SQL cannot follow."""
    fit = Topics(spark, folder, RANK)
    weights = fit.terms().select("term_id", "topic", F.col("p").alias("w"))
    codes = fit.shares().select("doc_id", "topic", F.col("p").alias("h"))
    return _keyword_rows("lda", weights, fit.data).unionByName(_prevalence_rows("lda", _from_codes(codes, fit.data)))


@query("load_model", with_corpus(
    "SELECT topic, term, w, rank FROM (SELECT topic, term, w, row_number() OVER (PARTITION BY topic ORDER BY w DESC, term)::INT AS rank "
    "FROM (SELECT topic, term, round(sum(x), 6) AS w FROM (SELECT (term_id % 4)::INT AS topic, term, x FROM tfidf JOIN vocab USING (term_id)) "
    "GROUP BY ALL)) WHERE rank <= 5", upto="tfidf"))
def load_model(spark, folder):
    """Store a weight table and the vocabulary, read both back, report keywords."""
    data = corpus(spark, folder)
    topic = (F.col("term_id") % 4).cast("int")
    weights = data.weights.groupBy("term_id", topic.alias("topic")).agg(F.round(F.sum("x"), 6).alias("w"))
    root = store.save_model({"weights": weights, "vocabulary": data.vocabulary}, scratch_path(spark, "model"))
    saved = store.load_model(spark, root, ["weights", "vocabulary"])
    named = join_term_lookup(saved["weights"], saved["vocabulary"])
    return topics.topic_keywords(named.select("topic", "term", "w"), 5)
