import threading
import time
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom import session
from driftloom.learners import algebra, coding, factorise, lda, online, passes, singular, trials
from driftloom.learners.algebra import Factor
from driftloom.operators import pool
from driftloom.operators.sampling import hash_int
from driftloom.operators.tensor import unfold_mode
from driftloom.plans import learning as queries, tables_and_topics
from driftloom.plans.corpus import corpus
from driftloom.session import checkpoint_dir, release, settle, stored


def table(spark, axis, matrix):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return Factor(spark.createDataFrame(rows, f"{axis} int, u array<double>"), axis, len(rows), len(matrix[0]))


def array(df, axis, column="u"):
    return np.array([r[column] for r in df.orderBy(axis).collect()])


def entries(spark, matrix, row, col):
    rows = [(int(i), int(j), float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix))]
    return spark.createDataFrame(rows, f"{row} int, {col} int, x double")


def cells3(spark, dense):
    rows = [(int(i), int(j), int(k), float(dense[i, j, k])) for i, j, k in zip(*np.nonzero(dense))]
    return spark.createDataFrame(rows, "t int, v int, d int, x double")


def planted(sizes, rank, seed=0):
    random = np.random.default_rng(seed)
    factors = [random.random((n, rank)) for n in sizes]
    letters = "ijk"[: len(sizes)]
    spec = ",".join(f"{c}r" for c in letters) + "->" + letters
    return np.einsum(spec, *factors), factors


def test_codes_are_optimal(spark):
    random = np.random.default_rng(1)
    w, x = random.random((12, 4)), random.random((12, 9)) * (random.random((12, 9)) < 0.4)
    cells = entries(spark, x, "term_id", "doc_id")
    docs = spark.range(9).select(F.col("id").cast("int").alias("doc_id"))
    for alpha in (0.0, 0.3):
        h = array(coding.code_documents(cells, table(spark, "term_id", w), alpha=alpha, documents=docs), "doc_id", "h").T
        slope = w.T @ (w @ h - x) + alpha
        assert (h >= 0).all() and (slope > -1e-8).all() and np.abs(slope * h).max() < 1e-8


def test_sparse_penalty_gives_zero_codes(spark):
    cells = entries(spark, np.ones((3, 2)), "term_id", "doc_id")
    h = array(coding.sparse_code_transform(cells, table(spark, "term_id", np.ones((3, 1))), alpha=5.0), "doc_id", "h")
    assert (h == 0).all()


def test_coupled_sweeps_without_rules_equal_row_sweeps(spark):
    random = np.random.default_rng(2)
    g = np.cov(random.random((3, 8)))
    rows = [(i, random.random(3).tolist(), random.random(3).tolist()) for i in range(6)]
    df = spark.createDataFrame(rows, "i int, u array<double>, b array<double>")
    plain = df.select("i", coding.swept_codes(F.col("b"), F.col("u"), g, 3, 0.1).alias("u"))
    coupled = coding.swept_codes_coupled(df, "i", g, 3, 0.1)
    assert np.allclose(array(plain, "i"), array(coupled, "i"))
    still = coding.swept_codes_coupled(df, "i", g, 2, least_move=1e9)
    assert np.allclose(array(still, "i"), array(df, "i"))
    near = array(coding.swept_codes_coupled(df, "i", g, 1, radius=1e-3), "i") - array(df, "i")
    assert (np.linalg.norm(near, axis=0) <= 1e-3 + 1e-12).all()


@pytest.mark.parametrize("radius", [None, 0.05])
def test_column_update_without_the_driver_equals_the_local_one(spark, radius):
    random = np.random.default_rng(3)
    factor, a = table(spark, "i", random.random((7, 3))), np.cov(random.random((3, 9)))
    b = table(spark, "i", random.random((6, 3))).table.withColumnRenamed("u", "b")
    local = algebra.update_columns(factor, b, a, radius, 2)
    spread = algebra.update_columns(replace(factor, local=False), b, a, radius, 2)
    assert np.allclose(array(local.table, "i"), array(spread.table, "i"))
    assert (np.linalg.norm(array(spread.table, "i"), axis=0) <= 1 + 1e-9).all()


def test_a_long_factor_is_written_twice_whatever_its_rank(spark, monkeypatch):
    written = []
    monkeypatch.setattr(algebra, "settle", lambda df: written.append(df) or settle(df))
    factor = replace(table(spark, "v", np.random.default_rng(3).random((6, 4))), local=False)
    b = spark.createDataFrame([(i, [1.0, 2.0, 0.5, 0.1]) for i in range(5)], "v int, b array<double>")
    updated = algebra.update_columns(factor, b, np.eye(4) + 0.1, 0.5, 3)
    assert len(written) == 2
    assert updated.table.inputFiles()  # packed files, not rows of a checkpoint


def test_training_without_local_models_gives_the_same(spark):
    x = np.random.default_rng(4).random((8, 10))
    slices = [(entries(spark, x, "term_id", "pos"), 10)]
    start = table(spark, "term_id", np.random.default_rng(5).random((8, 2)))
    options = dict(iterations=3, batch_size=6, beta=0.7, alpha=0.1, seed=1)
    small, _ = online.onmf_train(slices, start, **options)
    large, _ = online.onmf_train(slices, replace(start, local=False), **options)
    assert np.allclose(array(small.terms.table, "term_id"), array(large.terms.table, "term_id"))


def test_nmf_error_never_rises(spark):
    x, _ = planted((9, 12), 3, 6)
    cells = entries(spark, x, "term_id", "doc_id")
    starts = factorise.init_factors(spark, {"term_id": 9, "doc_id": 12}, 3, 1)
    fit = factorise.nmf_batch(cells, starts["term_id"], starts["doc_id"], 3, with_trace=True)
    errors = [e for _, _, e in fit.trace]
    assert all(b <= a + 1e-9 for a, b in zip(errors, errors[1:]))
    w, h = (array(fit.factors[a].table, a) for a in ("term_id", "doc_id"))
    assert (w >= 0).all() and (h >= 0).all()
    assert errors[-1] == pytest.approx(np.linalg.norm(x - w @ h.T), rel=1e-6)


def test_cp_recovers_a_planted_tensor(spark):
    dense, _ = planted((5, 6, 7), 2, 7)
    cells = cells3(spark, dense)
    starts = factorise.init_factors(spark, {"t": 5, "v": 6, "d": 7}, 2, 2)
    fit = factorise.cp_mu(cells, starts, 4, with_trace=True)
    errors = [e for _, _, e in fit.trace]
    assert all(b <= a + 1e-9 for a, b in zip(errors, errors[1:]))
    assert errors[-1] / np.linalg.norm(dense) < 0.25
    model = np.einsum("ir,jr,kr->ijk", *(array(fit.factors[a].table, a) for a in "tvd"))
    error, relative = factorise.reconstruction_error(cells, fit.factors)
    assert error == pytest.approx(np.linalg.norm(dense - model), rel=1e-6)
    assert relative == pytest.approx(error / np.linalg.norm(dense))
    trace = fit.trace_table("ncpd", 3)
    assert trace.count() == 4 and trace.first().trial == 3


def test_als_lowers_the_error_with_and_without_radius(spark):
    dense, _ = planted((4, 5, 6), 2, 8)
    cells = cells3(spark, dense)
    starts = factorise.init_factors(spark, {"t": 4, "v": 5, "d": 6}, 2, 3)
    before, _ = factorise.reconstruction_error(cells, starts)
    for beta in (None, 1.0):
        fit = factorise.cp_als(cells, starts, 1, beta=beta, sweeps=2, with_trace=True)
        assert fit.trace[-1][2] < before


def test_singular_vectors_and_nonnegative_starts(spark):
    random = np.random.default_rng(9)
    x = 3 * np.outer(random.random(8), random.random(11)) + 0.3 * random.random((8, 11))
    cells = entries(spark, x, "term_id", "doc_id")
    starts = factorise.init_factors(spark, {"term_id": 8, "doc_id": 11}, 3, 4)
    left, right, values = factorise.leading_vectors(cells, starts["term_id"], ["doc_id"], 3)
    u, s, vt = np.linalg.svd(x)
    assert np.allclose(values[:1], s[:1], rtol=1e-5)
    assert np.abs(array(left, "term_id")[:, 0] @ u[:, 0]) > 1 - 1e-5
    w, h = factorise.nndsvd_init(cells, starts["term_id"], starts["doc_id"], 3)
    w, h = array(w.table, "term_id"), array(h.table, "doc_id")
    assert (w >= 0).all() and (h >= 0).all()
    assert np.allclose(np.outer(w[:, 0], h[:, 0]), s[0] * np.abs(np.outer(u[:, 0], vt[0])), atol=1e-3)
    dense, _ = planted((4, 5, 6), 2, 10)
    start = factorise.cp_svd_init(cells3(spark, dense), factorise.init_factors(spark, {"t": 4, "v": 5, "d": 6}, 2, 5), 3)
    for mode, axis in enumerate("tvd"):
        expected = np.linalg.svd(np.moveaxis(dense, mode, 0).reshape(dense.shape[mode], -1))[0]
        got = array(start[axis].table, axis)
        assert (got >= 0).all() and np.allclose(got[:, 0], np.abs(expected[:, 0]), atol=1e-3)


def test_starts_do_not_depend_on_partitioning(spark):
    index = algebra.axis_index(spark, "v", 30)
    one = algebra.init_factor(index.coalesce(1), "v", 30, 2, 7).table
    many = algebra.init_factor(index.repartition(5), "v", 30, 2, 7).table
    assert np.array_equal(array(one, "v"), array(many, "v"))
    assert (array(one, "v") >= 0).all() and (array(one, "v") < 1).all()


def test_onmf_snapshots_and_norms(spark):
    x = np.random.default_rng(11).random((6, 8))
    part = entries(spark, x, "term_id", "pos")
    start = table(spark, "term_id", np.random.default_rng(12).random((6, 2)))
    state, versions = online.onmf_train([(part, 8), (part, 8)], start, [0, 1, 2], iterations=3, batch_size=5, alpha=0.0)
    assert sorted(versions) == [0, 1, 2]
    w = array(state.terms.table, "term_id")
    assert (w >= 0).all() and (np.linalg.norm(w, axis=0) <= 1 + 1e-12).all()
    assert np.array_equal(array(versions[0], "term_id"), array(start.table, "term_id"))


def test_ontf_resumes_its_count_and_learns_joint_dictionaries(spark):
    dense, _ = planted((3, 4, 5), 2, 13)
    dims = {"t": 3, "v": 4, "d": 5}
    joint = unfold_mode(cells3(spark, dense), "t", dims, transpose=True)
    rows = factorise.init_factors(spark, {"row": 20}, 2, 6)["row"]
    rows = rows.using(rows.table.withColumn("row", F.col("row").cast("bigint")))
    first = online.ontf_train(joint, 3, rows, 3, 4, 0.01)
    assert first.t == 2
    again = online.ontf_train(joint, 3, rows, 3, 4, 0.01, state=first)
    assert again.t == 4 and again.terms.table.count() == 20


def test_ocpd_reduces_the_error_and_resumes(spark):
    dense, _ = planted((4, 5, 8), 2, 14)
    cells = cells3(spark, dense)
    factors = factorise.init_factors(spark, {"t": 4, "v": 5}, 2, 7)
    state = online.ocpd_train(cells, factors, "d", 8, 3, None, 1.0, with_trace=True)
    errors = [e for _, _, e in state.trace]
    assert errors[-1] < errors[0] and state.t == 2
    more = online.ocpd_train(cells, factors, "d", 8, 2, 4, 1.0, state=state)
    assert more.t == 3 and len(more.codes) == 3
    assert online.accumulated_codes(more, "d").count() == 8
    loading = online.loading_table(more)
    assert {r.mode: r["count"] for r in loading.groupBy("mode").count().collect()} == {"t": 4, "v": 5}


def test_lda_distributions_sum_to_one(spark):
    docs = spark.createDataFrame([(i, ["cat", "dog"] if i % 2 else ["sun", "sea"]) for i in range(10)], "doc_id int, terms array<string>")
    vectors = lda.bag_vectors(docs, ["cat", "dog", "sea", "sun"])
    model = lda.lda_topics(vectors, 2, 3, 1)
    for rows, key in ((lda.lda_doc_topics(model, vectors), "doc_id"), (lda.lda_topic_terms(spark, model), "topic")):
        sums = rows.groupBy(key).agg(F.sum("p").alias("s")).collect()
        assert all(r.s == pytest.approx(1.0) for r in sums)


def test_documents_of_a_long_topic_model_may_span_batches(spark, monkeypatch):
    sizes, rng = np.array([3, 0, 5, 1]), np.random.default_rng(2)
    x, e, alpha = rng.integers(1, 4, 9).astype(float), rng.random((9, 3)), np.full(3, 0.4)
    together = lda.document_shares(x, e, sizes, alpha)
    alone = [lda.document_shares(x[i:i + n], e[i:i + n], np.array([n]), alpha)[0] for i, n in ((0, 3), (3, 0), (3, 5), (8, 1))]
    assert np.allclose(together, alone)
    rows = [(d, v, 1.0 + (d * v) % 3) for d in range(5) for v in range(7)]
    cells = spark.createDataFrame(rows, "doc_id int, term_id int, x double").coalesce(1)
    terms = spark.range(7).select(F.col("id").cast("int").alias("term_id"))
    model = lda.long_topics(cells, terms, 2, 1, 1)
    whole = array(model.documents(cells, "doc_id"), "doc_id", "gamma")
    monkeypatch.setattr(lda, "CELLS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert np.allclose(array(model.documents(cells, "doc_id"), "doc_id", "gamma"), whole)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lda_queries_hold_more_terms_than_the_driver(spark, folder, monkeypatch):
    monkeypatch.setattr(queries, "MODEL_CELLS", 5)
    monkeypatch.setattr(lda, "MODEL_CELLS", 5)
    top = queries.lda_topics(spark, folder)
    assert {(r.topic, r["rank"]) for r in top.collect()} == {(k, n) for k in range(4) for n in range(1, 11)}
    english = spark.read.parquet(f"{folder}/documents.parquet").where("lang = 'en'").count()
    sums = queries.lda_doc_topics(spark, folder).groupBy("doc_id").agg(F.sum("p").alias("s")).collect()
    assert len(sums) == english and all(r.s == pytest.approx(1.0, abs=1e-5) for r in sums)


def test_a_local_factor_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(algebra, "MODEL_CELLS", 5)
    with pytest.raises(ValueError, match="local=False"):
        table(spark, "i", np.ones((2, 3)))


def test_codes_do_not_depend_on_their_batch(spark):
    random = np.random.default_rng(8)
    g = np.cov(random.random((3, 9)))
    b = table(spark, "i", random.random((40, 3)) * np.logspace(-6, 6, 40)[:, None]).table
    code = coding.least_squares_codes(F.col("u"), g).alias("u")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    alone = array(b.select("i", code), "i")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose(alone, array(b.coalesce(1).select("i", code), "i"), rtol=1e-9, atol=0)


# -- passes ------------------------------------------------------------------


def test_passes_equal_joins_at_rank_25(spark, monkeypatch):
    """One factor in rows, or all held: the same numbers as the join for every axis."""
    random = np.random.default_rng(4)
    x = random.random((30, 40)) * (random.random((30, 40)) < 0.3)
    x[:, 7] = 0
    cells = entries(spark, x, "term_id", "doc_id")
    starts = [random.random((n, 25)) for n in (30, 40)]
    terms, docs = table(spark, "term_id", starts[0]), table(spark, "doc_id", starts[1])
    far = replace(docs, local=False)
    monkeypatch.setattr(passes, "CELLS", 64)
    monkeypatch.setattr(passes, "SENT", 7)
    monkeypatch.setattr(passes, "KEPT", 2)
    w, h = starts
    for _ in range(5):
        h = h * (x.T @ w) / (h @ (w.T @ w) + 1e-12)
        w = w * (x @ h) / (w @ (h.T @ h) + 1e-12)
    for documents in (far, docs):
        fit = factorise.nmf_batch(cells, terms, documents, 5, with_trace=True)
        assert np.allclose(array(fit.factors["term_id"].table, "term_id"), w)
        assert np.allclose(array(fit.factors["doc_id"].table, "doc_id"), h)
        assert np.isclose(fit.trace[-1][2], np.linalg.norm(x - w @ h.T))
    joined = factorise._sweeps(cells, {"doc_id": far, "term_id": terms}, ["doc_id", "term_id"], 5,
                               lambda f, s, g, step: algebra.multiply_update(f, s, g), False)
    assert np.allclose(array(joined.factors["term_id"].table, "term_id"), w)


def test_a_sweep_is_one_shuffle(spark):
    """A move of the rows and the sums of the held factor: the cells are not shuffled again."""
    x = np.ones((4, 6))
    cells = entries(spark, x, "term_id", "doc_id")
    docs = replace(table(spark, "doc_id", np.ones((6, 2))), local=False)
    rows = passes.Rows(cells, docs, ["term_id"])
    seen = []
    monkey = passes.added

    def added(sums, rank, size):
        keyed = sums.where("key is not null").groupBy("key").agg(F.sum(F.col("b")[0]))
        plan = keyed._jdf.queryExecution().executedPlan().toString()
        seen.append(plan.count("Exchange "))
        return monkey(sums, rank, size)

    passes.added = added
    try:
        for _ in range(3):
            rows.run({"term_id": np.ones((4, 2))}, "term_id", lambda u, b, g: u, np.eye(2))
    finally:
        passes.added = monkey
    # The exchange of an earlier sweep is behind the cache.
    assert [n for n in seen] == [1, 1, 1]


def test_online_steps_in_passes_equal_steps_in_joins(spark):
    random = np.random.default_rng(6)
    x = random.random((12, 20)) * (random.random((12, 20)) < 0.5)
    slices = [(entries(spark, x, "term_id", "pos"), 20)] * 2
    start = random.random((12, 3))
    held = table(spark, "term_id", start)
    for fresh in (False, True):
        options = dict(iterations=4, batch_size=6, beta=0.7, alpha=0.1, seed=3, use_fresh_stats=fresh)
        one, _ = online.onmf_train(slices, held, **options)
        two, _ = online.onmf_train(slices, replace(held, local=False), **options)
        assert np.allclose(array(one.terms.table, "term_id"), array(two.terms.table, "term_id"))
        assert np.allclose(one.a, two.a) and one.t == two.t
        assert np.allclose(array(one.b, "term_id", "b"), array(two.b, "term_id", "b"))


def test_held_factors_count_from_zero(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "v int, u array<double>")
    with pytest.raises(ValueError, match="0 … 1"):
        passes.dense(Factor(rows, "v", 2, 1))


# -- sketches -----------------------------------------------------------------


def test_a_sketch_estimates_gram_and_products(spark):
    random = np.random.default_rng(8)
    t, v, x = random.random((6, 3)), random.random((40, 3)), random.random((6, 40, 5))
    cells, factors = cells3(spark, x), [table(spark, "t", t), table(spark, "v", v)]
    product = np.einsum("ir,jr->ijr", t, v).reshape(-1, 3)
    sums, gs = coding.sketch(cells, factors, "d", 4, sweeps=300, seed=1)
    assert gs.shape == (300, 3, 3)
    # One row in four: a quarter of the whole on average, and never the same draw.
    assert np.allclose(4 * gs.mean(axis=0), product.T @ product, rtol=0.05)
    assert len({g.tobytes() for g in gs}) == 300
    bs = {r.d: np.array(r.bs).mean(axis=0) for r in sums.collect()}
    whole = x.transpose(2, 0, 1).reshape(5, -1) @ product
    assert all(np.allclose(4 * bs[d], whole[d], rtol=0.05) for d in range(5))


def test_the_error_of_codes_falls_with_the_ratio(spark):
    dense, (t, v, d) = planted((8, 60, 12), 3, seed=9)
    cells, factors = cells3(spark, dense), [table(spark, "t", t), table(spark, "v", v)]
    rows = spark.range(12).select(F.col("id").cast("int").alias("d"))
    product = np.einsum("ir,jr->ijr", t, v).reshape(-1, 3)
    x = dense.transpose(2, 0, 1).reshape(12, -1)

    def error(ratio):
        found = []
        for seed in range(4):
            h = array(coding.cp_codes(cells, factors, "d", rows, sweeps=30, seed=seed, subsample_ratio=ratio), "d", "h")
            found.append(np.linalg.norm(x - h @ product.T) / np.linalg.norm(x))
        return np.mean(found)

    errors = [error(r) for r in (120, 12, None)]
    assert errors[0] > errors[1] > errors[2]


def test_sketched_training_lowers_the_error(spark):
    dense, _ = planted((5, 20, 9), 2, seed=3)
    cells = cells3(spark, dense)
    start = {a: f for a, f in factorise.init_factors(spark, {"t": 5, "v": 20, "d": 9}, 2, 1).items()}
    before = factorise.reconstruction_error(cells, start)[1]
    fit = factorise.cp_als(cells, start, 6, subsample_ratio=2, with_trace=True, seed=5)
    after = factorise.reconstruction_error(cells, fit.factors)[1]
    assert after < 0.5 * before and len(fit.trace) == 6
    far = factorise.cp_als(cells, start, 1, subsample_ratio=2, beta=1.0, radius_const=1e-6, seed=5)
    assert np.allclose(array(far.factors["t"].table, "t"), array(start["t"].table, "t"), atol=1e-4)
    two = {a: start[a] for a in ("t", "v")}
    state = online.ocpd_train(cells, two, "d", 9, 6, 5, 0.7, subsample_ratio=3, seed=2)
    assert all(np.isfinite(array(f.table, a)).all() for a, f in state.factors.items())


def test_a_sketch_needs_a_ratio_of_one_or_more(spark):
    with pytest.raises(ValueError, match="ratio"):
        coding.sketch(None, [], "d", 0)


# -- trials -------------------------------------------------------------------


def test_trials_do_not_depend_on_the_pool(spark):
    dense, _ = planted((4, 9, 7), 2, seed=6)
    cells, dims = cells3(spark, dense), {"t": 4, "v": 9, "d": 7}
    runs = (
        [dict(method="mu", rank=r) for r in (1, 2)]
        + [dict(method="als", beta=b, sweeps=2) for b in (None, 0.5)]
        + pool.grid(method=["online"], alpha=[0.0, 0.1], beta=[0.5, 1.0], batch_size=[3])
    )
    assert len(runs) == 8 and runs[5] == dict(method="online", alpha=0.0, beta=1.0, batch_size=3)
    key = ["run", "trial", "iter"]
    found = []
    for workers, order in ((1, runs), (5, runs)):
        rows = trials.learner_trials(cells, dims, order, 2, 3, workers).orderBy(*key).collect()
        found.append([(r.method, r.run, r.trial, r.iter, round(r.error, 9)) for r in rows])
        assert len(rows) == 8 * 2 * 2 and all(r.elapsed > 0 for r in rows)
    assert found[0] == found[1]
    # The order of the runs changes their numbers only.
    back = trials.learner_trials(cells, dims, runs[::-1], 2, 3, 3).collect()
    turned = sorted((7 - r.run, r.trial, r.iter, r.method, round(r.error, 9)) for r in back)
    assert turned == sorted((run, trial, i, m, e) for m, run, trial, i, e in found[0])


def test_jobs_run_side_by_side_and_in_order(spark):
    barrier = threading.Barrier(3, timeout=60)

    def job(k):
        def run():
            n = spark.range(10 + k).count()
            barrier.wait()
            return n, spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        return run

    found = pool.run_all(spark, [job(k) for k in range(6)], 3)
    assert [n for n, _ in found] == [10, 11, 12, 13, 14, 15] and {p for _, p in found} == {"trial-0", "trial-1", "trial-2"}
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_a_failed_trial_stops_the_others(spark):
    begun = []

    def slow(k):
        def run():
            begun.append(k)
            return spark.range(2).select(F.expr("java_method('java.lang.Thread', 'sleep', 60000L)")).count() if k else 1 / 0
        return run

    start = time.monotonic()
    with pytest.raises(ZeroDivisionError):
        pool.run_all(spark, [slow(k) for k in range(6)], 2)
    assert time.monotonic() - start < 50 and len(begun) <= 3


def test_a_sweep_keeps_its_parameters(spark):
    out = pool.sweep(spark, lambda a, b: spark.range(a).select((F.col("id") + b).alias("n")), 2, a=[1, 2], b=[10, 20])
    assert sorted(tuple(r) for r in out.collect()) == [
        (1, 10, 10), (1, 20, 20), (2, 10, 10), (2, 10, 11), (2, 20, 20), (2, 20, 21),
    ]


def test_windows_of_a_turn_read_their_own_slices(spark, monkeypatch):
    dense, _ = planted((12, 7, 5), 2, seed=5)
    cells, read = cells3(spark, dense), []
    real = online.sample_time_patches

    def seen(part, *args):
        read.append({r.t for r in part.select("t").distinct().collect()})
        return real(part, *args)

    monkeypatch.setattr(online, "sample_time_patches", seen)
    start = factorise.init_factors(spark, {"t": 3, "v": 7, "d": 5}, 2, 1)
    state = online.ocpd_train_windows(cells, 12, 3, 2, start, 3, 3, 0.7, seed=4)
    assert len(read) == 3 and all(3 <= len(r) <= 6 for r in read) and len(set().union(*read)) > 3
    assert {a: array(f.table, a).shape for a, f in state.factors.items()} == {"t": (3, 2), "v": (7, 2), "d": (5, 2)}
    again = online.ocpd_train_windows(cells.repartition(3), 12, 3, 2, start, 3, 3, 0.7, seed=4)
    assert np.allclose(array(state.factors["v"].table, "v"), array(again.factors["v"].table, "v"))
    # A turn goes on from the one before.
    first = online.ocpd_train_windows(cells, 12, 3, 2, start, 1, 3, 0.7, seed=4)
    assert not np.allclose(array(first.factors["v"].table, "v"), array(state.factors["v"].table, "v"))


def scratch(spark):
    """Folders of the tables that are in the scratch folder now."""
    return set(Path(checkpoint_dir(spark).removeprefix("file:")).glob("driftloom/*/*"))


def test_a_pass_keeps_no_cells(spark):
    """Moves are made anew: no cell is cached, and rows written anew replace those before."""
    def one_sweep(u, b, g):
        return coding.sweep_array(u, b, g, 1)

    random = np.random.default_rng(1)
    u, w, x = random.random((7, 2)), random.random((4, 2)), random.random((7, 4)) * (random.random((7, 4)) < 0.6)
    before, cached = scratch(spark), spark.sparkContext._jsc.getPersistentRDDs().size()
    rows = passes.Rows(entries(spark, x, "d", "v"), replace(table(spark, "d", u), local=False), ["v"])
    for _ in range(2 * passes.KEPT + 1):
        g = w.T @ w
        found = rows.run({"v": w}, "v", one_sweep, g)
        u = one_sweep(u, x @ w, g)
        assert np.allclose(found.axis, x.T @ u) and np.allclose(found.gram, u.T @ u)
        assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached
        w = w + found.axis
    assert np.allclose(array(rows.result().table, "d"), u)
    assert len(scratch(spark) - before) == 1


def test_release_removes_what_was_stored_only(spark):
    left = stored(spark.range(3), "one")
    derived = left.where("id > 0")
    before = scratch(spark)
    release(derived, spark.range(3), None)
    assert scratch(spark) == before and derived.count() == 2
    release(left)
    assert len(before - scratch(spark)) == 1


def test_starts_leave_no_tables_in_between(spark):
    x, _ = planted((6, 8), 2)
    terms, docs = (replace(table(spark, a, np.ones((n, 2)) + np.eye(n, 2)), local=False) for a, n in (("v", 8), ("n", 6)))
    cells = entries(spark, x, "n", "v")
    before = scratch(spark)
    factorise.nndsvd_init(cells, terms, docs, 4)
    # Vectors of both sides and the two factors.
    assert len(scratch(spark) - before) == 4


def test_training_leaves_no_tables_in_between(spark):
    x, _ = planted((6, 8), 2)
    terms = replace(table(spark, "v", np.ones((8, 2)) + np.eye(8, 2)), local=False)
    cells = entries(spark, x, "pos", "v")
    before = scratch(spark)
    online.onmf_train([(cells, 6)] * 3, terms, [0, 2], iterations=4, batch_size=3)
    # The dictionary asked for, and the last state.
    assert len(scratch(spark) - before) == 3


def test_a_window_of_slices_is_not_cached(spark, monkeypatch):
    """Only the patch that was drawn is kept; the window is read once."""
    kept, frame = [], type(spark.range(0))
    persist = frame.persist
    monkeypatch.setattr(frame, "persist", lambda self, *a: kept.append(self.columns) or persist(self, *a))
    factors = {a: table(spark, a, np.random.default_rng(n).random((n, 2))) for a, n in (("t", 2), ("v", 3), ("d", 2))}
    cells = cells3(spark, planted((3, 3, 4), 2)[0])
    online.ocpd_window(cells, 0, 0, 4, factors, None, 2, 2, 1, 2)
    assert kept == [["t", "v", "d", "draw", "x"]]


def test_trials_gather_the_cells_of_a_long_axis_once(spark, monkeypatch):
    for module in (algebra, trials):
        monkeypatch.setattr(module, "MODEL_CELLS", 10)
    cells, seen, gather = cells3(spark, planted((3, 9, 4), 2)[0]), [], passes.gather
    for module in (trials, passes):
        monkeypatch.setattr(module, "gather", lambda *a: seen.append(1) or gather(*a), raising=False)
    runs = [dict(method="mu", iterations=1), dict(method="als", iterations=1, sweeps=2)]
    rows = trials.learner_trials(cells, {"t": 3, "v": 9, "d": 4}, runs, workers=2).collect()
    assert len(rows) == 2 and len(seen) == 1


def test_a_sketch_does_not_count_its_draws(spark, monkeypatch):
    """Draws are met by the cells as they come: one drawn twice weighs twice, and none is grouped."""
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (2, 1, 4.0)], "a int, d int, x double")
    factor = algebra.init_factor(algebra.axis_index(spark, "a", 3), "a", 3, 1, 3)
    monkeypatch.setattr(F, "count", lambda *_: pytest.fail("draws are counted"))
    sums, gs = coding.sketch(cells, [factor], "d", 1, 2, 5)
    u = {r.a: r.u[0] for r in factor.table.collect()}
    index = hash_int(F.lit("a"), F.floor(F.col("id") / 3), F.col("id") % 3, 5) % 3
    drawn = [(r.id // 3, r.a) for r in spark.range(6).select("id", index.alias("a")).collect()]
    found = {r.d: r.bs for r in sums.collect()}
    for turn in (0, 1):
        own = [a for t, a in drawn if t == turn]
        assert gs[turn][0, 0] == pytest.approx(sum(u[a] ** 2 for a in own))
        for d, values in ((0, {0: 1.0, 1: 2.0}), (1, {2: 4.0})):
            expected = sum(u[a] * values.get(a, 0.0) for a in own)
            assert (found[d][turn][0] if d in found else 0.0) == pytest.approx(expected)


def test_singular_vectors_are_settled(spark):
    """Values that lie close to each other need many steps: few of them must not be all that is done."""
    random = np.random.default_rng(21)
    u, v = (np.linalg.qr(random.standard_normal((n, 40)))[0] for n in (60, 50))
    x = (u * np.linspace(1.0, 0.8, 40)) @ v.T
    cells = entries(spark, x, "term_id", "doc_id")
    for rows, columns in ((60, 50), (50, 60)):
        a, b = ("term_id", "doc_id") if rows == 60 else ("doc_id", "term_id")
        start = factorise.init_factors(spark, {a: rows}, 3, 4)[a]
        left, right, values = factorise.leading_vectors(cells, start, [b], 2)
        l, s, rt = np.linalg.svd(x if rows == 60 else x.T)
        assert np.allclose(values, s[:3], rtol=1e-9)
        assert np.allclose(np.abs((array(left, a) * l[:, :3]).sum(axis=0)), 1.0)
        assert np.allclose(np.abs((array(right, b) * rt[:3].T).sum(axis=0)), 1.0)


def test_starts_of_all_unfoldings_are_their_singular_vectors(spark):
    random = np.random.default_rng(22)
    dense = random.random((4, 45, 36)) * (random.random((4, 45, 36)) < 0.3)
    t, v, d = np.nonzero(dense)
    rows = [(int(a), int(b), int(c), float(dense[a, b, c])) for a, b, c in zip(t, v, d)]
    cells = spark.createDataFrame([*rows, (None, 1, 1, 5.0)], "t int, v int, d int, x double")
    before = scratch(spark)
    start = factorise.cp_svd_init(cells, factorise.init_factors(spark, {"t": 4, "v": 45, "d": 36}, 2, 5), 2)
    for mode, axis in enumerate("tvd"):
        expected = np.linalg.svd(np.moveaxis(dense, mode, 0).reshape(dense.shape[mode], -1))[0]
        assert np.allclose(array(start[axis].table, axis), np.abs(expected[:, :2]), atol=1e-7)
    assert len(scratch(spark) - before) == 3


def test_singular_vectors_of_sides_too_long_to_be_held(spark, monkeypatch):
    monkeypatch.setattr(singular, "MODEL_CELLS", 5)
    random = np.random.default_rng(23)
    x = planted((8, 9), 2, 23)[0] + 0.001 * random.random((8, 9))
    start = replace(table(spark, "v", random.random((8, 2))), local=False)
    left, right, values = factorise.leading_vectors(entries(spark, x, "v", "d"), start, ["d"], 1)
    l, s, rt = np.linalg.svd(x)
    assert np.allclose(values, s[:2], rtol=1e-6)
    assert np.allclose(np.abs((array(left, "v") * l[:, :2]).sum(axis=0)), 1.0, atol=1e-6)
    assert np.allclose(np.abs((array(right, "d") * rt[:2].T).sum(axis=0)), 1.0, atol=1e-6)


def test_starts_of_no_cells_are_zero(spark):
    cells = spark.createDataFrame([], "term_id int, doc_id bigint, x double")
    terms, docs = (table(spark, a, np.ones((n, 2))) for a, n in (("term_id", 3), ("doc_id", 2)))
    w, h = factorise.nndsvd_init(cells, terms, docs)
    assert not array(w.table, "term_id").any() and not array(h.table, "doc_id").any()


def test_learners_leave_no_texts_on_disk(spark, folder):
    """The entries stand for the counts, and no table in between stays; one that is given up is made anew."""
    before, data = scratch(spark), corpus(spark, folder)
    rows = data.entries.count()
    made = scratch(spark) - before
    assert sorted(p.name for p in made) == ["entries", "vocabulary"]
    assert all(".zstd." in f.name for p in made for f in p.glob("*.parquet"))
    assert data.counts.count() == data.weights.count() == rows


def test_weights_per_slice_leave_no_texts_on_disk(spark, folder):
    before = scratch(spark)
    assert tables_and_topics.tfidf_per_slice(spark, folder).count() > 0
    assert sorted(p.name for p in scratch(spark) - before) == ["idfs", "numbered", "vocabulary"]


def test_written_aggregates_replace_the_cells(spark, folder):
    before = scratch(spark)
    assert queries.cp_mttkrp_agg(spark, folder).count() > 0
    names = [p.name for p in scratch(spark) - before]
    assert "cells" not in names and "counts" not in names and names.count("sums") == 1


def test_writing_removes_the_files_of_shuffles(spark, monkeypatch):
    monkeypatch.setattr(session, "LONG_WRITE", 0.0)
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def shuffles():
        return {p.name.split("_")[1] for d in folders for p in Path(d).rglob("shuffle_*.data")}

    before = shuffles()
    for _ in range(8):
        stored(spark.range(1000).repartition(3, "id"), "dealt")
    # The last ones may still be known to the scheduler.
    for _ in range(50):
        if len(shuffles() - before) <= 4:
            break
        time.sleep(0.1)
    assert len(shuffles() - before) <= 4
