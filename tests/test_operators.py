import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from driftloom.operators import joins, numbering, ranking, sampling, series, tensor, topics, vocabulary
from driftloom.operators.vectoriser import TermVectoriser


def hot(spark, rows=3000):
    """A third of the rows belongs to group 0."""
    group = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17)
    return spark.range(rows).select(F.col("id"), group.cast("int").alias("g"))


def test_number_rows_over_all_rows_and_groups(spark):
    df = hot(spark)
    numbered = numbering.number_rows(df, ["id"]).collect()
    assert all(r.id == r.pos for r in numbered) and len(numbered) == 3000
    by_group = {}
    for r in numbering.number_rows(df, ["id"], ["g"]).orderBy("g", "id").collect():
        assert r.pos == by_group.get(r.g, 0)
        by_group[r.g] = r.pos + 1


def test_number_rows_keeps_null_groups(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, g string")
    rows = {(r.id, r.pos) for r in numbering.number_rows(df, ["id"], ["g"]).collect()}
    assert rows == {(1, 0), (2, 1), (3, 0)}


def test_top_n_per_group_salted_equals_plain(spark):
    df = hot(spark)
    plain = numbering.top_n_per_group(df, ["g"], [F.desc("id")], 50).collect()
    spark.conf.set(numbering.GROUP_LIMIT_SETTING, "10")
    salted = numbering.top_n_per_group(df, ["g"], [F.desc("id")], 50)
    rows = sorted(salted.collect())
    spark.conf.unset(numbering.GROUP_LIMIT_SETTING)
    assert salted.columns == ["id", "g", "rank"]
    assert rows == sorted(plain)


def test_sample_exact_n_takes_the_smallest_hashes(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    hashed = df.select("k", sampling.hash_text("k", 3).alias("h")).orderBy("h", "k")
    for n in (0, 1, 700, 4999, 5000, 9000):
        drawn = sampling.sample_exact_n(df.repartition(7), n, "k", 3)
        assert drawn.columns == ["k"]
        assert {r.k for r in drawn.collect()} == {r.k for r in hashed.limit(n).collect()}


def test_subset_by_position(spark):
    evens = spark.range(0, 100, 2)
    positions = spark.createDataFrame([(1,), (2,), (3,)], "pos bigint")
    assert sorted(r.id for r in sampling.subset_by_position(evens, positions, ["id"]).collect()) == [2, 4, 6]


def test_short_groups(spark):
    df = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(7)], "k int, g string")
    count = lambda mode: sampling.sample_n_per_group(df, "g", 3, "k", short_groups=mode).groupBy("g").count().orderBy("g").collect()
    assert [tuple(r) for r in count("keep")] == [("a", 3), ("b", 2)]
    assert [tuple(r) for r in count("drop")] == [("a", 3)]
    with pytest.raises(PySparkException):
        count("error")


def test_minibatch_keeps_repeats(spark):
    numbered = numbering.number_rows(spark.range(5), ["id"])
    drawn = sampling.minibatch_with_replacement(numbered, 2, 40, 5)
    assert drawn.count() == 80 and drawn.select("id").distinct().count() <= 5


def test_to_proportion(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], ["k", "x"])
    shares = series.to_proportion(df, [], "x").orderBy("k").collect()
    assert [r.share for r in shares] == [0.0, 0.1, 0.2, 0.3, 0.4]
    with pytest.raises(Exception, match="negative value"):
        series.to_proportion(df.withColumn("x", -F.col("x")), [], "x").collect()


def ramp(spark):
    return spark.createDataFrame([(i // 6, i % 6, float(i)) for i in range(24)], "a int, b int, x double")


def test_sliding_average_along_both_axes(spark):
    rows = series.sliding_average(ramp(spark), "a", "b", "x", 5).orderBy("a", "b").collect()
    assert [r.average for r in rows] == [2.0, 3.0, 8.0, 9.0, 14.0, 15.0, 20.0, 21.0]
    rows = series.sliding_average(ramp(spark), "b", "a", "x", 2).orderBy("a", "b").collect()
    assert [r.average for r in rows] == [float(v) for v in (*range(3, 9), *range(9, 15), *range(15, 21))]
    with pytest.raises(ValueError):
        series.sliding_average(ramp(spark), "a", "b", "x", 10)


def test_sliding_average_over_chunks(spark, monkeypatch):
    values = np.random.default_rng(0).random(200)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "s string, i int, x double")
    monkeypatch.setattr(series, "CHUNK", 16)
    got = [r.average for r in series.sliding_average(df, "s", "i", "x", 7).orderBy("i").collect()]
    assert np.allclose(got, np.convolve(values, np.ones(7) / 7, "valid"))


def test_resample_trace_equals_interpolation(spark):
    random = np.random.default_rng(1)
    rows, curves = [], {}
    for trial in range(3):
        times = np.cumsum(random.random(12) + 0.01)
        errors = random.random(12)
        curves[str(trial)] = times, errors
        rows += [("m", str(trial), i, float(t), float(e)) for i, (t, e) in enumerate(zip(times, errors))]
    trace = spark.createDataFrame(rows, "method string, trial string, iter int, elapsed double, error double")
    grid = np.linspace(0, max(t[-1] for t, _ in curves.values()), 101)
    grid = grid[grid < min(t[-1] for t, _ in curves.values())]
    got = {}
    for r in series.resample_trace(trace).collect():
        got.setdefault(r.trial, {})[r.grid] = r.y
    lines = []
    for trial, (times, errors) in curves.items():
        line = np.interp(grid, times, errors)
        early = grid < times[0]
        line[early] = errors[0] + (grid[early] - times[0]) * (errors[1] - errors[0]) / (times[1] - times[0])
        assert sorted(got[trial]) == list(range(len(grid)))
        assert np.allclose([got[trial][i] for i in range(len(grid))], line)
        lines.append(line)
    band = series.error_band(series.resample_trace(trace)).orderBy("grid").collect()
    assert np.allclose([r.mean_error for r in band], np.mean(lines, axis=0))
    assert np.allclose([r.std_error for r in band], np.std(lines, axis=0))


def test_condense_keywords(spark):
    maps = [{"a": 1, "b": 3, "a b": 2}, {"b": 1, "a c": 1, "c": 5}, {"a": 1, "b": 1, "c": 1}]
    rows = [(i, t, float(w)) for i, m in enumerate(maps) for t, w in m.items()]
    out = topics.condense_keywords(spark.createDataFrame(rows, "topic int, term string, w double")).collect()
    got = [{r.term: r.w for r in out if r.topic == i} for i in range(3)]
    assert got == [{"a": 0, "b": 0, "a b": 3}, {"b": 1, "a c": 1, "c": 5}, {"a": 1, "b": 1, "c": 1}]


def test_condense_drops_terms_without_letters(spark):
    df = spark.createDataFrame([(0, "2020", 5.0), (0, "flu", 1.0)], "topic int, term string, w double")
    assert {r.term: r.w for r in topics.condense_keywords(df).collect()} == {"2020": 0.0, "flu": 1.0}


def test_labels_and_shares(spark):
    df = spark.createDataFrame([(0, t, w) for t, w in zip("abcd", (4.0, 3.0, 2.0, 1.0))], "topic int, term string, w double")
    assert topics.topic_labels(df).first().label == "a, b, c: 0"
    shares = {r.term: r.share for r in topics.keyword_shares(df, 2, 4).collect()}
    assert shares == {"a": 4 / 7, "b": 3 / 7}
    with pytest.raises(ValueError):
        topics.keyword_shares(df, 5, 4)
    words = sampling.sample_topic_words(topics.keyword_shares(df, 3), 300).collect()
    assert sum(r.n for r in words) == 300 and {r.term for r in words} == {"a", "b", "c"}


def test_select_vocabulary(spark):
    stats = spark.createDataFrame([(f"w{i % 50:02d}", (i * 7) % 11 + 1, i % 5 + 1) for i in range(50)], "term string, n bigint, df bigint")
    want = sorted(stats.where("df >= 2").collect(), key=lambda r: (-r.n, r.term))[:20]
    got = vocabulary.select_vocabulary(stats, 10, 20, 2).orderBy("term_id").collect()
    assert [(r.term_id, r.term) for r in got] == list(enumerate(sorted(r.term for r in want)))
    assert vocabulary.select_vocabulary(stats, 10, None, 2).count() == stats.where("df >= 2").count()


def test_top_k_counts_ties_nulls_and_copies(spark):
    rows = [("b", 1.0), ("a", None), ("c", 3.0), ("c", 3.0), ("d", 1.0), (None, 2.0), ("e", None)]
    df = spark.createDataFrame(rows, "key string, score double")
    want = [("c", 3.0), ("c", 3.0), (None, 2.0), ("d", 1.0), ("b", 1.0), ("e", None), ("a", None)]
    for k in (1, 4, 6, 100):
        assert [tuple(r) for r in ranking.top_k_records(df, k, "score", "key").collect()] == want[:k]
    assert [tuple(r) for r in ranking.top_k_records(df, 3, "score", "key", distinct=True).collect()] == want[1:4]


def test_folds_and_unfoldings(spark):
    n = spark.range(12).select(F.col("id").alias("n"))
    t, d = tensor.fold_blocks(F.col("n"), 4)
    assert [(r[0], r[1]) for r in n.orderBy("n").select(t, d).collect()] == [(i // 4, i % 4) for i in range(12)]
    t, d = tensor.fold_round_robin(F.col("n"), 5)
    assert [(r[0], r[1]) for r in n.orderBy("n").select(t, d).collect()] == [(i % 5, i // 5) for i in range(12)]
    dense = np.random.default_rng(2).random((2, 3, 4))
    cells = spark.createDataFrame(
        [(int(i), int(j), int(k), float(dense[i, j, k])) for i, j, k in np.ndindex(2, 3, 4)],
        "t int, v int, d int, x double",
    )
    for mode, axis in enumerate("tvd"):
        matrix = np.zeros((dense.shape[mode], dense.size // dense.shape[mode]))
        for r in tensor.unfold_mode(cells, axis, {"t": 2, "v": 3, "d": 4}).collect():
            matrix[r.row, r.col] = r.x
        assert np.array_equal(matrix, np.moveaxis(dense, mode, 0).reshape(dense.shape[mode], -1))


def test_windows_of_slices(spark):
    slices = spark.range(23).select(F.col("id").cast("int").alias("t"))
    for length, slide in [(5, 5), (6, 4), (3, 7)]:
        got = sorted((r.window_start, r.t) for r in joins.range_window_slices(slices, 23, length, slide).collect())
        starts = range(0, 23 - length + 1, slide)
        assert got == [(s, t) for s in starts for t in range(s, s + length)]


def test_sweep_keeps_parameters(spark):
    out = joins.sweep(spark, lambda low, k: spark.range(low, low + k), low=[0, 5], k=[1, 2])
    assert sorted(map(tuple, out.collect())) == [(0, 1, 0), (0, 2, 0), (0, 2, 1), (5, 1, 5), (5, 2, 5), (5, 2, 6)]


def test_synthetic_tensor_sums_all_components(spark):
    random = np.random.default_rng(3)
    arrays = {a: random.random((n, 3)) for a, n in (("i", 2), ("j", 3), ("k", 4))}
    tables = {a: spark.createDataFrame([(i, u.tolist()) for i, u in enumerate(m)], f"{a} int, u array<double>") for a, m in arrays.items()}
    out = np.zeros((2, 3, 4))
    for r in tensor.cp_synthetic_tensor(spark, tables, {"i": 2, "j": 3, "k": 4}, 3).collect():
        out[r.i, r.j, r.k] = r.x
    assert np.allclose(out, np.einsum("ir,jr,kr->ijk", *arrays.values()))


def test_equal_tables_are_compared_by_blocks_only(spark):
    rows = spark.range(3000).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS x")
    mixed = rows.orderBy("x", F.desc("id")).repartition(5)
    blocks = tensor.differing_blocks(rows, mixed, ["id"], ["id", "x"]).collect()
    assert all(r["_same"] for r in blocks) and sum(r["_n"] for r in blocks) == 3000
    assert tensor.matrix_equal(rows, mixed, ["id"]).collect() == [(3000, 0)]
    assert tensor.vocabulary_equal(rows, mixed).collect() == [(0, 0)]
    # A row more, one less and one changed: in three blocks at most, and found there.
    other = mixed.where("id <> 5").withColumn("x", F.when(F.col("id") == 9, -1.0).otherwise(F.col("x"))).union(
        spark.createDataFrame([(4000, 2.0)], "id long, x double")
    )
    apart = [r for r in tensor.differing_blocks(rows, other, ["id"], ["id", "x"]).collect() if not r["_same"]]
    assert 1 <= len(apart) <= 3
    assert tensor.matrix_equal(rows, other, ["id"]).collect() == [(3001, 3)]
    assert tensor.vocabulary_equal(rows, other).collect() == [(2, 2)]


def test_compared_tables_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(50).selectExpr("id", "CAST(id AS DOUBLE) AS x")
    left = rows.mapInArrow(count, "id bigint, x double")
    assert tensor.matrix_equal(left, rows.withColumn("x", F.col("x") + 1), ["id"]).collect() == [(50, 50)]
    assert seen.value == 50


def test_repeated_rows_and_empty_tables_differ(spark):
    one = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "term string")
    two = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "term string")
    assert tensor.vocabulary_equal(one, two).collect() == [(1, 1)]
    assert tensor.vocabulary_equal(one, one.limit(0)).collect() == [(4, 0)]
    none = spark.createDataFrame([], "id long, x double")
    assert [tuple(r) for r in tensor.matrix_equal(none, none, ["id"]).collect()] == [(0, 0)]
    cells = spark.createDataFrame([(1, 0.0), (2, 3.0)], "id long, x double")
    assert [tuple(r) for r in tensor.matrix_equal(cells, none, ["id"]).collect()] == [(2, 1)]


@pytest.mark.parametrize("weighting", ["counts", "tfidf"])
def test_a_vectoriser_is_a_stage_that_can_be_saved(spark, tmp_path, weighting):
    rows = [("a", "tea pot tea"), ("b", "pot lid"), ("c", None), (None, "tea"), ("d", "unseen words")]
    docs = spark.createDataFrame(rows, "key string, body string")
    stage = TermVectoriser(inputCol="body", outputCol="cells", idCol="key", maxNgram=1, maxFeatures=3, weighting=weighting)
    stage.write().save(str(tmp_path / "stage"))
    stage = TermVectoriser.load(str(tmp_path / "stage"))
    assert stage.getInputCol() == "body" and stage.getOrDefault("maxFeatures") == 3
    model = Pipeline(stages=[stage]).fit(docs.where("body not like 'unseen%'"))
    model.write().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    first, again = (
        {r.key: [tuple(c) for c in r.cells] for r in m.transform(docs).collect()} for m in (model, loaded)
    )
    assert first == again and first["c"] == first["d"] == []
    # Terms in order: lid, pot, tea.
    if weighting == "counts":
        assert first == {"a": [(1, 1.0), (2, 2.0)], "b": [(0, 1.0), (1, 1.0)], "c": [], None: [(2, 1.0)], "d": []}
    else:
        assert first[None] == [(2, 1.0)] and np.isclose(sum(x * x for _, x in first["a"]), 1.0)
    assert loaded.transform(docs).columns == ["key", "body", "cells"]


def test_a_vectoriser_knows_its_weightings(spark):
    with pytest.raises(ValueError, match="weighting"):
        TermVectoriser(weighting="other").fit(spark.createDataFrame([(1, "a")], "doc_id long, text string"))


def test_runs_of_terms_are_counted_as_strings(spark):
    # ". ." is one token and also two; a list without terms has no rows.
    docs = spark.createDataFrame(
        [(1, "x", [". .", ".", "."]), (2, "x", [".", ". ."]), (3, None, []), (4, "y", None), (5, "y", ["a"])],
        "doc_id int, source string, terms array<string>",
    )
    found = vocabulary.counts_in_documents(docs, max_len=2)
    assert found.columns == ["doc_id", "source", "term", "n"]
    assert sorted(tuple(r) for r in found.collect()) == [
        (1, "x", ".", 2), (1, "x", ". .", 2), (1, "x", ". . .", 1),
        (2, "x", ".", 1), (2, "x", ". .", 1), (2, "x", ". . .", 1), (5, "y", "a", 1),
    ]


def test_documents_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(vocabulary, "TERMS_AT_ONCE", 3)
    lists = [["a", "b"], None, ["a"], ["a", "b", "a", "b", "a"], [], ["b"]]
    batch = pa.record_batch([pa.array(range(6)), pa.array(lists, pa.list_(pa.string()))], names=["doc_id", "_terms"])
    parts = list(vocabulary._counted([batch], 2))
    assert [p.num_rows for p in parts] == [3, 1, 2]
    rows = {r["doc_id"]: {c["term"]: c["n"] for c in r["_counts"]} for p in parts for r in p.to_pylist()}
    assert rows == {0: {"a": 1, "b": 1, "a b": 1}, 1: {}, 2: {"a": 1}, 3: {"a": 3, "b": 2, "a b": 2, "b a": 2}, 4: {}, 5: {"b": 1}}


def test_joins_hash_a_table_whose_shares_fit(spark):
    def plan(rows):
        small = spark.range(rows).select(F.col("id").alias("k"))
        return spark.range(10).withColumnRenamed("id", "k").join(joins.hashed(small, rows), "k")._jdf.queryExecution().toString()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "ShuffledHashJoin" in plan(joins.FEW_ROWS + 1)
    assert "ShuffledHashJoin" not in plan(parts * joins.TASK_ROWS + 1)
