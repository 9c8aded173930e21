import gzip
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftloom.functions import records
from driftloom.plans import pipelines
from driftloom.sources import scan, store

TEXTS = ["Hello my friend, how are you?", "My dog ate my homework. Sorry it is late.", "foo", "Hi!"]


def write_gz(path, lines):
    with gzip.open(path, "wt", encoding="utf-8") as file:
        file.write("".join(line + "\n" for line in lines))


@pytest.fixture
def line_files(tmp_path):
    for n in (1, 2):
        write_gz(tmp_path / f"file{n}.gz", [f"file {n} line 1", f"file {n} line 2"])
    return str(tmp_path)


@pytest.fixture
def tweet_files(tmp_path):
    paths = []
    for n in range(3):
        rows = [{"full_text": t, "lang": "en"} for t in TEXTS]
        rows += [{"full_text": t, "lang": "en", "retweeted_status": {"full_text": t}} for t in TEXTS]
        rows += [{"full_text": "bonjour", "lang": "fr"}, {"full_text": "no language"}]
        paths.append(str(tmp_path / f"test_tweets{n}.jsonl.gz"))
        write_gz(paths[-1], [json.dumps(r) for r in rows])
    return paths


def test_lines_can_be_read_again(spark, line_files):
    lines = scan.scan_lines(spark, line_files)
    expected = [f"file {n} line {m}" for n in (1, 2) for m in (1, 2)]
    for _ in range(2):
        assert sorted(r.value for r in lines.collect()) == expected
    assert lines.count() == 4
    assert [r.n_lines for r in scan.count_lines(lines).collect()] == [2, 2]


def test_json_records_and_malformed_lines(spark, tmp_path):
    write_gz(tmp_path / "tweets1.jsonl.gz", [json.dumps({"full_text": f"Text of tweet {i}"}) for i in (0, 1)])
    good = scan.scan_json_records(scan.scan_lines(spark, str(tmp_path)), "full_text string")
    assert sorted(r.full_text for r in good.collect()) == ["Text of tweet 0", "Text of tweet 1"]
    write_gz(tmp_path / "bad.jsonl.gz", ["{not json"])
    lines = scan.scan_lines(spark, str(tmp_path))
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        scan.scan_json_records(lines, "full_text string").collect()
    kept = scan.scan_json_records(lines, "full_text string, _corrupt_record string", "PERMISSIVE")
    assert [r._corrupt_record for r in kept.where("full_text IS NULL").collect()] == ["{not json"]


def test_presence_counts_null_values(spark):
    lines = spark.createDataFrame([('{"place": null}',), ('{"x": 1}',), ('{"place": {}}',), (None,)], ["value"])
    assert [r.p for r in lines.select(records.has_location("value").alias("p")).collect()] == [True, False, True, False]


def test_text_pipeline_counts(spark, tweet_files):
    one, three = tweet_files[0], tweet_files
    assert sorted(r.text for r in pipelines.text_pipeline(spark, one).collect()) == sorted(TEXTS)
    assert pipelines.text_pipeline(spark, one, include_reposts=True).count() == 8
    assert pipelines.text_pipeline(spark, three).count() == 12
    sampled = pipelines.text_pipeline(spark, three, num_samples=5)
    assert sampled.count() == 5 and sampled.collect() == sampled.collect()


def test_vocabulary_and_bags_per_file(spark, tweet_files):
    vocabulary = pipelines.vocabulary_per_file(spark, tweet_files)
    counts = {r.term: r.n for r in vocabulary.where(F.col("file").endswith("tweets0.jsonl.gz")).collect()}
    assert counts["dog"] == 1 and counts["dog ate"] == 1 and "my" not in counts
    index = vocabulary.select("term").distinct().withColumn("term_id", F.abs(F.hash("term")))
    docs, bag = pipelines.bags_per_file(spark, tweet_files, index, samples_per_file=2)
    assert [r["count"] for r in docs.groupBy("file").count().collect()] == [2, 2, 2]
    assert bag.join(docs, ["file", "doc_id"], "left_anti").count() == 0


NAMES = [
    "records-id-2020-03-01-00.txt", "records-id-2020-03-04-00.txt",
    "records-id-2020-03-02-00.txt", "records-id-2020-03-00-00.txt",
    "records-id-2020-02-04-00.txt", "hello",
]


@pytest.mark.parametrize("low, high, kept", [
    ("2020-03-00-00", "2020-03-02-00", [0, 2, 3]), (None, "2020-03-02-00", [0, 2, 3, 4]), ("2020-03-00-00", None, [0, 1, 2, 3]),
])
def test_in_range(spark, low, high, kept):
    names = spark.createDataFrame([(n,) for n in NAMES], ["name"])
    rows = names.where(scan.in_range(F.col("name"), low, high)).collect()
    assert sorted(r.name for r in rows) == sorted(NAMES[i] for i in kept)


def test_bad_bounds_are_an_error(spark):
    with pytest.raises(ValueError):
        scan.in_range(F.col("name"), "2020-03-01", None)


def test_files_in_range_are_chosen_by_name(spark, tmp_path):
    for name in NAMES:
        (tmp_path / name).write_text(name + "\n")
    rows = scan.scan_files_in_range(spark, str(tmp_path), "2020-03-00-00", "2020-03-02-00").collect()
    assert sorted(r.value for r in rows) == sorted(NAMES[i] for i in (0, 2, 3))


def test_headlines_drop_malformed_rows(spark, tmp_path):
    path = tmp_path / "news.csv"
    path.write_text('publish_date,headline_text\n20030219,"a ""b"", c"\n20030301,x,y\n20030302,plain\n')
    rows = scan.scan_headlines_csv(spark, str(path))
    assert sorted(map(tuple, rows.collect())) == [(20030219, 'a "b", c'), (20030302, "plain")]
    assert rows.select("publish_date").count() == 2


def test_run_tag_and_new_files(spark):
    assert store.run_tag(False, 2) == "vocab-retweets-False-ngrams-1-to-2"
    files = spark.createDataFrame([("t", h) for h in ("a", "b", "c")], ["tag", "date_hour"])
    done = spark.createDataFrame([("t", "b"), ("other", "c")], ["tag", "date_hour"])
    assert sorted(r.date_hour for r in store.new_files_only(files, done).collect()) == ["a", "c"]


def test_model_round_trip(spark, tmp_path):
    table = spark.createDataFrame([(0, [1.0, 2.0])], "term_id int, u array<double>")
    root = store.save_model({"w": table}, str(tmp_path / "model"))
    assert store.load_model(spark, root, ["w"])["w"].collect() == table.collect()


def test_steps_filter_and_map(spark):
    steps = records.Steps().add_filter(F.col("id") % 2 == 0).add_map(lambda df: df.select((F.col("id") * 4).alias("id")))
    assert [r.id for r in spark.range(10).transform(steps).orderBy("id").collect()] == [0, 8, 16, 24, 32]


def test_keep_keys(spark):
    row = spark.createDataFrame([(1, 2, 3)], ["a", "b", "c"])
    assert records.keep_keys(row, ["a", "b", "z"]).columns == ["a", "b"]
    kept = spark.range(1).select(records.keep_map_keys(F.create_map(F.lit("a"), F.lit(1), F.lit("c"), F.lit(3)), ["a", "z"]))
    assert kept.first()[0] == {"a": 1}


def test_language_predicates(spark):
    rows = spark.createDataFrame([("en",), ("fr",), (None,)], "lang string")
    assert rows.where(records.is_english("lang")).count() == 1
    assert rows.where(records.is_english_lenient("lang")).count() == 2


def test_guard_nonnegative(spark):
    rows = spark.createDataFrame([(0.0,), (-1e-8,), (2.0,)], ["x"])
    assert rows.select(records.guard_nonnegative("x")).count() == 3
    with pytest.raises(PySparkException):
        spark.createDataFrame([(-1.0,)], ["x"]).select(records.guard_nonnegative("x")).collect()


def test_record_functions_run_between_column_steps(spark):
    steps = (
        records.Steps()
        .add_record_filter(lambda r: r["id"] % 2 == 0)
        .add_record_map(lambda r: {"id": r["id"], "tags": [str(r["id"]), None]}, "id long, tags array<string>")
        .add_filter(F.col("id") > 2)
        .add_record_filter(lambda r: len(r["tags"]) == 2, "two tags")
        .add_record_filter(lambda r: r["id"] < 8)
    )
    out = spark.range(12).transform(steps)
    assert [(r.id, r.tags) for r in out.orderBy("id").collect()] == [(4, ["4", None]), (6, ["6", None])]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2
    typed = spark.sql("SELECT 1 AS a, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS t, struct(2 AS b) AS s UNION ALL SELECT NULL, NULL, NULL")
    kept = typed.transform(records.Steps().add_record_filter(lambda r: r["a"] is None or r["s"]["b"] == 2))
    assert kept.schema == typed.schema and kept.count() == 2
    assert spark.range(0).transform(steps).count() == 0


@pytest.mark.parametrize("add, message", [
    (lambda s: s.add_record_filter(lambda r: 1 / r["id"] > 0, "share"), "step 'share' failed: ZeroDivisionError"),
    (lambda s: s.add_record_filter(lambda r: r["id"]), "step '0: <lambda>': a filter gives True or False"),
    (lambda s: s.add_record_map(lambda r: {"x": 1}, "y long", "named"), "step 'named': a record of"),
    (lambda s: s.add_record_map(lambda r: {"y": "text"}, "y long", "kind"), "step 'kind':"),
])
def test_an_error_names_its_step(spark, add, message):
    with pytest.raises(Exception) as error:
        spark.range(3).transform(add(records.Steps())).collect()
    assert message in str(error.value)
