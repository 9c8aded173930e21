from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.learners import factorise
from driftloom.plans import streams as queries
from driftloom.streaming import streams
from driftloom.streaming.once import Once, run_once
from driftloom.streaming.runs import Runs, add_counts


def events(spark, *days):
    rows = [(datetime(2024, 1, d, h), f"w{h % 2}") for d in days for h in (1, 2, 3)]
    return spark.createDataFrame(rows, "ts timestamp, term string")


def test_days_past_the_delay_are_closed(spark, tmp_path):
    landing, checkpoint, out = (str(tmp_path / n) for n in ("in", "ck", "out"))
    schema = "ts timestamp, term string"

    def run():
        counts = streams.running_daily_counts(streams.read_stream(spark, landing, schema), "ts", "term", "1 day")
        streams.run_available(counts, checkpoint, each=streams.append_updates(out), mode="update")

    events(spark, 1, 10).write.mode("append").parquet(landing)
    run()
    events(spark, 1, 10).write.mode("append").parquet(landing)
    run()
    last = spark.read.parquet(out).groupBy("day", "term").agg(F.max("n").alias("n"))
    got = {(r.day.day, r.term): r.n for r in last.collect()}
    assert got == {(1, "w0"): 1, (1, "w1"): 2, (10, "w0"): 2, (10, "w1"): 4}


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_may_be_a_file_or_a_folder_of_files(spark, tmp_path, files):
    rows = [(i, "red apple" if i else "red", "en", "s", 9) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(files, "doc_id").write.parquet(str(tmp_path / "in" / "documents.parquet"))
    if files == 1:
        (part,) = (tmp_path / "in" / "documents.parquet").glob("*.parquet")
        (tmp_path / "one").mkdir()
        part.rename(tmp_path / "one" / "documents.parquet")
    folder = str(tmp_path / ("one" if files == 1 else "in"))
    assert {r.doc_id for r in queries.stream_clean_text(spark, folder).collect()} == set(range(6))
    assert {(r.term, r.n) for r in queries.stream_term_counts(spark, folder).collect()} >= {("red", 6), ("apple", 5)}


def test_tops_survive_a_replayed_batch(spark, tmp_path):
    versions = streams.Versions(spark, str(tmp_path))
    each = streams.merge_top_k(versions, "day", 2, "score", "id")
    batch = lambda *rows: spark.createDataFrame(rows, "day int, id int, score double")
    each(batch((0, 1, 5.0), (0, 2, 4.0), (0, 3, 3.0)), 0)
    late = batch((0, 4, 9.0), (1, 5, 1.0))
    each(late, 1)
    each(late, 1)
    rows = versions.read(1, "top").orderBy("day", "rank").collect()
    assert [(r.day, r.id, r["rank"]) for r in rows] == [(0, 4, 1), (0, 1, 2), (1, 5, 1)]


def test_sliding_windows_are_complete(spark):
    rows = [(datetime(2024, 1, d, 12),) for d in range(1, 31)]
    df = spark.createDataFrame(rows, "ts timestamp").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = streams.sliding_slices(df, "ts", "10 days", "5 days", "2024-01-01", "2024-01-31", "3 days")
    counts = [r["count"] for r in out.groupBy("slice_start").count().collect()]
    assert counts == [10] * 5


def test_windows_read_open_slices_only(spark, tmp_path):
    rng = np.random.default_rng(0)
    sizes = {"t": 4, "v": 5, "d": 3}
    factors = factorise.init_factors(spark, {"t": 4, "v": 5, "d": 2}, 2, 1)
    rows = [(t, v, d, float(rng.random())) for t in range(8) for v in range(5) for d in range(3)]
    cells = spark.createDataFrame(rows, "t int, v int, d int, x double")
    read = []
    reader = type(spark.read)
    real = reader.parquet

    def parquet(self, *paths):
        read.extend(p for p in paths if p.endswith("cells"))
        return real(self, *paths)

    versions = streams.Versions(spark, str(tmp_path))
    each = streams.learn_ocpd_windows(versions, factors, sizes["d"], 4, 2, iterations=2, patch_docs=2)
    reader.parquet = parquet
    try:
        for k in range(4):
            read.clear()
            each(cells.where(F.col("t").between(2 * k, 2 * k + 1)), k)
            # Itself for its reach, then the two batches of the window that has become complete.
            assert [p.split("/")[-2] for p in read] == [f"batch-{i}" for i in ([k, k - 1, k] if k else [k])]
    finally:
        reader.parquet = real
    assert versions.read(3, "done").first()["done"] == 3


def counts_of(spark, words):
    return spark.createDataFrame([(w, 1) for w in words], "term string, n long")


def as_dict(df):
    return {r.term: r.n for r in df.collect()}


def test_a_batch_writes_its_own_terms_only(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "runs"), ["term"], ["n"], fan=3)
    total, written = Counter(), []
    for number in range(11):
        words = [f"w{number}", f"w{number}", "often", f"w{number % 4}"]
        total.update(words)
        before = runs.complete()
        runs.add(counts_of(spark, words), number)
        assert as_dict(runs.table()) == total and runs.batches() == number + 1
        new = runs.complete() - before
        written.append(sorted(new))
        assert spark.read.parquet(runs.path(0, number)).count() == len(set(words))
    # Batches 2, 5 and 8 end a merge of three, 8 also one of nine; the others write one run.
    assert [len(w) for w in written] == [1, 1, 2, 1, 1, 2, 1, 1, 3, 1, 1]
    assert runs.complete() == {(2, 0), (0, 9), (0, 10)}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "runs"), ["term"], ["n"], fan=2)
    for number in range(8):
        for _ in range(3):
            runs.add(counts_of(spark, ["a", f"b{number}"]), number)
            assert as_dict(runs.table()) == {"a": number + 1} | {f"b{k}": 1 for k in range(number + 1)}
    assert runs.covering(7) == [(2, 0), (1, 2), (0, 6)] and runs.covering(8) == [(3, 0)]


def test_a_run_cut_short_does_not_count(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "runs"), ["term"], ["n"], fan=2)
    runs.add(counts_of(spark, ["a"]), 0)
    (tmp_path / "runs" / "run-0-1").mkdir()
    assert as_dict(runs.table()) == {"a": 1}
    runs.add(counts_of(spark, ["a", "b"]), 1)
    assert as_dict(runs.table()) == {"a": 2, "b": 1}


def test_counts_of_a_restarted_stream(spark, tmp_path):
    landing, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")
    runs = Runs(spark, str(tmp_path / "runs"), ["term"], ["n"], fan=2)
    fail = {1}

    def once_cut(batch, number):
        runs.add(streams.term_counts(batch), number)
        if number in fail:
            fail.remove(number)
            raise RuntimeError("lost")

    schema = "doc_id int, lang string, text string"
    for k, text in enumerate(["tea pot", "tea", "pot lid"]):
        rows = [(k, "en", text), (10 + k, "de", "tee")]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(landing)
        for _ in range(2):
            try:
                streams.run_available(streams.read_stream(spark, landing, schema, maxFilesPerTrigger=10), checkpoint, each=once_cut)
                break
            except Exception as error:
                assert "lost" in str(error)
    assert as_dict(runs.table()) == {"tea": 2, "pot": 2, "lid": 1, "tea pot": 1, "pot lid": 1} and not fail


# -- new files, once ---------------------------------------------------------


def test_a_killed_run_works_on_each_file_once(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()

    def land(*hours, name="id-{}.txt"):
        for h in hours:
            (landing / name.format(f"2024-01-01-{h:02}")).write_text(f"line of {h}\nsecond\n")

    def run(tool, checkpoint, make=lambda new: new, files=2):
        run_once(spark, str(landing), tool, make, str(tmp_path / checkpoint), files)

    def hours(tool):
        return Counter(r.file.split("/")[-1][14:16] for r in tool.output().collect())

    tool = Once(spark, str(tmp_path / "out"), "one")
    land(0, 1, 2)
    (landing / "no-hour.txt").write_text("left out")
    run(tool, "ck")
    assert hours(tool) == {"00": 2, "01": 2, "02": 2}

    # Killed before the output, then between output and manifest, then behind the manifest.
    land(3, 4, 5)
    kept = tool.manifest().count()
    for at in ("make", "manifest", "end"):
        cut = Once(spark, str(tmp_path / "out"), "one")

        def make(new, at=at):
            if at == "make":
                raise RuntimeError("killed")
            return new

        if at != "make":
            whole = cut.work_on

            def work_on(batch, make, at=at, whole=whole):
                if at == "manifest":
                    made = whole.__func__
                    frame = type(spark.range(1))
                    coalesce = frame.coalesce

                    def stop(self, n):
                        raise RuntimeError("killed")

                    frame.coalesce = stop
                    try:
                        return made(cut, batch, make)
                    finally:
                        frame.coalesce = coalesce
                whole(batch, make)
                raise RuntimeError("killed")

            cut.work_on = work_on
        with pytest.raises(Exception, match="killed"):
            run(cut, "ck", make)
        assert tool.manifest().count() - kept <= 2
    run(tool, "ck")
    assert hours(tool) == {f"{h:02}": 2 for h in range(6)} and tool.manifest().count() == 6

    # A lost checkpoint and an hour under another name bring nothing again; another tag does.
    land(5, 6, name="again-id-{}.txt")
    run(tool, "other", files=100)
    assert sorted(r.date_hour[-2:] for r in tool.manifest().collect()) == [f"{h:02}" for h in range(7)]
    assert sum(hours(tool).values()) == 14
    second = Once(spark, str(tmp_path / "out"), "two")
    with pytest.raises(ValueError, match="two"):
        second.output()
    run(second, "two", files=100)
    assert sum(hours(second).values()) == 14 and tool.manifest().count() == 14


def test_term_counts_add_up_over_batches(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "runs"), ["term"], ["n"], fan=2)
    each = add_counts(runs, streams.term_counts)
    texts = ["alpha beta", "beta gamma", "gamma gamma", "delta alpha"]
    batch = lambda k: spark.createDataFrame([(k, texts[k], "en"), (k + 10, "autre", "fr")], "doc_id long, text string, lang string")
    for k in (0, 1, 2, 2, 3):
        each(batch(k), k)
    got = {t: n for t, n in as_dict(runs.table()).items() if " " not in t}
    assert got == {"alpha": 2, "beta": 2, "gamma": 3, "delta": 1}
    assert runs.complete() >= {(2, 0)} and (0, 0) not in runs.complete()
