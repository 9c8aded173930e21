"""The pipeline, stage by stage, against plain versions of what each decides."""

import corpus_pipeline
from driftloom.llm import secret_scan
from tests.llm import brute

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, held = docs.columns, {}
    rows = {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic = 0").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.store(stage(spark, docs, FOLDER), name)
        held[name] = {r.doc_id: r for r in docs.collect()} if name != "packing" else docs.collect()
        assert name == "packing" or docs.columns == columns
    kept = set(held["toxicity"])
    assert len(toxic - kept) > 0.8 * len(toxic) and len(clean & kept) > 0.98 * len(clean)
    assert all(held["toxicity"][i] == rows[i] for i in kept)
    lines = held["line_dedup"]
    assert set(lines) == kept and all(lines[i].n_chars == len(lines[i].text) for i in kept)
    groups = brute.near_groups([(i, r.text) for i, r in lines.items()])
    assert set(held["near_dedup"]) == {i for i, (_, c) in groups.items() if i == c}
    masked = held["secrets"]
    assert set(masked) == set(held["near_dedup"])
    for i, r in masked.items():
        before = held["near_dedup"][i].text
        spans = [s for rule in secret_scan.RULES for s in secret_scan.matches(rule, before)]
        assert (r.text == before) == (not spans) and r.n_chars == len(r.text)
        assert not spans or "[SECRET]" in r.text
    packed = held["packing"]
    assert {r.doc_id for r in packed} == set(masked)
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)


def test_run_is_the_stages_in_turn(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.store(stage(spark, docs, folder), name)
    ids = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(docs.select(*ids).collect()) == sorted(corpus_pipeline.run(spark, folder).select(*ids).collect())


def test_an_empty_table_goes_through(spark, tmp_path):
    for table in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
