"""Near-duplicate documents and vectors, and the components under them."""

import math

import numpy as np
import pyarrow as pa

from driftloom.llm import embedding_dedup, minhash
from driftloom.llm.components import components
from tests.llm import brute

FOLDER = "/root/testdata/sf0.01"


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100 + i, 99) for i in range(1, 60)] + [(300, 300), (None, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 99 for i in [99, *range(101, 160)]} | {300: 300}


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_groups_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert found == brute.near_groups(rows)


def test_near_groups_on_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    chain = [" ".join(f"c{i}" for i in range(k, k + 60)) for k in range(0, 40, 4)]
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, "Two words", "x"), (5, "two  WORDS", "x"),
        (6, long, "x"), (7, long + " more", "x"), (None, long, "x"), (None, "alone here", "x"), (8, "tie", "x"), (8, "tie", "x"),
    ] + [(20 + k, t, "x") for k, t in enumerate(chain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    found = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_groups(docs).collect()]
    assert sorted(f for f in found if f[0] is not None and f[0] < 20) == [
        (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 6, True), (7, 6, False),
        (8, 8, True), (8, 8, True),
    ]
    # Each link of the chain is near the next only, and all of it is one group.
    assert {c for i, c, _ in found if i is not None and i >= 20} == {20}
    assert sorted((c for i, c, _ in found if i is None), key=str) == [6, None]
    assert minhash.near_groups(docs.limit(0)).count() == 0


def test_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(docs).collect()}
    assert found == brute.near_groups(docs.select("doc_id", "text").collect())


def test_only_texts_in_pairs_are_shuffled(spark, monkeypatch):
    docs = spark.range(50_000).selectExpr("id doc_id", "repeat(sha2(string(id), 256), 20) text")
    ids = spark.createDataFrame([(3,), (70_000,), (9,)], "doc_id long")
    found = minhash.among(docs, ids)
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == [3, 9]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    # With more ids than tasks may hold all rows stay, and the groups are the same.
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few = {tuple(r) for r in minhash.near_groups(docs).collect()}
    monkeypatch.setattr(minhash, "HELD_IDS", 0)
    assert minhash.among(docs, ids).count() == docs.count()
    assert {tuple(r) for r in minhash.near_groups(docs).collect()} == few


def test_a_pair_counts_once_where_bytes_are_equal_by_chance():
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(1200):
        # Two texts of 200 words, a third of the pairs each near 0.75, 0.8 and 0.85.
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 200)]
        cut = int(rng.choice([28, 22, 16]))
        texts += [" ".join(words), " ".join([f"x{x}" for x in rng.integers(0, 1 << 40, cut)] + words[cut:])]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    signed = [r for part in minhash._signatures([batch]) for r in part.to_pylist()]
    rows, want, by_bytes = [], set(), 0
    for x, y in zip(signed[::2], signed[1::2]):
        same = [k for k in range(minhash.BANDS) if x["bands"][k] == y["bands"][k]]
        alike = np.frombuffer(x["sig"], np.uint8) == np.frombuffer(y["sig"], np.uint8)
        if not same or alike.mean() < minhash.AGREE:
            continue
        want.add((x["doc_id"], y["doc_id"]))
        by_bytes += bool(alike[: same[0] * minhash.ROWS].reshape(-1, minhash.ROWS).all(axis=1).any())
        rows += [
            (r["bands"][k], r["doc_id"], r["doc_id"], 0, r["sig"], r["bands"][:k], 0, 0, k) for k in same for r in (x, y)
        ]
    assert len(want) > 1100 and by_bytes > 2
    names = ["bucket", "doc_id", "label", "block", "sig", "before", "i", "j", "band"]
    block = pa.record_batch([pa.array(c) for c in zip(*sorted(rows, key=lambda r: r[:2]))], names=names)
    for best, n in ((False, 1), (True, 2)):
        found = [(r["a"], r["b"]) for part in minhash._crossing(best)([block]) for r in part.to_pylist()]
        assert len(found) == n * len(want) and {(min(p), max(p)) for p in found} == want


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    want = brute.near_vectors(vectors.select("vec_id", "embedding", "label").collect(), 0.93)
    for cell, block in ((1024, 2048), (7, 4)):
        monkeypatch.setattr(embedding_dedup, "CELL", cell)
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(vectors).collect()}
        assert found == want


def test_near_vectors_on_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [], 1),
        (7, [1.0, None], 1), (8, [math.nan, 1.0], 1), (9, [math.inf, 1.0], 1), (10, [1.0, 0.0], None),
        (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 1), (12, [1.0, 0.0], 1), (13, [1e300, 1e300], 1), (14, [0.9999, 1.0], 1),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(vectors).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert found == sorted(alone + [
        (1, 3, 1, True), (2, 3, 1, False), (12, 3, 1, False), (12, 3, 1, False), (13, 1, 13, True), (14, 1, 13, False),
    ])
    assert embedding_dedup.near_vectors(vectors.limit(0)).count() == 0


def test_one_id_with_several_vectors_is_one_node(spark):
    schema = "vec_id long, embedding array<double>, label int"
    rows = [(1, [1.0, 0.0], 1), (1, [0.9999, 0.01], 1), (2, [1.0, 0.001], 1), (None, [1.0, 0.002], 1)]
    found = embedding_dedup.near_vectors(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in found)) == [
        (0, 3, 1, True), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False),
    ]
    # Vectors apart, joined by their id only, in two labels; a class without any id links them to others.
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 2), (7, [0.0, 1.0], 2), (None, [1.0, 0.1], 1), (8, [1.0, 0.3], 1), (None, [-1.0, 0.0], 1)]
    found = embedding_dedup.near_vectors(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r.vec_id or 0, r.n_links, r.component_id or 0) for r in found)) == [
        (0, 0, 0), (0, 2, 5), (5, 1, 5), (5, 2, 5), (7, 1, 5), (8, 2, 5),
    ]


def test_one_id_with_several_texts_is_one_node(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(3, b), (5, a), (5, b), (7, a), (9, "alone"), (11, "c c c"), (11, "d d d"), (12, "d d d")]
    found = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [
        (3, 3), (5, 3), (5, 3), (7, 3), (9, 9), (11, 11), (11, 11), (12, 11),
    ]
