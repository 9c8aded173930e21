"""The two trained models and the piece codec."""

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftloom.llm import pii, piece_codec, toxicity
from driftloom.llm.queries import tokenizer_path
from driftloom.llm.words import ENTRY, WordIds

FOLDER = "/root/testdata/sf0.01"


# -- toxicity ------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(5)
    neutral = [f"plain{k}" for k in range(300)]
    texts, toxic = [], []
    for k in range(400):
        words = list(rng.choice(neutral, 30))
        if k % 4 == 0:
            words[int(rng.integers(30))] = rng.choice(["blastling", "blastor", "blastish", "wretchy"])
        texts.append(" ".join(words))
        toxic.append(k % 4 == 0)
    found, counts = toxicity.word_buckets(pa.array(texts))
    return toxicity.train([found[a:b] for a, b in zip(counts, counts[1:])], np.array(toxic, np.int64))


def test_words_and_their_prefixes_are_learnt(model):
    texts = ["plain3 plain9 Blastling, plain7", "plain3 plain9 plain7", "plain1 blastery plain2", ""]
    high, low, unseen, empty = toxicity.scores(model, pa.array(texts))
    assert high > 0.5 > low and unseen > low and 0 <= empty < 0.5


def test_blocks_of_words_change_no_score(model, monkeypatch):
    texts = pa.array([" ".join(f"plain{k % 97}" for k in range(n)) + " wretchy" for n in (0, 1, 2, 5, 700)] + [None, ""])
    whole = toxicity.scores(model, texts)
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 3)
    assert np.allclose(whole, toxicity.scores(model, texts), atol=1e-6)


def test_threshold_is_the_best_cut():
    score, toxic = np.array([0.9, 0.8, 0.7, 0.2, 0.1]), np.array([1, 1, 0, 0, 0])
    assert toxicity.threshold(score, toxic) == pytest.approx(0.75)


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in toxicity.judged(docs, labels).collect()}
    assert len(found) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    known = [(found[r.doc_id], r.toxic) for r in labels.collect() if r.doc_id in found]
    right = [r.predicted == t for r, t in known if r.held_out]
    assert np.mean(right) > 0.9
    # Neither language nor source is seen by the score.
    model = toxicity.new_model()
    both = [
        {r.doc_id: r.score for r in toxicity.score_documents(d, model).collect()}
        for d in (docs, docs.selectExpr("doc_id", "text", "'xx' lang", "'s' source", "n_chars"))
    ]
    assert both[0] == both[1]


def test_toxicity_learns_from_rows_beyond_the_start(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TOXIC_ROWS", 30)
    monkeypatch.setattr(toxicity, "CLEAN_ROWS", 60)
    monkeypatch.setattr(toxicity, "RATES", (0.01,) * 12)
    ids = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.lit("en").alias("lang"))
    labels = ids.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    usable = toxicity._usable(ids, labels)
    start = {r.doc_id for r in toxicity._sample(usable.where(~toxicity._apart())).collect()}
    assert len(start) == 90

    # The start sees one bad word, all other toxic rows hold another one.
    rows = [
        (i, f"mild tale {i % 7} of {'vile' if i in start else 'grukk' if i % 3 == 0 else 'calm'} weather", "en")
        for i in range(900)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2, "doc_id")
    model = toxicity.fit(docs, labels)
    first, other = toxicity.scores(model, pa.array(["a tale of grukk weather", "a tale of calm weather"]))
    assert first > 0.5 > other
    assert other < model.thresholds[""] <= first and set(model.thresholds) == {"", "en"}


def test_tasks_send_only_what_they_learnt(spark):
    class Shared:
        value = toxicity.new_model()

    batch = pa.record_batch([pa.array(["a vile tale", "a calm tale"]), pa.array([1, 0], pa.int32())], names=["text", "toxic"])
    parts = [r for part in toxicity._learnt([batch], Shared, 0.01) for r in part.to_pylist()]
    moves = np.concatenate([np.frombuffer(r["numbers"], np.float32) for r in parts])
    params = toxicity._params(Shared.value)
    assert len(moves) == sum(p.size for p in params) + 1 and all(r["n"] == 2 for r in parts)
    found, _ = toxicity.word_buckets(batch.column("text"))
    rows = np.flatnonzero(moves[:params[0].size].reshape(params[0].shape).any(axis=1))
    assert len(rows) and set(rows) <= set(found.ravel().tolist())
    # One task's model is the model.
    docs = spark.createDataFrame([("a vile tale", 1), ("a calm tale", 0)], "text string, toxic int").coalesce(1)
    learner = toxicity._Learner(toxicity.new_model())
    texts = [toxicity.word_buckets(pa.array([t]))[0] for t in ("a vile tale", "a calm tale")]
    for rate in toxicity.RATES:
        learner = toxicity._Learner(learner.model)
        learner.step(texts, np.array([1, 0], np.float32), rate)
    model = toxicity.learn_all(Shared.value, docs)
    assert all(np.allclose(p, q, atol=1e-7) for p, q in zip(toxicity._params(model), toxicity._params(learner.model)))
    assert model.offset == pytest.approx(learner.model.offset, abs=1e-7)


def test_threshold_of_counted_scores():
    steps, toxic, rows = np.array([2000, 9000, 6000, 4000]), np.array([0, 3, 2, 0]), np.array([5, 3, 2, 4])
    assert toxicity.counted_threshold(steps, toxic, rows) == pytest.approx((6000 + 4001) / 2 / 10_000)


def test_toxicity_without_labels_and_on_odd_rows(spark):
    rows = [(1, None, None, 0.5), (2, "", "en", 0.5), (3, "word " * 90_000, "en", 0.5), (3, "tie", "en", 0.5), (None, "x", "en", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.judged(docs, labels).collect()
    assert len(out) == 5 and len({r.score for r in out}) == 1 and out[0].score < 0.5
    scored = toxicity.score_documents(docs, toxicity.new_model())
    assert scored.columns == ["doc_id", "text", "lang", "score", "flagged"]
    assert toxicity.judged(docs.limit(0), labels.limit(0)).count() == 0


# -- personal data -------------------------------------------------------------

NAIVE = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]
ODD = [
    "a@b.c@d.e.f", "x@@y.z", "aa@b", "1.2.3.4.5.6.7.8 300.1.1.1 1.1.1.1", "+1 (2) 3-4 5 6 7 8 9 0 +", "4111 1111 1111 1111 4111-1111",
    "é.a@b.co @c.d", "..@a.b-.c", "1.2.3.4@5.6", "", "1" * 5000, "a" * 5000 + "@", "+" * 3000, "0001.02.3.255",
]


def naive_spans(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(NAIVE) for m in p.finditer(text) if pii.holds(pii.KINDS[k], m[0]))


def test_fixed_patterns_equal_plain_search(spark):
    for text in ODD:
        assert pii.base_spans(text) == naive_spans(text)
    rng = np.random.default_rng(1)
    for _ in range(3000):
        text = "".join(rng.choice(list("19a.@+- ()"), 24))
        assert pii.base_spans(text) == naive_spans(text)


def test_gradients_are_those_of_the_loss():
    rng, model = np.random.default_rng(0), pii.new_model(1)
    for p in model.parameters():
        p += rng.normal(0, 0.1, p.shape).astype(np.float32)
    x, y = rng.integers(0, pii.CLASSES, (6, 12)).astype(np.uint8), rng.integers(0, pii.TAGS, (6, 12)).astype(np.uint8)
    _, grads = pii.gradients(model, x, y)
    for p, g in zip(model.parameters(), grads):
        at = np.unravel_index(np.abs(g).argmax(), p.shape)
        old, losses = p[at], []
        for step in (0.01, -0.01):
            p[at] = old + step
            losses.append(pii.gradients(model, x, y)[0])
        p[at] = old
        assert (losses[0] - losses[1]) / 0.02 == pytest.approx(g[at], rel=0.05, abs=2e-3)


def test_decoding_finds_the_best_path():
    rng, model = np.random.default_rng(2), pii.new_model(3)
    model.transition += rng.normal(0, 1, model.transition.shape).astype(np.float32)
    x = rng.integers(0, pii.CLASSES, (3, 4)).astype(np.uint8)
    score, _ = pii.emissions(model, x)
    for row, path in enumerate(pii.decode(model, x)):
        best = max(
            itertools.product(range(pii.TAGS), repeat=4),
            key=lambda p: sum(score[t, row, p[t]] for t in range(4)) + sum(model.transition[a, b] for a, b in zip(p, p[1:])),
        )
        assert tuple(path) == best


def test_windows_cover_and_reconcile():
    text = "x" * 100 + " mail a.b@c.org " + "y" * 300 + " 10.0.0.1" * 30
    codes = pii.classes(text)
    starts = pii.windows(codes)
    spans = pii.base_spans(text)
    paths = pii.cut(pii.tags(len(text), spans), starts)
    assert pii.reconciled(len(text), starts, paths) == spans
    assert not len(pii.windows(pii.classes("no digits here")))


def test_the_network_finds_other_ways_of_writing():
    rng = np.random.default_rng(4)

    def text(phone):
        words = [" ".join("".join(rng.choice(list("aeilnrst"), int(rng.integers(2, 9)))) for _ in range(int(rng.integers(2, 9)))) for _ in "ab"]
        number = f"({rng.integers(200, 999)}) {rng.integers(100, 999)}-{rng.integers(1000, 9999)}"
        noise = f"{rng.integers(1, 99999)}"
        return (f"{words[0]} +1 {number} {words[1]}" if phone else f"{words[0]} {noise} {words[1]}")

    x, y = [], []
    for k in range(500):
        t = text(k % 2)
        for version in (0, 1):
            own, spans = (t, pii.base_spans(t)) if version == 0 else pii.varied(t, pii.base_spans(t), rng)
            codes = pii.classes(own)
            x.append(pii.cut(codes, pii.windows(codes)))
            y.append(pii.cut(pii.tags(len(own), spans), pii.windows(codes)))
    model = pii.train(np.concatenate(x), np.concatenate(y), steps=250)
    fresh = [text(True).replace("+", "") for _ in range(50)]
    found = pii.all_spans(model, fresh)
    assert sum(len(added) == 1 and added[0][1] == 3 for _, added in found) > 35
    clean = pii.all_spans(model, [text(False) for _ in range(50)])
    assert sum(len(added) for _, added in clean) <= 2


def test_personal_data_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text, "x") for r in docs] + [(10_000 + k, t, "x") for k, t in enumerate(ODD)] + [(None, None, "x"), (7, "+1 555 010 9999", "x")]
    found = pii.scan_documents(spark.createDataFrame(rows, "doc_id long, text string, start string")).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    for i, text, _ in rows:
        spans = naive_spans(text or "")
        line = ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in spans)
        digest = hashlib.sha256(line.encode()).hexdigest()
        own = [r for r in by_id[i] if r.base_sha256 == digest]
        assert own and [own[0][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == n for s in spans) for n in range(4)]
        assert set(line.split(",")) - {""} <= set(own[0].spans.split(","))


def test_a_null_text_beside_a_sampled_id(spark):
    rows = [(1, "call +1 555 010 9999 now"), (1, None), (1, "x@y.zz"), (2, None), (3, "")]
    found = pii.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_email, r.n_phone) for r in found) == [(1, 0, 0), (1, 0, 1), (1, 1, 0), (2, 0, 0), (3, 0, 0)]


def test_personal_data_of_nothing(spark):
    assert pii.scan_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- pieces --------------------------------------------------------------------

TEXTS = [
    "", " ", "  ", "a", "  a  b ", "a\nb", "Ａ①é", "x\ty", "<s>a</s>", "\n", "a\r\n b", "　a\xa0b", "é", "x" * 500, " " * 70,
    "ab" * 100 + " " * 40 + "zz", "a\0b\0", "你好 мир 🙂🙂", "the" * 30, "=-" * 200, "\n\n\n", "a\t\t b", " �",
]


def test_ids_equal_the_models_library(spark):
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_path("piece_bpe_32k.model")
    plain = SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text, [1]) for r in docs] + [(10_000 + k, t, [1]) for k, t in enumerate(TEXTS)] + [(20_000, None, [1]), (None, "n", [1])]
    out = piece_codec.encode(spark.createDataFrame(rows, "doc_id long, text string, ids array<int>"), path)
    coded = piece_codec.decode(out, path).collect()
    assert len(coded) == len(rows)
    for r in coded:
        assert r.ids == plain.encode(r.text or "")
        assert r.decoded == (r.text or "")
    whole = piece_codec.encoded_documents(spark.createDataFrame(rows, "doc_id long, text string, ids array<int>"), path).collect()
    assert all(r.round_trip for r in whole)
    assert sorted((r.doc_id or -1, r.n_ids, r.ids) for r in whole) == sorted((r.doc_id or -1, len(r.ids), r.ids) for r in coded)
    assert piece_codec.encoded_documents(spark.createDataFrame(rows[:0], "doc_id long, text string, ids array<int>"), path).count() == 0


def test_words_forgotten_are_learnt_again():
    calls = []

    def encode(words):
        calls.append(list(words))
        return np.array([ord(c) for w in words for c in w], np.uint32), np.array([len(w) for w in words])

    ids = WordIds(encode, remembered=4 * ENTRY)
    rng = np.random.default_rng(0)
    for turn in range(200):
        texts = [" ".join(chr(97 + x) * int(x % 3) for x in rng.integers(0, 12, int(rng.integers(0, 6)))) for _ in range(3)]
        assert ["".join(map(chr, x)) for x in ids.all(texts)] == [t.replace(" ", "") for t in texts]
        assert ids.now.known <= 2 + 18
    # A word of late is not encoded again, one of long ago is.
    assert sum(map(len, calls)) < 12 * 200 and sum("b" in c for c in calls) > 1


def test_suffix_array_sorts_suffixes():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 3, 200).astype(np.uint32)
    for depth in (1, 5, 16):
        order = piece_codec.suffix_array(codes, depth)
        keys = [tuple(codes[i:i + depth]) for i in order]
        assert keys == sorted(keys) and sorted(order) == list(range(200))
