"""Toxicity: a convolutional text classifier on hashed word embeddings, trained in numpy."""

from __future__ import annotations

import copy
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from driftloom.llm import arrays
from driftloom.llm.components import free_shuffles, store

#: A word is the sum of the embeddings of itself and of its first bytes, so
#: that inflected forms share a part. 0 stands for the whole word.
PREFIXES = (0, 4, 5, 6)
BUCKETS = 1 << 16
WIDTH = 16
FILTERS = 12
SPANS = (1, 2, 3)
#: Labelled documents of either class that the driver fits on, at most; with more of
#: them that is a start, from which tasks learn on all.
TOXIC_ROWS, CLEAN_ROWS = 2500, 5000
#: Learning rates of the rounds over all rows, and documents a step.
RATES, ROWS_AT_ONCE = (0.001, 0.0003), 64
#: Numbers of the model in a part, as tasks' models are averaged part by part.
PART = 1 << 15
#: Steps of the score in which rows are counted for thresholds.
SCORE_STEPS = 10_000
#: Every so many of them set thresholds and take no part in training.
CALIBRATE = 5
#: A language needs so many toxic rows for a threshold of its own.
LEAST_TOXIC = 8
EPOCHS = 6
#: Words whose activations are held at once.
WORDS_AT_ONCE = 1 << 15
_BREAKS = np.ones(256, bool)
_BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Model:
    """Parameters of the network, and the score above which each language is toxic."""

    embedding: np.ndarray
    #: For each span a matrix (span * WIDTH, FILTERS) and a bias.
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    offset: float
    thresholds: dict[str, float] = field(default_factory=dict)


def new_model(seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)
    return Model(
        rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32),
        [rng.normal(0, 1 / np.sqrt(n * WIDTH), (n * WIDTH, FILTERS)).astype(np.float32) for n in SPANS],
        [np.zeros(FILTERS, np.float32) for _ in SPANS],
        rng.normal(0, 0.3, FILTERS * len(SPANS)).astype(np.float32), 0.0,
    )


def word_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word (one column per prefix), and where each text's words start.

    Words are runs of ASCII letters, digits and all other bytes from 128 on.
    """
    data, offsets = arrays.utf8(column)
    data = arrays.lower_ascii(data)
    starts, ends, counts = arrays.words(data, offsets, _BREAKS)
    found = np.empty((len(starts), len(PREFIXES)), np.uint16)
    for k, n in enumerate(PREFIXES):
        hashes = arrays.part_hashes(data, starts, ends if n == 0 else np.minimum(ends, starts + n))
        found[:, k] = (arrays.mix(hashes + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.uint16)
    return found, counts


def _activations(model: Model, found: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Embeddings of the words, and each span's filters at each word (its first)."""
    x = model.embedding[found].sum(axis=1)
    out = []
    for n, w in zip(SPANS, model.filters):
        y = np.full((len(x), FILTERS), -np.inf, np.float32)
        if len(x) >= n:
            y[: len(x) - n + 1] = sum(x[k:len(x) - n + 1 + k] @ w[k * WIDTH:(k + 1) * WIDTH] for k in range(n))
        out.append(y)
    return x, out


def pooled(model: Model, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The largest activation of every filter over each whole text, -inf where it has none."""
    best = np.full((len(counts) - 1, FILTERS * len(SPANS)), -np.inf, np.float32)
    most = max(SPANS) - 1
    for lo in range(0, len(found), WORDS_AT_ONCE):
        hi = min(lo + WORDS_AT_ONCE, len(found))
        _, out = _activations(model, found[lo:hi + most])
        first, last = np.searchsorted(counts, [lo, hi - 1], side="right") - 1
        for i in range(first, last + 1):
            a, b = max(lo, counts[i]), min(hi, counts[i + 1])
            if a >= b:
                continue
            for k, n in enumerate(SPANS):
                # A span that runs into the next text is none of this one.
                z = min(b, counts[i + 1] - n + 1)
                if z > a:
                    part = out[k][a - lo:z - lo].max(axis=0)
                    cell = best[i, k * FILTERS:(k + 1) * FILTERS]
                    np.maximum(cell, part, out=cell)
    return best


def scores(model: Model, column: pa.Array) -> np.ndarray:
    found, counts = word_buckets(column)
    z = pooled(model, found, counts) + np.concatenate(model.biases)
    logits = np.maximum(z, 0) @ model.dense + model.offset
    return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -40, 40)))


class _Learner:
    """Adam on the cross-entropy of `model`, which it changes in place.

    Max pooling passes a gradient to one span of words per filter and text only.
    """

    def __init__(self, model: Model, seed: int = 0):
        self.model, self.rng, self.steps = model, np.random.default_rng(seed), 0
        self.params = _params(model)
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params]
        self.offset_moments = [0.0, 0.0]

    def step(self, texts: list[np.ndarray], toxic: np.ndarray, rate: float) -> None:
        """One move on a few texts, given as the buckets of their words."""
        model, rng = self.model, self.rng
        grads = [np.zeros_like(p) for p in self.params]
        own = grads[0]
        g_offset = 0.0
        for found, mark in zip(texts, toxic):
            x, out = _activations(model, found)
            at = [y.argmax(axis=0) if len(x) >= n else None for n, y in zip(SPANS, out)]
            z = np.concatenate([
                np.full(FILTERS, -np.inf, np.float32) if a is None else y[a, np.arange(FILTERS)] + b
                for a, y, b in zip(at, out, model.biases)
            ])
            hidden = np.maximum(z, 0)
            # A filter left out at random in half the cases keeps one word from doing all the work.
            keep = (rng.random(len(hidden)) < 0.7).astype(np.float32) / 0.7
            p = 1 / (1 + np.exp(-np.clip(float((hidden * keep) @ model.dense) + model.offset, -30, 30)))
            d = np.float32((p - mark) / len(texts))
            g_offset += float(d)
            grads[-1] += d * hidden * keep
            back = d * model.dense * keep * (z > 0)
            for k, (n, a) in enumerate(zip(SPANS, at)):
                g = back[k * FILTERS:(k + 1) * FILTERS]
                if a is None or not g.any():
                    continue
                grads[1 + len(SPANS) + k] += g
                span = x[a[:, None] + np.arange(n)].reshape(FILTERS, n * WIDTH)
                grads[1 + k] += span.T * g
                to = (model.filters[k].T * g[:, None]).reshape(FILTERS, n, 1, WIDTH)
                np.add.at(
                    own, found[a[:, None] + np.arange(n)], np.broadcast_to(to, (FILTERS, n, len(PREFIXES), WIDTH))
                )
        self.steps += 1
        step = self.steps
        for p, g, (m, v) in zip(self.params, grads, self.moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= np.float32(rate) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        offset_moments = self.offset_moments
        offset_moments[0] += 0.1 * (g_offset - offset_moments[0])
        offset_moments[1] += 0.001 * (g_offset**2 - offset_moments[1])
        model.offset -= rate * offset_moments[0] / (1 - 0.9 ** step) / (
            np.sqrt(offset_moments[1] / (1 - 0.999 ** step)) + 1e-8)


def _params(model: Model) -> list[np.ndarray]:
    return [model.embedding, *model.filters, *model.biases, model.dense]


def train(texts: list[np.ndarray], toxic: np.ndarray, seed: int = 0) -> Model:
    """A model fitted on the driver; `texts` are the buckets of whole texts.

    Without a row of either class all scores are the smoothed share of toxic rows.
    """
    model = new_model(seed)
    toxic = np.asarray(toxic, np.float32)
    prior = (toxic.sum() + 0.25) / (len(toxic) + 1)
    model.offset = float(np.log(prior / (1 - prior)))
    if not 0 < toxic.sum() < len(toxic):
        model.dense[:] = 0
        return model
    learner, size = _Learner(model, seed), 32
    epochs = max(EPOCHS, min(60, 6000 // max(1, len(texts) // size) // 10))
    for _ in range(epochs):
        order = learner.rng.permutation(len(texts))
        for lo in range(0, len(order), size):
            rows = order[lo:lo + size]
            fade = 0.1 ** ((learner.steps + 1) * size / (epochs * len(order)))
            learner.step([texts[i] for i in rows], toxic[rows], 0.004 * fade)
    return model


def _learnt(batches: Iterable[pa.RecordBatch], shared, rate: float) -> Iterator[pa.RecordBatch]:
    """What one pass over a task's rows adds to the shared model, in parts, and its number of rows.

    Most embeddings are of words the task does not have: their zeros hardly take room in a shuffle.
    """
    before = np.concatenate([p.ravel() for p in _params(shared.value)])
    model = copy.deepcopy(shared.value)
    learner, total = _Learner(model), 0
    for batch in batches:
        for part in arrays.slices([batch], "text"):
            found, counts = word_buckets(part.column("text"))
            texts = [found[a:b] for a, b in zip(counts, counts[1:])]
            toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.float32)
            for lo in range(0, len(texts), ROWS_AT_ONCE):
                learner.step(texts[lo:lo + ROWS_AT_ONCE], toxic[lo:lo + ROWS_AT_ONCE], rate)
            total += len(texts)
    if total:
        moves = np.concatenate([p.ravel() for p in _params(model)]) - before
        moves = np.append(moves, np.float32(model.offset - shared.value.offset))
        parts = [moves[lo:lo + PART].tobytes() for lo in range(0, len(moves), PART)]
        yield pa.record_batch(
            [pa.array(range(len(parts)), pa.int32()), pa.array([total] * len(parts), pa.int64()), pa.array(parts, pa.binary())],
            names=["part", "n", "numbers"],
        )


def _added(parts: pa.Table) -> pa.Table:
    """One part of what all tasks add, each times its rows, in the order of their bytes, as the order of rows is not fixed."""
    numbers = sorted(zip(parts.column("numbers").to_pylist(), parts.column("n").to_pylist()))
    total = sum(np.frombuffer(p, np.float32).astype(np.float64) * n for p, n in numbers)
    return pa.table({
        "part": parts.column("part").slice(0, 1), "n": pa.array([pc.sum(parts.column("n")).as_py()], pa.int64()),
        "numbers": pa.array([total.tobytes()], pa.binary()),
    })


def learn_all(model: Model, rows: DataFrame) -> Model:
    """`model` after rounds over all rows(text, toxic): tasks learn from the same model, and theirs are averaged by rows."""
    context, schema = rows.sparkSession.sparkContext, "part int, n bigint, numbers binary"
    for rate in RATES:
        shared = context.broadcast(model)
        learnt = rows.select("text", "toxic").mapInArrow(partial(_learnt, shared=shared, rate=rate), schema)
        # As many numbers as one model has.
        found = sorted(learnt.groupBy("part").applyInArrow(_added, schema).collect(), key=lambda r: r["part"])
        if not found:
            return model
        moves = np.concatenate([np.frombuffer(bytes(r["numbers"])) / r["n"] for r in found])
        model, lo = copy.deepcopy(model), 0
        for p in _params(model):
            p += moves[lo:lo + p.size].reshape(p.shape).astype(np.float32)
            lo += p.size
        model.offset += float(moves[lo])
        shared.unpersist()
        del learnt
        free_shuffles(rows.sparkSession)
    return model


def counted_threshold(steps: np.ndarray, toxic: np.ndarray, rows: np.ndarray) -> float:
    """The cut of `threshold` for rows that are counted by steps of their score."""
    order = np.argsort(-steps)
    hits, seen = np.cumsum(toxic[order]), np.cumsum(rows[order])
    best = int(np.argmax(2 * hits / (seen + hits[-1])))
    below = steps[order[best + 1]] + 1 if best + 1 < len(order) else 0
    return float((steps[order[best]] + below) / 2 / SCORE_STEPS)


def thresholds(model: Model, rows: DataFrame) -> dict[str, float]:
    """Thresholds by language, and of all, from rows(text, lang, toxic): only counts by steps of the score are collected."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "text"):
            steps = np.floor(scores(shared.value, part.column("text")) * SCORE_STEPS).astype(np.int64)
            yield pa.record_batch([part.column("lang"), part.column("toxic"), pa.array(steps)], names=["lang", "toxic", "step"])

    counted = rows.select("text", "lang", "toxic").mapInArrow(score, "lang string, toxic int, step bigint")
    found = counted.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "step").agg(
        F.sum("toxic").alias("toxic"), F.count("*").alias("n")
    ).toPandas()
    groups = {"": found.groupby("step", as_index=False)[["toxic", "n"]].sum()}
    groups |= {lang: own for lang, own in found.groupby("lang") if lang}
    return {
        lang: counted_threshold(*(own[c].to_numpy() for c in ("step", "toxic", "n")))
        for lang, own in groups.items() if own["toxic"].sum() >= LEAST_TOXIC and (own["toxic"] < own["n"]).any()
    }


def threshold(score: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the best F1, in the middle of the gap it falls in."""
    order = np.argsort(-score)
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + toxic.sum())
    last = np.append(np.diff(score[order]) != 0, True)
    best = int(np.argmax(np.where(last, f1, -1)))
    below = score[order[best + 1]] if best + 1 < len(order) else 0.0
    return float((score[order[best]] + below) / 2)


def _usable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labelled documents outside the held-out fifth."""
    usable = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
        .where(~held_out(F.col("doc_id")))
    )
    # Labels of rows that are not in `docs` are of no use.
    return usable.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")


def _sample(usable: DataFrame) -> DataFrame:
    """At most TOXIC_ROWS and CLEAN_ROWS of them, drawn by hash."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return usable.where("toxic = 1").orderBy(*order).limit(TOXIC_ROWS).union(
        usable.where("toxic = 0").orderBy(*order).limit(CLEAN_ROWS)
    )


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _buckets_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in arrays.slices(batches, "text"):
        found, counts = word_buckets(part.column("text"))
        rows = [found[a:b].tobytes() for a, b in zip(counts, counts[1:])]
        yield pa.record_batch(
            [part.column("doc_id"), part.column("lang"), part.column("toxic"), pa.array(rows, pa.binary())],
            names=["doc_id", "lang", "toxic", "found"],
        )


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on all labelled rows outside the held-out fifth and set a threshold per language.

    Up to TOXIC_ROWS and CLEAN_ROWS of them are learned on the driver. With more, as
    many, drawn by hash of doc_id, give the start; tasks then learn on all rows but
    one in CALIBRATE, and thresholds come from all of those. A language with few toxic
    rows gets the threshold of all.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    usable = store(_usable(docs, labels), "labelled")
    n_toxic, n_rows = usable.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if n_toxic <= TOXIC_ROWS and n_rows - n_toxic <= CLEAN_ROWS:
        return _fit_here(docs, usable)
    start = _fit_here(docs, _sample(usable.where(~_apart())), calibrate=False)
    # Texts that cannot be learnt from are not moved. The labels grow with the documents,
    # so both sides are dealt by key at any size.
    rows = docs.where(~held_out(F.col("doc_id"))).join(usable.hint("merge"), "doc_id").select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
        F.col("toxic").cast("int").alias("toxic"), _apart().alias("apart"),
    )
    # Read once a round; the shuffles of the join go before that.
    rows = store(rows, "labelled-texts", codec="zstd")
    free_shuffles(docs.sparkSession)
    model = learn_all(start, rows.where("not apart"))
    model.thresholds = thresholds(model, rows.where("apart"))
    return model


def _apart():
    """Whether a document sets thresholds and is not learnt from, where tasks learn."""
    return F.pmod(F.xxhash64(F.lit("apart"), "doc_id"), F.lit(CALIBRATE)) == 0


def _fit_here(docs: DataFrame, chosen: DataFrame, calibrate: bool = True) -> Model:
    """A model of few rows, chosen(doc_id, toxic), trained on the driver, with thresholds from some of them."""
    # At most TOXIC_ROWS + CLEAN_ROWS numbers are broadcast.
    chosen = store(chosen, "sample")
    rows = docs.join(F.broadcast(chosen), "doc_id").select(
        "doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
        F.col("toxic").cast("int").alias("toxic"),
    ).mapInArrow(_buckets_of, "doc_id bigint, lang string, toxic int, found binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], bytes(r["found"])))
    texts = [np.frombuffer(bytes(r["found"]), np.uint16).reshape(-1, len(PREFIXES)) for r in rows]
    toxic = np.array([r["toxic"] for r in rows], np.int64)
    apart = np.zeros(len(rows), bool)
    for kind in (0, 1):
        own = np.flatnonzero(toxic == kind)
        apart[own[::CALIBRATE]] = calibrate and len(own) >= 2 * CALIBRATE
    use = np.flatnonzero(~apart)
    model = train([texts[i] for i in use], toxic[use])
    test = np.flatnonzero(apart)
    if len(test):
        found = np.concatenate([texts[i] for i in test])
        counts = np.cumsum([0] + [len(texts[i]) for i in test])
        z = np.maximum(pooled(model, found, counts) + np.concatenate(model.biases), 0) @ model.dense + model.offset
        score = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))
        langs = np.array([rows[i]["lang"] or "" for i in test])
        groups = {"": np.ones(len(test), bool)} | {x: langs == x for x in set(langs) if x}
        for name, rows_ in groups.items():
            if toxic[test][rows_].sum() >= LEAST_TOXIC and (toxic[test][rows_] == 0).any():
                model.thresholds[name] = threshold(score[rows_], toxic[test][rows_])
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `score` and `flagged`, the score being at or above the threshold of the row's language.

    The score sees the text only. A null or empty text has no words and gets the
    score of none; a null or unknown language has the threshold of all. Columns
    named score or flagged are replaced; others stay. Repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    taken = docs.drop("score", "flagged")
    schema = StructType([*taken.schema, StructField("score", DoubleType())])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "_text"):
            value = pa.array(scores(shared.value, part.column("_text")))
            keep = [c for c in part.schema.names if c != "_text"]
            yield pa.record_batch([*(part.column(c) for c in keep), value], names=[*keep, "score"])

    out = taken.withColumn("_text", F.col("text").cast("string")).mapInArrow(score, schema)
    cut = F.lit(model.thresholds.get("", 0.5))
    for name, value in sorted(model.thresholds.items()):
        if name:
            cut = F.when(F.col("lang") == name, value).otherwise(cut)
    return out.withColumn("flagged", F.col("score") >= cut)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, flagged) of every document."""
    model = fit(docs, labels)
    scored = score_documents(docs.select("doc_id", "text", "lang"), model)
    return scored.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged",
    )
