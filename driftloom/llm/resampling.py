"""Importance resampling towards a target text: CRC buckets of words, gains and one Gumbel draw a document."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftloom.llm import arrays
from driftloom.llm.components import store
from driftloom.operators.numbering import number_rows

#: Buckets of features: what the driver holds of the corpus is one number a bucket.
BUCKETS = 10_000
#: Features are the runs of 1 to so many words.
WORDS = 1
#: Documents of fewer words are not drawn.
LEAST_WORDS = 20
#: Of 100 documents so many are drawn.
PERCENT = 10
SEED = 2024
CRC = 0xEDB88320

BREAK = np.ones(256, bool)
BREAK[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def crc_table() -> np.ndarray:
    """What a CRC-32 becomes by one more byte, for every low byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(CRC), table >> np.uint32(1))
    return table


TABLE = crc_table()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of every data[start:end].

    Parts of one length are the rows of a byte matrix, of which only distinct
    ones are kept; all their sums advance by one column at a time and are put
    back in the places of their parts.
    """
    sums = np.zeros(len(starts), np.uint32)
    sizes = ends - starts
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1)) if len(order) else []
    for lo, hi in zip(cuts, cuts[1:]):
        at = order[lo:hi]
        size = int(sizes[at[0]])
        if not size:
            continue
        rows = np.lib.stride_tricks.sliding_window_view(data, size)[starts[at]]
        distinct, where = np.unique(rows.view(f"V{size}").ravel(), return_inverse=True)
        columns = np.ascontiguousarray(distinct.view(np.uint8).reshape(-1, size).T)
        value = np.full(len(distinct), 0xFFFFFFFF, np.uint32)
        for column in columns:
            value = (value >> np.uint32(8)) ^ TABLE[(value ^ column) & 0xFF]
        sums[at] = ~value[where]
    return sums


def features(column: pa.Array, words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every feature of a batch, and the words of each text."""
    data, offsets = arrays.utf8(column)
    data = arrays.lower_ascii(data)
    starts, ends, counts = arrays.words(data, offsets, BREAK)
    # All words in a row, one space between two: a feature is a stretch of it.
    sizes = ends - starts
    to = np.cumsum(sizes + 1) - sizes - 1
    row = np.full(int((sizes + 1).sum()), 32, np.uint8)
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row[np.repeat(to, sizes) + inside] = data[np.repeat(starts, sizes) + inside]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(counts))
    found, who = [], []
    for k in range(words):
        first = np.arange(max(0, len(starts) - k))
        first = first[owner[first] == owner[first + k]]
        found.append(crc32(row, to[first], to[first + k] + sizes[first + k]) % np.uint32(buckets))
        who.append(owner[first])
    return np.concatenate(found).astype(np.int64), np.concatenate(who), np.diff(counts)


def bucket_counts(texts: DataFrame, words: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket; every task adds up its own first."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in arrays.slices(batches, "text"):
            total += np.bincount(features(part.column("text"), words, buckets)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    counts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, words: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets: 1000 times the logarithm of how much likelier the target holds it, rounded down.

    Every bucket has one feature more than was counted, so none is empty.
    """
    both = bucket_counts(docs, words, buckets).withColumn("own", F.lit(True)).unionByName(
        bucket_counts(target, words, buckets).withColumn("own", F.lit(False))
    )
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("own"))
    held = store(
        every.union(both.select("bucket", "n", "own")).groupBy("bucket").agg(
            F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("s"),
            F.sum(F.when(F.col("own"), 0).otherwise(F.col("n"))).alias("t"),
        ),
        "buckets",
    )
    sums = held.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = {c: F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t")}
    ratio = (d["t"] + 1) * (d["all_s"] + buckets) / ((d["s"] + 1) * (d["all_t"] + buckets))
    # One row of sums beside a bounded number of buckets.
    return held.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, gain: DataFrame, words: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of its features' gains, of every row of docs (doc_id, text)."""
    # One number a bucket.
    rows = gain.collect()
    table = np.zeros(buckets, np.int64)
    table[[r["bucket"] for r in rows]] = [r["gain"] for r in rows]
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "text"):
            bucket, who, n = features(part.column("text"), words, buckets)
            sums = np.zeros(len(n), np.int64)
            np.add.at(sums, who, shared.value[bucket])
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(n), pa.array(np.bincount(who, minlength=len(n))), pa.array(sums)],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    taken = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return taken.mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least: int = LEAST_WORDS,
    words: int = WORDS, buckets: int = BUCKETS,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text).

    `target` (text) is what the drawn documents should be like. A document's score
    is its weight plus 1000 times a Gumbel draw from its doc_id and `seed`, so the
    highest scores are a sample without replacement in proportion to the exponent
    of the weights. `percent` of the documents of at least `least` words are drawn;
    rank is their place, ties going to the smaller doc_id, and null for others.

    Words are runs of letters a to z in either case, digits and characters beyond
    ASCII. A null or empty text has no words, weighs 0 and is not drawn. A null
    doc_id draws as the empty string and comes last among ties; repeated rows are
    documents each, with one score. An empty target is like any other with no
    features; an empty `docs` gives no rows. Further columns are ignored.
    """
    weighed = weights(docs, gains(docs, target, words, buckets), words, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    gumbel = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296)))
    scored = store(weighed.withColumn("score", F.col("weight") + gumbel).withColumn("row", F.monotonically_increasing_id()), "scored")
    drawn = scored.where(F.col("n_words") >= least).count() * percent // 100
    keyed = scored.select(
        (F.col("n_words") < least).alias("out"), (-F.col("score")).alias("below"), F.col("doc_id").isNull().alias("unnamed"),
        "doc_id", "row", "n_features", "weight",
    )
    placed = number_rows(keyed, ["out", "below", "unnamed", "doc_id", "row"])
    return placed.select(
        "doc_id", "n_features", "weight", (-F.col("below")).alias("score"),
        F.when(F.col("pos") < drawn, F.col("pos") + 1).alias("rank"),
    )
