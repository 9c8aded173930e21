"""Packing: token counts by document, first-fit decreasing in randomised groups."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftloom.llm import arrays
from driftloom.llm.components import store
from driftloom.llm.words import WordIds

LENGTH = 4096
#: The id behind every document.
END = 2
#: Pieces that are packed together.
GROUP = 4096
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


#: Words that are tokenised as one text: a call for each word would cost more than its ids.
JOINED = 2000


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """The worker's memory of words, shared by its tasks.

    This tokenizer drops white space and never joins what stands on both sides of
    it, so words go in as a text and its ids are cut where the words begin.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [words[k:k + JOINED] for k in range(0, len(words), JOINED)]
        ids, sizes = [], []
        for part, found in zip(parts, tokenizer.encode_batch([" ".join(p) for p in parts], add_special_tokens=False)):
            ids.append(np.array(found.ids, np.uint32))
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            ends = np.cumsum(lengths + 1)
            begins = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            sizes.append(np.diff(np.searchsorted(begins, ends), prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    return WordIds(encode_words)


def _cutter(path: str, length: int):
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path)
        for part in arrays.slices(batches, "text"):
            rows = []
            found = encode.all([t or "" for t in part.column("text").to_pylist()])
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), found):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start:start + length]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece), len(ids)))
            yield pa.record_batch(
                [pa.array(c, pa.int64()) for c in zip(*rows)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )
    return cut


class Bins:
    """A tournament tree of the room left in bins: each inner node holds the most of its two children."""

    def __init__(self, most: int, room: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.tree = [room] * (2 * self.leaves)

    def put(self, size: int) -> int:
        """Put `size` into the first bin with room for it; returns the bin."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            at += tree[at] < size
        place = at - self.leaves
        tree[at] -= size
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
        return place


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each size and its offset there; larger sizes go first, ties by position."""
    bins = Bins(len(sizes), room)
    place, offset, filled = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), [0] * len(sizes)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        b = bins.put(size)
        place[i], offset[i] = b, filled[b]
        filled[b] += size
    return place, offset


def _packer(length: int):
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in arrays.whole_groups(batches, ["group"]):
            sizes, group = table.column("length").to_numpy(), table.column("group").to_numpy()
            place, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            for lo, hi in zip(starts, [*starts[1:], len(sizes)]):
                place[lo:hi], offset[lo:hi] = first_fit_decreasing(sizes[lo:hi], length)
            out = table.drop_columns(["group"]).append_column("sequence_id", pa.array((group << 32) + place))
            yield from out.append_column("offset", pa.array(offset)).to_batches()
    return pack


def token_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): documents cut into runs of at most `length` ids.

    The ids of a whole text, then END. A null or empty text is END alone.
    """
    taken = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return taken.mapInArrow(_cutter(tokenizer, length), PIECES)


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """`pieces` (a column length, and columns that tell rows apart) with sequence_id and offset.

    Pieces are dealt by hash into groups of about `group`, and each group packed
    on its own by first-fit decreasing, so work and memory of a task do not grow
    with the table, and no document, source or size decides where a piece goes.
    Sequences of a group are numbered from group * 2 ** 32. Equal rows hash into
    one group each with its own salt, so copies of a row are spread as well.
    """
    held = store(pieces.withColumn("salt", F.rand(17)), "pieces")
    groups = max(1, -(-held.count() // group))
    where = F.pmod(F.xxhash64("salt", *pieces.columns), F.lit(groups)).alias("group")
    dealt = held.select(*pieces.columns, where).repartition("group").sortWithinPartitions("group", *pieces.columns)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(_packer(length), f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """Every piece of every document with its place in a sequence of `length` ids.

    Each id of a document and the END behind it lies in one piece. Repeated rows
    are packed once each; a null doc_id is kept. Further columns are ignored.
    """
    return pack(token_pieces(docs, tokenizer, length), length)


def sequences(packed: DataFrame, docs: DataFrame, tokenizer: str) -> DataFrame:
    """(sequence_id, ids) of the packed pieces: the training rows themselves, unpadded.

    `docs` must tell its rows apart by doc_id.
    """
    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer)
        for part in arrays.slices(batches, "text"):
            rows = []
            found = encode.all([t or "" for t in part.column("text").to_pylist()])
            for ids, pieces in zip(found, part.column("pieces").to_pylist()):
                ids = np.append(ids, np.uint32(END)).astype(np.int32)
                rows += [(p["sequence_id"], p["offset"], ids[p["start"]:p["start"] + p["length"]]) for p in pieces]
            yield pa.record_batch(
                [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]),
                 pa.array([r[2] for r in rows], pa.list_(pa.int32()))],
                names=["sequence_id", "offset", "ids"],
            )

    places = packed.groupBy(F.col("doc_id").alias("of")).agg(
        F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("pieces")
    )
    parts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        places, F.col("doc_id").eqNullSafe(F.col("of"))
    )
    filled = parts.mapInArrow(fill, "sequence_id bigint, offset bigint, ids array<int>")
    return filled.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids")
    )
