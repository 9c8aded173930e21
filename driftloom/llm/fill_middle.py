"""Fill-in-middle transformation: bytes of a batch are scattered to their places, and gathered back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from driftloom.llm import arrays

#: The marks before prefix, suffix and middle; each is three bytes that differ in the second.
MARKS = ("<P>", "<S>", "<M>")
PREFIX, SUFFIX, MIDDLE = (ord(m[1]) for m in MARKS)
#: Of 100 documents so many are cut, and of 100 cut ones so many have the suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: Bytes of text worked on at once: every byte takes some 40 more.
BLOCK = 4 << 20

FORMED = [
    StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()),
    StructField("middle_chars", LongType()), StructField("output", StringType()),
]


def marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where marks stand in a batch, and the text of each."""
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = data[1:-1]
    at = np.flatnonzero((data[:-2] == 60) & (data[2:] == 62) & ((kind == PREFIX) | (kind == SUFFIX) | (kind == MIDDLE)))
    who = np.searchsorted(offsets, at, side="right") - 1
    inside = at + 3 <= offsets[who + 1]
    return at[inside], who[inside]


def moved(n: int, starts: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Where each of n bytes goes: parts begin at `starts` (ascending, from 0) and move by `shifts`.

    The differences of neighbouring shifts are put where parts begin; their sums
    are the shift of every byte. Of parts that begin at one place all but the
    last are empty.
    """
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, np.diff(shifts, prepend=0))
    return np.arange(n) + np.cumsum(steps[:n])


def draws(doc_ids: list[int | None], seed: int) -> np.ndarray:
    """Four numbers below 2 ** 32 for each id, from the SHA-256 of `seed:id`; a null id is empty there."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in doc_ids)
    return np.frombuffer(raw, ">u4").astype(np.int64).reshape(-1, 4)


def form(data: np.ndarray, offsets: np.ndarray, h: np.ndarray):
    """Cut the texts of a batch by their draws.

    Returns code points, plain, suffix-first, the code points of prefix and
    middle, and the output's bytes and offsets.
    """
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(leads, offsets)
    n = np.diff(first)
    a, b = (h[:, k] % (n + 1) for k in (0, 1))
    low, high = np.minimum(a, b), np.maximum(a, b)
    plain = (n == 0) | (h[:, 2] % 100 >= CUT)
    plain[marks(data, offsets)[1]] = True
    swapped = h[:, 3] % 100 < SUFFIX_FIRST
    places = np.append(leads, len(data))
    start, end = offsets[:-1], offsets[1:]
    # A cut behind a text's last code point is where the next text begins.
    one, two = places[first[:-1] + low], places[first[:-1] + high]
    sizes = end - start + np.where(plain, 0, 3 * len(MARKS))
    ends = np.cumsum(sizes)
    at = ends - sizes
    p, m, s = one - start, two - one, end - two
    to_p = at + 3 + np.where(swapped, s + 3, 0)
    to_s = at + 3 + np.where(swapped, 0, p + 3)
    to_m = at + 9 + p + s
    # The parts in the order of the input; an uncut text is all prefix.
    begins = np.stack([start, np.where(plain, end, one), np.where(plain, end, two)], axis=1).ravel()
    shifts = np.stack([
        np.where(plain, at, to_p) - start, np.where(plain, at - start, to_m - one), np.where(plain, at - start, to_s - two),
    ], axis=1).ravel()
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[moved(len(data), begins, shifts)] = data
    for kind, to in ((PREFIX, to_p), (SUFFIX, to_s), (MIDDLE, to_m)):
        to = to[~plain] - 3
        out[to], out[to + 1], out[to + 2] = 60, kind, 62
    return n, plain, swapped, low, high - low, out, np.append(0, ends)


def unform(data: np.ndarray, offsets: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts (bytes, offsets) that the outputs of a batch were cut from, uncut ones being `plain`."""
    at, who = marks(data, offsets)
    at, who = at[~plain[who]], who[~plain[who]]
    cut = np.flatnonzero(~plain)
    if len(at) != 3 * len(cut) or (who.reshape(-1, 3) != cut[:, None]).any():
        raise ValueError("an output has not one mark of each kind")
    at = at.reshape(-1, 3)
    kind = data[at + 1]
    begins, stops = at + 3, np.column_stack([at[:, 1:], offsets[1:][cut]])
    order = np.argsort(np.select([kind == PREFIX, kind == MIDDLE], [0, 1], 2), axis=1, kind="stable")
    if (np.sort(kind, axis=1) != sorted((PREFIX, SUFFIX, MIDDLE))).any():
        raise ValueError("an output has not one mark of each kind")
    # The parts of every text in their first order, uncut texts as one part and two empty ones.
    source = np.repeat(offsets[:-1, None], 3, axis=1)
    length = np.zeros((len(plain), 3), np.int64)
    length[:, 0] = np.diff(offsets)
    source[cut] = np.take_along_axis(begins, order, axis=1)
    length[cut] = np.take_along_axis(stops - begins, order, axis=1)
    ends = np.append(0, np.cumsum(length.sum(axis=1)))
    to = np.cumsum(length.ravel()) - length.ravel()
    return data[moved(int(ends[-1]), to, source.ravel() - to)], ends


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    held = pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))
    )
    return held.cast(pa.string())


def transform(docs: DataFrame, seed: int = 1) -> DataFrame:
    """`docs` (doc_id, text) with n, form, prefix_chars, middle_chars and output.

    n counts code points. The two cuts of a text, whether it is cut at all (CUT
    of 100) and whether its suffix goes first (SUFFIX_FIRST of 100, form spm, else
    psm) are drawn from doc_id and `seed` alone. An empty text and one that holds
    a mark stay as they are, form plain with no counts, so outputs can be undone.

    A null text is empty; a null doc_id draws as the empty string. Repeated rows
    give repeated results, an empty table none. Columns with the new names are
    replaced, others stay. Any length of text is cut whole.
    """
    taken = docs.drop(*[f.name for f in FORMED])
    keep = taken.columns
    taken = taken.select("*", F.col("doc_id").cast("bigint").alias("_id"), F.col("text").cast("string").alias("_text"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "_text", BLOCK):
            data, offsets = arrays.utf8(part.column("_text"))
            n, plain, swapped, p, m, out, ends = form(data, offsets, draws(part.column("_id").to_pylist(), seed))
            names = np.select([plain, swapped], ["plain", "spm"], "psm")
            yield pa.record_batch(
                [*(part.column(c) for c in keep), pa.array(n), pa.array(names), pa.array(p, mask=plain),
                 pa.array(m, mask=plain), _strings(out, ends)],
                names=[*keep, *(f.name for f in FORMED)],
            )

    return taken.mapInArrow(cut, StructType([*docs.select(*keep).schema, *FORMED]))


def restore(formed: DataFrame, to: str = "restored") -> DataFrame:
    """`formed` with the text of every `output`, read from it and its `form` alone, in the column `to`.

    A null output is empty, a null form plain. An output whose marks do not fit
    its form is an error.
    """
    taken = formed.drop(to)

    def undo(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "output", BLOCK):
            data, offsets = arrays.utf8(part.column("output"))
            plain = np.array([f in (None, "plain") for f in part.column("form").to_pylist()], bool)
            texts = _strings(*unform(data, offsets, plain))
            yield pa.record_batch([*part.columns, texts], names=[*part.schema.names, to])

    return taken.mapInArrow(undo, StructType([*taken.schema, StructField(to, StringType())]))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every document."""
    formed = transform(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return restore(formed.drop("text")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )
