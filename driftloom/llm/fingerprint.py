"""Document fingerprints: context-triggered piecewise hashes and their likeness."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from driftloom.llm import arrays
from driftloom.llm.components import store

#: Bytes that decide whether a chunk ends.
WINDOW = 7
#: Chunks of a signature at most.
CHUNKS = 64
#: Two of these write a chunk's hash.
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
LARGEST = 40


def fingerprints(texts: list[str]) -> list[str]:
    """`block size:signature:signature at twice the size` of each text.

    A chunk ends where the hash of the last WINDOW bytes is a multiple of the
    block size, a power of two. It starts at a size that gives most texts more
    than CHUNKS chunks, and grows to the first that gives at most CHUNKS. A text
    with less than half as many there, as its windows are few and repeat, takes
    the next smaller size that gives half of CHUNKS, or 1; of more than CHUNKS
    the last takes the rest. Each chunk is written as two characters. So an edit changes the chunks it touches and no others, and
    equal texts have equal fingerprints.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * arrays.powers(arrays.ODD, n)[:-1], out=sums[1:])
    back = arrays.powers(arrays.INVERSE, n)
    # Window hashes by the byte behind them; those that begin in another text never count.
    hashes = np.ones(n + 1, np.uint64)
    if n >= WINDOW:
        hashes[WINDOW:] = arrays.mix((sums[WINDOW:] - sums[:-WINDOW]) * back[: n + 1 - WINDOW])
    start = np.maximum(1, np.floor(np.log2(np.maximum(sizes, 1) / CHUNKS)).astype(np.int64) - 1)
    at, owner, level = _ends(hashes, offsets, start)
    few = np.bincount(owner, minlength=len(raw)) + 1 < CHUNKS // 2
    if (few & (start > 0)).any():
        start[few] = 0
        at, owner, level = _ends(hashes, offsets, start)
    chosen = start.copy()
    open_ = np.ones(len(raw), bool)
    while open_.any():
        many = np.bincount(owner[level >= chosen[owner]], minlength=len(raw)) >= CHUNKS
        open_ = many & (chosen < LARGEST)
        chosen[open_] += 1
    while (few := (np.bincount(owner[level >= chosen[owner]], minlength=len(raw)) + 1 < CHUNKS // 2) & (chosen > start)).any():
        chosen[few] -= 1
    signatures = [_signatures(at, owner, level >= chosen[owner] + k, offsets, sums, back) for k in (0, 1)]
    return [f"{1 << k}:{a}:{b}" for k, a, b in zip(chosen.tolist(), *signatures)]


def _ends(hashes: np.ndarray, offsets: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where chunks end at block size 2 ** start, whose text that is, and up to which power it still is an end."""
    masks = np.repeat((np.uint64(1) << start.astype(np.uint64)) - np.uint64(1), np.diff(offsets))
    at = np.flatnonzero((hashes[1:] & masks) == 0) + 1
    owner = np.searchsorted(offsets, at, side="left") - 1
    inside = (at - offsets[owner] >= WINDOW) & (at < offsets[owner + 1])
    at, owner = at[inside], owner[inside]
    low = hashes[at] & (~hashes[at] + np.uint64(1))
    level = np.where(low == 0, 64, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64))).astype(np.int64)
    return at, owner, level


def _signatures(at, owner, used, offsets, sums, back) -> list[str]:
    at, owner = at[used], owner[used]
    # Of texts that have more ends at any block size, the first count.
    rank = np.arange(len(at)) - np.searchsorted(owner, owner)
    at = at[rank < CHUNKS - 1]
    starts = np.unique(np.concatenate([at, offsets[:-1][np.diff(offsets) > 0]]))
    ends = np.concatenate([starts[1:], offsets[-1:]]) if len(starts) else starts
    values = arrays.mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    text = np.empty((len(values), 2), np.uint8)
    text[:, 0] = ALPHABET[(values & np.uint64(63)).astype(np.int64)]
    text[:, 1] = ALPHABET[((values >> np.uint64(6)) & np.uint64(63)).astype(np.int64)]
    whole = text.tobytes().decode("ascii")
    cuts = (2 * np.searchsorted(starts, offsets)).tolist()
    return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


def _common(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Length of the longest common subsequence of chunks, and chunks of both together.

    One bit of a word stands for a chunk of `a`; the chunks of `b` are taken one
    after another for all pairs at once.
    """
    width = max([2, *map(len, a), *map(len, b)])
    width += width % 2

    def symbols(texts: list[str], pad: bytes) -> np.ndarray:
        return np.frombuffer(b"".join(t.encode().ljust(width, pad) for t in texts), np.uint16).reshape(len(texts), -1)

    x, y = symbols(a, b"\0"), symbols(b, b"\1")
    na, nb = np.array([len(t) // 2 for t in a]), np.array([len(t) // 2 for t in b])
    pad = np.zeros((len(a), CHUNKS - x.shape[1]), bool)
    state = np.full(len(a), ~np.uint64(0))
    for k in range(y.shape[1]):
        equal = np.concatenate([x == y[:, k:k + 1], pad], axis=1)
        match = np.packbits(equal, axis=1, bitorder="little").view(np.uint64)[:, 0]
        step = state & match
        state = (state + step) | (state - step)
    used = np.where(na >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(na, 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~state & used).astype(np.int64), na + nb


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints: one less the edit distance of the
    signatures (insertions and deletions of chunks) over their length.

    Signatures compare at equal block sizes; fingerprints one size apart compare
    at the size they share, others are at 0. Equal fingerprints are at 1.
    """
    left, right = [x.split(":") for x in a], [x.split(":") for x in b]
    best = np.array([float(x == y) for x, y in zip(a, b)])
    for i, j in ((1, 1), (2, 2), (1, 2), (2, 1)):
        rows = [
            k for k, (x, y) in enumerate(zip(left, right))
            if int(x[0]) * i == int(y[0]) * j and best[k] < 1 and (x[i] or y[j])
        ]
        if rows:
            common, both = _common([left[k][i] for k in rows], [right[k][j] for k in rows])
            best[rows] = np.maximum(best[rows], 2 * common / np.maximum(both, 1))
    return best


def edited(text: str, following: str) -> str:
    """The last quarter of `text` replaced by as much of the start of `following`."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compared(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Results of all texts but the last, each with the one behind it."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    own, new = fingerprints(texts), fingerprints(changed)
    shas = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
    return pa.record_batch(
        [
            pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array(shas),
            pa.array(own[:-1]), pa.array(new), pa.array(likeness(own[:-1], new)), pa.array(likeness(own[:-1], own[1:])),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _edge(ids: list, texts: list, which: int) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    empty = [pa.nulls(len(ids), t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
    return pa.record_batch(
        [pa.array(ids, pa.int64()), *empty, pa.array([part] * len(ids), pa.int64()),
         pa.array([which] * len(ids), pa.int32()), pa.array(texts, pa.string())],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
               "part", "edge", "text"],
    )


def _in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of a partition in order; its first and last text go out for the seams."""
    ids: list = []
    texts: list[str] = []
    first = True
    for part in arrays.slices(batches, "text"):
        ids += part.column("doc_id").to_pylist()
        texts += [t or "" for t in part.column("text").to_pylist()]
        if first:
            yield _edge(ids[:1], texts[:1], 1)
            first = False
        if len(ids) > 1:
            done = _compared(ids, texts)
            n = done.num_rows
            yield pa.record_batch(
                [*done.columns, pa.nulls(n, pa.int64()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.string())],
                names=[*done.schema.names, "part", "edge", "text"],
            )
        ids, texts = ids[-1:], texts[-1:]
    if ids:
        yield _edge(ids, texts, 2)


def _seams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield _compared([row["doc_id"], None], [row["text"] or "", row["following"] or ""])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of docs (doc_id, text) and of its edited text.

    The edited text ends in the start of the next document by ascending doc_id;
    the last document takes the first. Documents are laid out by range, so a
    task meets each with its next; only the first and last text of each partition
    are joined across. The text is shuffled once.

    A null text is empty. A null doc_id comes first; rows with one doc_id follow
    each other by text, so a repeated row's next is its copy. A table of one row
    is its own next. Further columns are ignored.
    """
    laid = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    )
    found = store(laid.mapInArrow(_in_order, f"{RESULT}, part bigint, edge int, text string"), "compared")
    first = found.where("edge = 1").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    # One row per partition that has rows.
    order = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = found.where("edge = 1").select("part").select(
        "part",
        F.coalesce(F.lead("part").over(Window.partitionBy().orderBy("part")), F.min("part").over(order)).alias("next_part"),
    )
    last = found.where("edge = 2").select("doc_id", "text", "part").join(parts, "part").join(first, "next_part")
    columns = [c.split()[0] for c in RESULT.split(", ")]
    return found.where("edge = 0").select(*columns).union(
        last.select("doc_id", "text", "following").mapInArrow(_seams, RESULT)
    )
