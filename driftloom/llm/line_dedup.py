"""Line dedup: content-defined chunks of lines, removed where their bytes repeat."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from driftloom.llm import arrays
from driftloom.llm.components import free_shuffles, store

#: A chunk has so many words at least.
LEAST_WORDS = 20
#: Bytes of text whose chunks are read at once for comparison.
BLOCK = 1 << 19

CHUNKS = "id bigint, key bigint, start bigint, end bigint, h1 bigint, h2 bigint"
SPANS = "array<struct<start:bigint,end:bigint,h1:bigint,h2:bigint,goes:boolean>>"


def rolled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of the lines first … last, for every pair, rolled over hashes of lines.

    A line counts with the blank lines behind it, but the last one ends with its
    own text. Sums over all lines so far give any run's hash in one step.
    """
    if not len(first):
        return np.empty(0, np.uint64)
    salt = arrays.mix(np.uint64(seed) + np.zeros(1, np.uint64))
    whole = arrays.mix(arrays.part_hashes(data, starts, np.append(starts[1:], ends[-1])) ^ salt)
    own = arrays.mix(arrays.part_hashes(data, starts, ends) ^ ~salt)
    sums = np.zeros(len(starts) + 1, np.uint64)
    np.cumsum((whole + np.uint64(1)) * arrays.powers(arrays.ODD, len(starts))[:-1], out=sums[1:])
    inner = (sums[last] - sums[first]) * arrays.powers(arrays.INVERSE, len(starts))[first]
    return arrays.mix(inner ^ arrays.mix(own[last] + (last - first).astype(np.uint64)))


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and end, in bytes of the text, and two hashes of each chunk.

    Every line with words is a boundary: from it the least run of lines down, and
    up, that holds LEAST_WORDS words is a chunk. Boundaries depend on nothing but
    the lines, so they shift with them; chunks inside a passage cover it from its
    first line to its last, whatever stands beside it. There are at most two a
    line. A chunk has the line feeds between its lines but not the last.
    """
    feeds = np.flatnonzero(data == 10)
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], feeds + 1)
    starts = starts[starts < len(data)]
    if not len(starts):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    marks = np.union1d(feeds, offsets[1:])
    ends = np.where(data[starts] == 10, starts, marks[np.searchsorted(marks, starts, side="right")])
    word_starts, _, _ = arrays.words(data, offsets)
    n_words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
    starts, ends, n_words = (x[n_words > 0] for x in (starts, ends, n_words))
    owner = np.searchsorted(offsets, starts, side="right") - 1
    n, sums = len(starts), np.append(0, np.cumsum(n_words))
    line = np.arange(n)
    down = np.searchsorted(sums[1:], sums[:-1] + LEAST_WORDS)
    up = np.searchsorted(sums[:-1], sums[1:] - LEAST_WORDS, side="right") - 1
    first, last = np.concatenate([line, up]), np.concatenate([down, line])
    inside = (first >= 0) & (last < n)
    first, last = first[inside], last[inside]
    pairs = np.unique((first * n + last)[owner[first] == owner[last]])
    first, last = pairs // max(n, 1), pairs % max(n, 1)
    who = owner[first]
    h1, h2 = (rolled(data, starts, ends, first, last, seed) for seed in (1, 2))
    return who, starts[first] - offsets[who], ends[last] - offsets[who], h1, h2


def _chunk_rows(bits: int):
    def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "_text"):
            data, offsets = arrays.utf8(part.column("_text"))
            who, a, z, h1, h2 = chunks(data, offsets)
            if bits < 128:
                h1, h2 = h1 >> np.uint64(64 - min(bits, 64)), h2 >> np.uint64(64 - max(1, bits - 64))
            rows = pa.array(who)
            yield pa.record_batch(
                [part.column("_id").take(rows), part.column("_key").take(rows), pa.array(a, pa.int64()),
                 pa.array(z, pa.int64()), pa.array(arrays.signed(h1)), pa.array(arrays.signed(h2))],
                names=["id", "key", "start", "end", "h1", "h2"],
            )
    return rows_of


def _chunk_bytes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of every span of every text."""
    for part in arrays.slices(batches, "_text", BLOCK):
        rows = []
        for i, text, key, spans in zip(*(part.column(c).to_pylist() for c in ("_id", "_text", "_key", "spans"))):
            raw = (text or "").encode()
            rows += [(i, key, s["start"], s["end"], s["h1"], s["h2"], raw[s["start"]:s["end"]]) for s in spans or ()]
        columns = list(zip(*rows)) or [()] * 7
        yield pa.record_batch(
            [*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())],
            names=["id", "key", "start", "end", "h1", "h2", "raw"],
        )


def _joined(spans: list[dict[str, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    found: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans if s["goes"]):
        if found and start < found[-1][1]:
            found[-1] = (found[-1][0], max(end, found[-1][1]))
        else:
            found.append((start, end))
    return found


def _remover(columns: list[str]):
    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices([batch], "_text"):
                texts, removed = [], []
                for text, spans in zip(part.column("_text").to_pylist(), part.column("spans").to_pylist()):
                    n = 0
                    if spans:
                        raw = text.encode()
                        kept, at = [], 0
                        for start, end in _joined(spans):
                            kept.append(raw[at:start])
                            at = min(len(raw), end + 1)
                            n += end - start
                        # A run at the end takes the line feed before it along.
                        rest = raw[at:]
                        text = (b"".join(kept) + rest).decode()
                        if n and at >= len(raw) and not raw.endswith(b"\n") and text.endswith("\n"):
                            text = text[:-1]
                    texts.append(text)
                    removed.append(n)
                yield pa.record_batch(
                    [*(part.column(c) for c in columns), pa.array(texts, pa.string()), pa.array(removed, pa.int64())],
                    names=[*columns, "_text", "_removed"],
                )
    return remove


def _key(docs: DataFrame) -> tuple[Column, Column]:
    missing = F.lit(-(2**63))
    return F.coalesce(F.col("doc_id").cast("bigint"), missing), F.xxhash64("doc_id", "text")


def _repeated(found: DataFrame, same: list[str]) -> DataFrame:
    """(same, first): the first place of what stands more than once."""
    place = F.struct("id", "key", "start", "end")
    return found.groupBy(*same).agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")


def _spans(again: DataFrame) -> DataFrame:
    """(_id, _key, spans) of chunks beside their first place; all but the first and what overlaps it go."""
    goes = (F.col("id") != F.col("first.id")) | (F.col("key") != F.col("first.key")) | (F.col("start") >= F.col("first.end"))
    return again.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(
        F.collect_set(F.struct("start", "end", "h1", "h2", goes.alias("goes"))).cast(SPANS).alias("spans")
    )


def _by_bytes(held: DataFrame, raw: DataFrame, clash: DataFrame) -> DataFrame:
    """`held` with the spans of hashes that several texts share decided by the texts."""
    again = raw.join(_repeated(raw, ["h1", "h2", "raw"]), ["h1", "h2", "raw"])
    right = _spans(again).withColumnRenamed("spans", "right")
    each = held.select("_id", "_key", F.explode("spans").alias("s")).select("_id", "_key", "s.*")
    wrong = each.join(clash, ["h1", "h2"], "left_semi").groupBy("_id", "_key").agg(
        F.collect_set(F.struct("start", "end", "h1", "h2", "goes")).cast(SPANS).alias("wrong")
    )
    none = F.array().cast(SPANS)
    joined = held.join(wrong, ["_id", "_key"], "left").join(right, ["_id", "_key"], "left")
    kept = F.concat(
        F.array_except(F.coalesce("spans", none), F.coalesce("wrong", none)), F.coalesce("right", none)
    )
    return joined.withColumn("spans", kept).drop("wrong", "right")


def without_repeats(docs: DataFrame, removed: str | None = None, bits: int = 128) -> DataFrame:
    """`docs` (doc_id, text, …) without chunks of lines that stand earlier in the table.

    Chunks (see `chunks`) are matched by rolling hashes, of which `bits` bits are
    used; then the bytes of all chunks of one hash are compared, so fewer bits only
    mean more comparisons. Whole lines go where they are part of a chunk
    whose bytes stand at a lesser doc_id or place, and not overlapping it. So of
    every line that goes, an earlier copy stays. They go with their line feeds.
    All rows and columns stay; n_chars, if there, is counted anew where text went,
    and `removed` names a column for the number of bytes taken out.

    A null text stays null. A text of repeats only becomes empty. Rows equal in
    doc_id and text count as one document and get the same result. A null doc_id
    comes first. Texts of any length are read whole; an empty table gives no
    rows. Other columns, whatever their names, are passed on.
    """
    columns = [c for c in docs.columns if c != "text"]
    plain = {c: f"_c{k}" for k, c in enumerate(columns)}
    id_, key = _key(docs)
    keyed = docs.select(
        id_.alias("_id"), key.alias("_key"), F.col("text").cast("string").alias("_text"),
        *[F.col(f"`{c}`").alias(n) for c, n in plain.items()],
    )
    found = store(keyed.select("_id", "_key", "_text").mapInArrow(_chunk_rows(bits), CHUNKS), "chunks")
    hashes = ["h1", "h2"]
    # Spans are few: texts are joined with them when the chunks' shuffles are gone.
    spans = store(_spans(found.join(_repeated(found, hashes), hashes)), "spans")
    free_shuffles(docs.sparkSession)
    held = store(keyed.join(spans, ["_id", "_key"], "left"), "held")
    free_shuffles(docs.sparkSession)
    # Bytes are compared by grouping them: a hash of several texts is no match of all its chunks.
    raw = held.where("spans is not null").mapInArrow(_chunk_bytes, f"{CHUNKS}, raw binary")
    clash = store(raw.select(*hashes, "raw").distinct().groupBy(*hashes).count().where("count > 1").select(*hashes), "clash")
    if clash.head(1):
        held = _by_bytes(held, raw.join(clash, hashes), clash)
    kept = [*plain.values()]
    types = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in plain.items())
    out = held.select("_text", "spans", *kept).mapInArrow(_remover(kept), f"{types}, _text string, _removed bigint")
    result = []
    for c in docs.columns:
        if c == "text":
            result.append(F.col("_text").alias("text"))
        elif c == "n_chars":
            counted = F.when(F.col("_removed") > 0, F.length("_text")).otherwise(F.col(plain[c]))
            result.append(counted.cast(docs.schema[c].dataType).alias(c))
        else:
            result.append(F.col(plain[c]).alias(c))
    return out.select(*result, *([F.col("_removed").alias(removed)] if removed else []))
