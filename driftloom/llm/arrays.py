"""Texts of an Arrow batch as flat byte arrays, and hashes of their parts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once: bounds a task's memory, whatever the batch.
BLOCK = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
#: ODD * INVERSE is 1 modulo 2 ** 64.
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text in a cut is at most `limit` bytes or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        row = 0
        while row < batch.num_rows:
            before = ends[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(row, stop - row)
            row = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes in a row and where each text starts; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 … base ** n, modulo 2 ** 64."""
    known = _powers.get(int(base))
    if known is None or len(known) <= n:
        steps = np.full(max(n, BLOCK) + 1, base)
        steps[0] = 1
        known = _powers[int(base)] = np.cumprod(steps, dtype=np.uint64)
    return known[: n + 1]


def part_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of every data[start:end]; equal parts hash alike."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(ODD, len(data))[:-1], out=sums[1:])
    whole = (sums[ends] - sums[starts]) * powers(INVERSE, len(data))[starts]
    return mix(whole + (ends - starts).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def words(
    data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without a byte in `breaks` (ASCII white space),
    and the number of words before each text."""
    space = np.ones(len(data) + 1, bool)
    space[:-1] = breaks[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    begins = ~space
    begins[1:] &= space[:-1] | first[1:]
    starts = np.flatnonzero(begins)
    # A word ends at white space or where the next text begins.
    stops = space | first
    marks = np.flatnonzero(stops)
    ends = marks[np.searchsorted(marks, starts, side="right")] if len(starts) else starts
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by `keys` as tables that never cut a group, with each group's first row.

    The last group of a batch waits for the next batch, so memory holds one
    batch and one group.
    """
    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table])
        starts = _firsts(table, keys)
        if len(starts) > 1:
            yield table.slice(0, int(starts[-1])).combine_chunks(), starts[:-1]
        kept = table.slice(int(starts[-1]))
    if kept is not None and kept.num_rows:
        yield kept.combine_chunks(), _firsts(kept, keys)


def _firsts(table: pa.Table, keys: list[str]) -> np.ndarray:
    changed = np.zeros(table.num_rows, bool)
    changed[0] = True
    for key in keys:
        value = table.column(key).to_numpy()
        changed[1:] |= value[1:] != value[:-1]
    return np.flatnonzero(changed)
