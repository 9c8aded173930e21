"""Predicates and projections over records; the `Steps` chain."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def has_field(record: Column | str, key: str) -> Column:
    """Whether a JSON record holds the key at all; a null value counts as held."""
    return F.coalesce(F.array_contains(F.json_object_keys(_col(record)), key), F.lit(False))


def is_repost(record: Column | str, key: str = "retweeted_status") -> Column:
    return has_field(record, key)


def has_location(record: Column | str) -> Column:
    return has_field(record, "place")


def is_english(lang: Column | str) -> Column:
    """Strict: a record without a language is not English."""
    return _col(lang) == "en"


def is_english_lenient(lang: Column | str) -> Column:
    """Lenient: a record without a language passes."""
    return F.coalesce(_col(lang), F.lit("en")) == "en"


def record_text(record: Column | str, key: str = "full_text") -> Column:
    return F.variant_get(F.parse_json(_col(record)), f"$.{key}", "string")


def keep_keys(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Keep the listed columns; names the table lacks are ignored."""
    return df.select([key for key in keys if key in df.columns])


def keep_map_keys(column: Column | str, keys: Iterable[str]) -> Column:
    """The same for a map column."""
    keys = list(keys)
    return F.map_filter(_col(column), lambda key, _: key.isin(keys))


def has_letter(term: Column | str) -> Column:
    """Whether a term holds an English letter."""
    return _col(term).rlike("[a-zA-Z]")


def guard_nonnegative(value: Column | str, tolerance: float = 1e-7) -> Column:
    """The value itself; the query fails on one below -tolerance."""
    value = _col(value)
    message = F.lit("negative value where only nonnegative ones are allowed")
    return F.when(value < -tolerance, F.raise_error(message).cast("double")).otherwise(value)


@dataclass(frozen=True)
class Call:
    """A user's function on records: a filter, or a map to records of `schema`."""

    fn: Callable[[dict], object]
    name: str
    schema: StructType | None = None

    def run(self, rows: list[dict]) -> list[dict]:
        out = []
        for row in rows:
            try:
                found = self.fn(dict(row))
            except Exception as error:
                raise RuntimeError(f"step {self.name!r} failed: {type(error).__name__}: {error}") from error
            if self.schema is None:
                if not isinstance(found, bool):
                    raise TypeError(f"step {self.name!r}: a filter gives True or False, not {found!r}")
                if found:
                    out.append(row)
                continue
            if not isinstance(found, dict) or set(found) != set(self.schema.names):
                raise TypeError(f"step {self.name!r}: a record of {self.schema.names} was due, not {found!r}")
            out.append(found)
        return out

    def typed(self, rows: list[dict]) -> pa.RecordBatch:
        try:
            return pa.RecordBatch.from_pylist(rows, to_arrow_schema(self.schema))
        except (pa.ArrowInvalid, pa.ArrowTypeError) as error:
            raise TypeError(f"step {self.name!r}: {error}") from error


def run_calls(df: DataFrame, calls: Sequence[Call]) -> DataFrame:
    """Apply functions in a row to every record, Arrow batch by batch, in one pass.

    Filters alone leave a batch's columns as they are; a map's records are
    checked against its schema.
    """
    last = next((c for c in reversed(calls) if c.schema is not None), None)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            if last is None:
                places = [{**row, _PLACE: k} for k, row in enumerate(rows)]
                for call in calls:
                    seen = Call(lambda row, f=call.fn: f({k: v for k, v in row.items() if k != _PLACE}), call.name)
                    places = seen.run(places)
                yield batch.take(pa.array([row[_PLACE] for row in places], pa.int64()))
                continue
            for call in calls:
                rows = call.run(rows)
                if call.schema is not None:
                    made = call.typed(rows)
            if calls[-1] is not last:
                made = last.typed(rows)
            yield made

    return df.mapInArrow(work, df.schema if last is None else last.schema)


_PLACE = "\0place"


class Steps:
    """An ordered chain of filters and maps applied to a DataFrame.

    Steps are Columns and DataFrame functions, or functions on single records,
    which come as dicts; neighbouring ones of the latter run in one pass. An error
    in such a function names its step.
    """

    def __init__(self, *steps: Callable[[DataFrame], DataFrame] | Call):
        self.steps = list(steps)

    def add_filter(self, condition: Column | Callable[[DataFrame], Column]) -> Steps:
        self.steps.append(lambda df: df.where(condition(df) if callable(condition) else condition))
        return self

    def add_map(self, step: Callable[[DataFrame], DataFrame]) -> Steps:
        self.steps.append(step)
        return self

    def _name(self, fn: Callable, name: str | None) -> str:
        return name or f"{len(self.steps)}: {getattr(fn, '__name__', type(fn).__name__)}"

    def add_record_filter(self, keep: Callable[[dict], bool], name: str | None = None) -> Steps:
        """Keep the records for which `keep` is True."""
        self.steps.append(Call(keep, self._name(keep, name)))
        return self

    def add_record_map(self, change: Callable[[dict], dict], schema: StructType | str, name: str | None = None) -> Steps:
        """Replace each record by one of `schema`."""
        typed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.steps.append(Call(change, self._name(change, name), typed))
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        for calls, steps in groupby(self.steps, key=lambda step: isinstance(step, Call)):
            if calls:
                df = run_calls(df, list(steps))
            else:
                for step in steps:
                    df = df.transform(step)
        return df
