"""Scans of line, JSON and CSV files, and selections of inputs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from driftloom.functions.dates import DATE_HOUR, extract_date_hour
from driftloom.operators.numbering import top_n_per_group


def scan_lines(spark: SparkSession, paths: str | Sequence[str], **options) -> DataFrame:
    """(value, file): every line of the files, compressed ones included."""
    lines = spark.read.options(lineSep="\n", recursiveFileLookup=True, **options).text(paths)
    return lines.select("value", F.col("_metadata.file_path").alias("file"))


def count_lines(lines: DataFrame) -> DataFrame:
    """Lines per file."""
    return lines.groupBy("file").agg(F.count("*").alias("n_lines"))


def scan_json_records(
    lines: DataFrame, schema: StructType | str, mode: str = "FAILFAST", column: str = "value"
) -> DataFrame:
    """Parse one JSON record per line into the fields of `schema`.

    FAILFAST makes a malformed line an error. With PERMISSIVE such a line has
    null fields and its text in `_corrupt_record`, if the schema lists it. The
    raw line stays in `value`: presence of a key is tested on it.
    """
    parsed = F.from_json(column, schema, {"mode": mode})
    return lines.withColumn("_record", parsed).select(*lines.columns, "_record.*")


def valid_date_hour(date_hour: str, pattern: str = DATE_HOUR) -> bool:
    return re.fullmatch(pattern, date_hour) is not None


def in_range(
    name: Column, low: str | None = None, high: str | None = None, pattern: str = DATE_HOUR
) -> Column:
    """Whether a name holds a date-hour between the bounds, both inclusive.

    An open bound is allowed; a malformed one is an error.
    """
    for bound in (low, high):
        if bound is not None and not valid_date_hour(bound, pattern):
            raise ValueError(f"not a date-hour: {bound!r}")
    date_hour = extract_date_hour(name, pattern)
    inside = date_hour.isNotNull()
    if low is not None:
        inside &= date_hour >= low
    if high is not None:
        inside &= date_hour <= high
    return F.coalesce(inside, F.lit(False))


def scan_files_in_range(
    spark: SparkSession, path: str, low: str | None = None, high: str | None = None,
    pattern: str = DATE_HOUR, by: str = "file_name",
) -> DataFrame:
    """Lines of the files whose name lies in the range; other files are not opened.

    `by` is the part of a file's metadata that holds the date-hour.
    """
    lines = spark.read.options(lineSep="\n", recursiveFileLookup=True).text(path)
    name = F.col(f"_metadata.{by}")
    return lines.where(in_range(name, low, high, pattern)).select("value", name.alias("file"))


def scan_headlines_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(publish_date int, headline_text): CSV with header, malformed rows dropped.

    Column pruning is off because a row is recognised as malformed by all its fields.
    """
    return (
        spark.read.schema("publish_date int, headline_text string")
        .options(header=True, mode="DROPMALFORMED", escape='"', columnPruning=False)
        .csv(path)
    )


def scan_by_category(
    docs: DataFrame, categories: Sequence[str], n: int, column: str = "source", key: str = "doc_id"
) -> DataFrame:
    """The first n documents of each named category, categories in the stated order."""
    position = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(column)) - 1
    chosen = docs.where(F.col(column).isin(list(categories))).withColumn("category", position.cast("int"))
    return top_n_per_group(chosen, ["category"], [F.col(key)], n, "nth")
