"""Top records and corpora built from ranked or sampled slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftloom.operators.numbering import top_n_per_group
from driftloom.operators.sampling import sample_n_per_group


def top_k_records(
    records: DataFrame, k: int, score: str, key: str, distinct: bool = False
) -> DataFrame:
    """The k highest scores, in order; equal scores are decided by the higher key.

    Records without a score or a key come last. `distinct` first drops repeated
    keys, for inputs that may hold a record twice; otherwise each counts. Every
    task keeps its k best, so k is the length of a report, not a share of a table.
    """
    if distinct:
        records = records.dropDuplicates([key])
    return records.orderBy(F.desc_nulls_last(score), F.desc_nulls_last(key)).limit(k)


def top_k_per_slice(records: DataFrame, slice_column: str, k: int, score: str, key: str) -> DataFrame:
    """The k highest scores of each slice, with their rank."""
    return top_n_per_group(records, [slice_column], [F.desc(score), F.desc(key)], k)


def first_last_per_slice(files: DataFrame, slice_column: str, name: str) -> DataFrame:
    """First and last file name of each slice in name order."""
    return files.groupBy(slice_column).agg(F.min(name).alias("first_file"), F.max(name).alias("last_file"))


def build_corpus_topk(ranked: DataFrame, slice_column: str, k: int, skip: int = 0) -> DataFrame:
    """Flatten ranked slices to one corpus: k rows per slice, leaving out the
    first `skip` slices; rows are ordered by slice, then rank."""
    kept = ranked.where((F.col(slice_column) >= skip) & (F.col("rank") <= k))
    moved = F.col(slice_column) - skip
    return kept.withColumn("t", moved.cast("int")).withColumn("d", (F.col("rank") - 1).cast("int"))


def build_corpus_random(
    docs: DataFrame, slice_column: str, k: int, key: str, skip: int = 0, seed: int = 0
) -> DataFrame:
    """The same with k random rows per slice."""
    drawn = sample_n_per_group(docs.where(F.col(slice_column) >= skip), slice_column, k, key, seed)
    moved = F.col(slice_column) - skip
    return drawn.withColumn("t", moved.cast("int")).withColumn("d", (F.col("draw") - 1).cast("int"))
