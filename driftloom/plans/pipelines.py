"""From record files to cleaned texts, term counts and bags of words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftloom.functions.records import Steps, is_english, is_repost
from driftloom.functions.text import clean_text, tokenize_social
from driftloom.operators.numbering import number_rows
from driftloom.operators.sampling import sample_exact_n, sample_n_per_group
from driftloom.operators.vocabulary import bag_of_words, counts_in_documents, document_terms, term_counts
from driftloom.sources.scan import scan_json_records, scan_lines


def english_records(spark: SparkSession, paths: str | Sequence[str], include_reposts: bool = False) -> DataFrame:
    """(value, file, full_text) of the English records; a record without a
    language is not English. Reposts are known by their key."""
    records = scan_json_records(scan_lines(spark, paths), "full_text string, lang string")
    steps = Steps().add_filter(is_english("lang"))
    if not include_reposts:
        steps.add_filter(~is_repost("value"))
    return records.transform(steps.add_map(lambda df: df.select("value", "file", "full_text")))


def text_pipeline(
    spark: SparkSession, paths: str | Sequence[str], include_reposts: bool = False,
    num_samples: int | None = None, seed: int = 0,
) -> DataFrame:
    """(file, text): cleaned texts, optionally `num_samples` of them."""
    records = english_records(spark, paths, include_reposts)
    if num_samples is not None:
        keyed = records.withColumn("_key", F.concat_ws("#", "file", "value"))
        records = sample_exact_n(keyed, num_samples, "_key", seed)
    return records.select("file", clean_text("full_text").alias("text"))


def vocabulary_per_file(
    spark: SparkSession, paths: str | Sequence[str], include_reposts: bool = False, max_ngram_len: int = 2
) -> DataFrame:
    """(file, term, n, df): n-gram counts of every file."""
    texts = text_pipeline(spark, paths, include_reposts)
    terms = document_terms(texts, max_len=1, tokenize=tokenize_social)
    return term_counts(counts_in_documents(terms, max_len=max_ngram_len), ["file"])


def bags_per_file(
    spark: SparkSession, paths: str | Sequence[str], vocabulary: DataFrame, include_reposts: bool = False,
    samples_per_file: int | None = None, max_ngram_len: int = 2, seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(documents(file, doc_id), bag(file, doc_id, term_id, n)) for a fixed vocabulary.

    Every record is a document of its own, equal ones too: they are numbered in
    the order of file and line.
    """
    records = number_rows(english_records(spark, paths, include_reposts), ["file", "value"], name="doc_id")
    if samples_per_file is not None:
        records = sample_n_per_group(records, "file", samples_per_file, "doc_id", seed)
    texts = records.select("file", "doc_id", F.col("full_text").alias("text"))
    terms = document_terms(texts, max_len=1, tokenize=tokenize_social)
    counts = counts_in_documents(terms, max_len=max_ngram_len)
    return texts.select("file", "doc_id"), bag_of_words(counts, vocabulary)
