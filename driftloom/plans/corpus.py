"""Tables the queries share, derived from `documents`.

English documents stand for the records; a source stands for a file and is the
time slice; the weights are TF-IDF over the (1, 2)-gram vocabulary, all terms of
it unless a query asks for fewer.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftloom.functions.records import is_english
from driftloom.operators.joins import hashed
from driftloom.operators.tensor import position_in_slice
from driftloom.operators.vocabulary import (
    counts_in_documents, document_terms, numbered_counts, select_vocabulary, term_counts, unit_weights,
)
from driftloom.session import read_table, release, spread, stored


def english(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, text) of the English documents."""
    docs = read_table(spark, folder, "documents").where(is_english("lang"))
    return spread(docs.select("doc_id", "source", "text"), "doc_id")


def english_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, term, n)."""
    return counts_in_documents(document_terms(english(spark, folder), max_len=1), max_len=2)


class Corpus:
    """The corpus tables; each is planned when first asked for."""

    def __init__(self, spark: SparkSession, folder: str, max_features: int | None, min_df: int):
        self.spark, self.folder = spark, folder
        self.max_features, self.min_df = max_features, min_df

    @cached_property
    def docs(self) -> DataFrame:
        """(doc_id, source)."""
        docs = read_table(self.spark, self.folder, "documents").where(is_english("lang"))
        return docs.select("doc_id", "source")

    @cached_property
    def n_docs(self) -> int:
        return self.docs.count()

    @cached_property
    def counts(self) -> DataFrame:
        """(doc_id, source, term, n). Written, as the vocabulary and the weights both
        read it: the texts are tokenised once."""
        return stored(english_counts(self.spark, self.folder), "counts")

    @cached_property
    def vocabulary(self) -> DataFrame:
        """(term_id, term, n, df, idf). Written, as all that is below reads it again;
        Spark knows its size and may broadcast a small one."""
        stats = term_counts(self.counts)
        selected = select_vocabulary(stats, self.n_docs, self.max_features, self.min_df)
        out = stored(selected, "vocabulary")
        release(selected._laid)
        return out

    @cached_property
    def n_terms(self) -> int:
        return self.vocabulary.count()

    @cached_property
    def lookup(self) -> DataFrame:
        """The vocabulary as the side of a join by term."""
        return hashed(self.vocabulary, self.n_terms)

    @cached_property
    def numbered(self) -> DataFrame:
        """(doc_id, source, n, term_id, idf): the counts by term id. Written, so that the
        shuffles of texts have ended before those of ids begin."""
        return stored(numbered_counts(self.counts, self.lookup), "numbered")

    @cached_property
    def weights(self) -> DataFrame:
        """(doc_id, source, term_id, x)."""
        return unit_weights(self.numbered)

    @cached_property
    def entries(self) -> DataFrame:
        """(doc_id, term_id, x): the weights, written, for learners, which read them again and again.

        They stand for the counts, which are given up.
        """
        return self.written(self.weights.select("doc_id", "term_id", "x"), "entries")

    def written(self, made: DataFrame, name: str) -> DataFrame:
        """`made`, of the weights, written in place of the counts: learners read nothing else of the texts."""
        self.give_up("counts")
        out = stored(made, name)
        self.give_up("weights", "numbered")
        return out

    def give_up(self, *names: str) -> None:
        """Remove tables; one that is asked for again is made anew."""
        release(*[vars(self).pop(name, None) for name in names])


def corpus(
    spark: SparkSession, folder: str, max_features: int | None = None, min_df: int = 1
) -> Corpus:
    return Corpus(spark, folder, max_features, min_df)


def slices(data: Corpus) -> DataFrame:
    """(doc_id, source, t, d)."""
    return position_in_slice(data.docs, "source")


def cells(data: Corpus) -> DataFrame:
    """(t, v, d, x): the tensor's nonzero cells."""
    places = slices(data).select("doc_id", "t", F.col("d").cast("int").alias("d"))
    # Those that are written, if a learner has asked for them.
    weights = data.entries if "entries" in vars(data) else data.weights
    return weights.join(places, "doc_id").select("t", F.col("term_id").alias("v"), "d", "x")


def written_cells(data: Corpus) -> DataFrame:
    """The same, written in place of the counts."""
    return data.written(cells(data), "cells")


def dims(data: Corpus) -> dict[str, int]:
    """Sizes of the tensor's axes: slices, terms, documents of the largest slice."""
    n_slices, n_docs = data.docs.groupBy("source").count().agg(F.count("*"), F.max("count")).first()
    return {"t": n_slices, "v": data.n_terms, "d": n_docs}
