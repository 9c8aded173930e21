"""Term counts, vocabulary selection, bags of words and TF-IDF weights.

Document tables carry `doc_id`, optional grouping columns such as `slice`, and
the array column `terms`. Counting inside a document happens in its task, so
only per-document counts reach the one shuffle by term.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from driftloom.functions.stopwords import STOPWORDS, remove_stopwords
from driftloom.functions.text import clean_text, ngrams, tokenize_words
from driftloom.operators.joins import hashed
from driftloom.operators.numbering import number_rows
from driftloom.session import stored

#: Terms of documents that are counted at once; a longer document stands alone.
TERMS_AT_ONCE = 1 << 19

def document_terms(
    docs: DataFrame, text: str = "text", max_len: int = 2, stop: Sequence[str] = STOPWORDS,
    tokenize=tokenize_words,
) -> DataFrame:
    """Replace the text column by `terms`: clean, tokenise, stop words, n-grams."""
    words = remove_stopwords(tokenize(clean_text(text)), stop)
    terms = words if max_len == 1 else ngrams(words, max_len)
    return docs.withColumn("terms", terms).drop(text)


def counts_in_documents(docs: DataFrame, terms: str = "terms", max_len: int = 1) -> DataFrame:
    """One row (…, term, n) per document and distinct term, or run of up to `max_len` terms joined by a space.

    Counted Arrow batch by batch inside the tasks; a document without terms has no rows.
    """
    rest = [c for c in docs.columns if c != terms]
    counted = "array<struct<term:string,n:bigint>>"
    schema = StructType([*(docs.schema[c] for c in rest), StructField("_counts", StructType.fromDDL(f"c {counted}")[0].dataType)])
    rows = docs.select(*rest, F.col(terms).alias("_terms")).mapInArrow(partial(_counted, max_len=max_len), schema)
    return rows.select(*rest, F.explode("_counts").alias("_c")).select(*rest, "_c.term", "_c.n")


def _counted(batches: Iterable[pa.RecordBatch], max_len: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("_terms")), 0).to_numpy())
        lo = 0
        while lo < len(ends):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + TERMS_AT_ONCE, side="right")))
            part = batch.slice(lo, hi - lo)
            rest = [c for c in part.schema.names if c != "_terms"]
            counts = ngram_counts(part.column("_terms"), max_len)
            yield pa.record_batch([*(part.column(c) for c in rest), counts], names=[*rest, "_counts"])
            lo = hi


def ngram_counts(lists: pa.ListArray, max_len: int = 1) -> pa.ListArray:
    """For each list its distinct runs of 1..max_len strings and how often they occur, as (term, n)."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    words, of = lists.flatten(), np.repeat(np.arange(len(sizes)), sizes)
    found, rows = [words], [of]
    for n in range(2, max_len + 1):
        starts = np.flatnonzero(of[: max(0, len(of) - n + 1)] == of[n - 1:])
        found.append(pc.binary_join_element_wise(*[words.take(pa.array(starts + k)) for k in range(n)], " "))
        rows.append(of[starts])
    # Equal strings are one term, whatever number of words they were made of.
    coded = pa.chunked_array(found).combine_chunks().dictionary_encode(null_encoding="encode")
    width = max(1, len(coded.dictionary))
    pairs, n = np.unique(np.concatenate(rows) * width + coded.indices.to_numpy(), return_counts=True)
    terms = coded.dictionary.take(pa.array(pairs % width))
    offsets = np.searchsorted(pairs // width, np.arange(len(sizes) + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([terms, pa.array(n.astype(np.int64))], ["term", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def term_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(…by, term, n, df): occurrences and documents per term."""
    return counts.groupBy(*by, "term").agg(F.sum("n").alias("n"), F.count("*").alias("df"))


def combined_vocabulary(per_file: DataFrame) -> DataFrame:
    """Totals over per-file count tables (term, n, …)."""
    return per_file.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def within_df(stats: DataFrame, n_docs: int, min_df: int | float, max_df: int | float) -> DataFrame:
    """Cut by document frequency: int = documents, float = share; both inclusive."""
    low = min_df * n_docs if isinstance(min_df, float) else min_df
    high = max_df * n_docs if isinstance(max_df, float) else max_df
    return stats.where((F.col("df") >= low) & (F.col("df") <= high))


def select_vocabulary(
    stats: DataFrame, n_docs: int, max_features: int | None = 5000,
    min_df: int | float = 1, max_df: int | float = 1.0,
) -> DataFrame:
    """(term_id, term, n, df, idf) of the most frequent terms, ids alphabetical.

    Equal counts are decided by term; None takes all terms. Terms are cut and
    numbered by distributed sorts, however many there are.
    """
    idf = F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1
    kept = within_df(stats, n_docs, min_df, max_df).select("term", "n", "df")
    if max_features is not None:
        ranked = number_rows(kept.withColumn("_less", -F.col("n")), ["_less", "term"])
        kept = ranked.where(F.col("pos") < max_features).select("term", "n", "df")
    numbered = number_rows(kept, ["term"], name="term_id")
    out = numbered.select(F.col("term_id").cast("int"), "term", "n", "df", idf.alias("idf"))
    out._laid = numbered._laid
    return out


def bag_of_words(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Counts of the known terms: (…, term_id, n). Documents without any known
    term have no rows; they stay in the document table."""
    lookup = vocabulary.select("term", "term_id")
    return counts.join(lookup, "term").drop("term")


def tfidf(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(…, term_id, x): n * idf scaled to length 1 per document.

    The one shuffle, by document, is also the layout the learners need.
    """
    return unit_weights(numbered_counts(counts, vocabulary))


def numbered_counts(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(…, n, term_id, idf): counts with terms replaced by their ids."""
    return counts.join(vocabulary.select("term", "term_id", "idf"), "term").drop("term")


def unit_weights(numbered: DataFrame) -> DataFrame:
    """(…, term_id, x): n * idf scaled to length 1 per document, of `numbered_counts`."""
    weighted = numbered.withColumn("_w", F.col("n") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("doc_id")))
    return weighted.withColumn("x", F.col("_w") / length).drop("n", "idf", "_w")


def tfidf_per_slice(
    counts: DataFrame, vocabulary: DataFrame, docs_per_slice: DataFrame
) -> DataFrame:
    """The same with df and idf taken inside each slice.

    `docs_per_slice(slice, n_docs)`; df rows are at most slices x vocabulary.
    """
    return unit_weights_per_slice(stored(numbered_counts(counts, vocabulary), "numbered"), docs_per_slice)


def unit_weights_per_slice(numbered: DataFrame, docs_per_slice: DataFrame) -> DataFrame:
    """The weights of `tfidf_per_slice` of `numbered_counts`, which are read twice.

    Only ids are shuffled. The df rows are written, as their number decides how they are joined.
    """
    df = numbered.groupBy("term_id", "slice").agg(F.count("*").alias("_df"))
    idf = F.log((1 + F.col("n_docs")) / (1 + F.col("_df"))) + 1
    idfs = stored(df.join(docs_per_slice, "slice").select("term_id", "slice", idf.alias("idf")), "idfs")
    return unit_weights(numbered.drop("idf").join(hashed(idfs, idfs.count()), ["term_id", "slice"]))


def log2_tfidf(counts: DataFrame, vocabulary: DataFrame, n_docs: int) -> DataFrame:
    """The bag weighting used before LDA: n * log2(N / df), length 1 per document.

    Terms found in every document weigh 0 and are left out.
    """
    idf = F.log2(F.lit(n_docs) / F.col("df"))
    lookup = vocabulary.select("term", "term_id", idf.alias("_idf"))
    weighted = counts.join(lookup, "term").withColumn("_w", F.col("n") * F.col("_idf")).where("_w > 0")
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("doc_id")))
    return weighted.withColumn("x", F.col("_w") / length).drop("term", "n", "_idf", "_w")
