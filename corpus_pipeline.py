"""From documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. `run` writes each stage's rows to the shared
scratch folder and reads them again, so a lost executor repeats one stage only.
SQL can express none of the stages, so ORACLE_SQL is None; tests/llm hold them
against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftloom.llm import line_dedup, minhash, packing, secret_scan, toxicity
from driftloom.llm.components import store
from driftloom.llm.queries import tokenizer_path
from driftloom.session import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold of their language."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).where(~F.col("flagged")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines that stand in an earlier one."""
    return line_dedup.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each near-duplicate group.

    Documents without words are no copies of each other and stay. Rows that share
    a doc_id are one document and stay or go together.
    """
    gone = minhash.near_groups(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret masked."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of 4096."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's last rows over all documents of `sf_dir`."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
