"""The registered queries of the operators on training text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftloom.llm import (
    chat,
    embedding_dedup,
    exact_dedup,
    fill_middle,
    fingerprint,
    line_dedup,
    minhash,
    packing,
    pii,
    piece_codec,
    resampling,
    secret_scan,
    toxicity,
)
from driftloom.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate group of every document."""
    return minhash.near_groups(read_table(spark, folder, "documents"))


@query
def op7_range_join(spark: SparkSession, folder: str) -> DataFrame:
    """Links, components and kept vectors within each label, at a cosine of 0.93."""
    return embedding_dedup.near_vectors(read_table(spark, folder, "embeddings"))


@query
def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprint.compare_with_next(read_table(spark, folder, "documents"))


@query
def op4_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document, each distinct text scanned once."""
    return secret_scan.scan_documents(read_table(spark, folder, "documents"))


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels outside the held-out fifth."""
    return toxicity.judged(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query
def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: fixed patterns, and what the network adds."""
    return pii.scan_documents(read_table(spark, folder, "documents"))


@query
def op9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    return piece_codec.encoded_documents(read_table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's token pieces and their places in sequences of 4096."""
    return packing.pack_documents(read_table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without repeated chunks of lines."""
    return line_dedup.without_repeats(read_table(spark, folder, "documents"), removed="removed_bytes")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_chat_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations that no longer one begins with, rendered."""
    return chat.format_conversations(read_table(spark, folder, "conversations"))


ORACLES["op2_chat_snapshots"] = """
WITH numbered AS (
    SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
    FROM conversations
), whole AS (
    SELECT conv_id, count(*) AS n, list({'role': role, 'text': text} ORDER BY pos) AS turns
    FROM numbered GROUP BY conv_id
), kept AS (
    SELECT conv_id, n FROM whole AS s
    WHERE NOT EXISTS (
        SELECT 1 FROM whole AS t
        WHERE t.turns[1] = s.turns[1] AND t.turns[1:s.n] = s.turns AND (t.n > s.n OR (t.n = s.n AND t.conv_id < s.conv_id))
    )
)
SELECT conv_id, (pos - 1) // 1000 AS part, n AS n_turns,
       string_agg('<|im_start|>' || replace(role, '<|im_', '<| im_') || chr(10)
                  || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM numbered JOIN kept USING (conv_id)
GROUP BY conv_id, (pos - 1) // 1000, n
"""


@query
def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Group of every document among those of equal text, white space aside."""
    return exact_dedup.exact_groups(read_table(spark, folder, "documents"))


ORACLES["op11_exact_dedup"] = r"""
WITH texts AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS held
    FROM documents
), grouped AS (
    SELECT doc_id, first_value(doc_id) OVER (PARTITION BY held ORDER BY n DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY held) AS group_size, sha256(held) AS text_sha256
    FROM texts
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped
"""


@query
def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its middle moved to the end, and what undoing that gives."""
    return fill_middle.digests(read_table(spark, folder, "documents"))


ORACLES["op12_fill_middle"] = """
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents
), cuts AS (
    SELECT doc_id, text, n,
           least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS m,
           CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
                 ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM drawn)
), parts AS (
    SELECT *, substring(text, 1, p) AS a, substring(text, p + 1, m - p) AS b, substring(text, m + 1) AS c FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN m - p END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
                   ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


@query
def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's weight towards the benchmark texts, its score, and its place among those drawn."""
    return resampling.resample(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


ORACLES["op13_resampling"] = r"""
WITH RECURSIVE bits AS (
    SELECT i, i AS c, 0 AS k FROM range(256) AS r(i)
    UNION ALL
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crcs AS MATERIALIZED (SELECT list(c ORDER BY i) AS steps FROM bits WHERE k = 8),
texts AS (
    SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents
    UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark
), found AS (
    SELECT side, id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
    FROM texts
), counted AS MATERIALIZED (SELECT side, id, word, count(*) AS n FROM found GROUP BY ALL),
sums AS MATERIALIZED (
    SELECT word, xor(list_reduce(
        list_prepend(4294967295, list_transform(range(1, strlen(word) * 2, 2), lambda k: ('0x' || hex(encode(word))[k:k + 1])::BIGINT)),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT word FROM counted), crcs
), buckets AS (
    SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t
    FROM counted JOIN sums USING (word) GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (ss + 10000) / ((s::DOUBLE + 1) * (tt + 10000))))::BIGINT AS gain
    FROM buckets, (SELECT sum(s)::DOUBLE AS ss, sum(t)::DOUBLE AS tt FROM buckets)
), weighed AS (
    SELECT id AS doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
    FROM counted JOIN sums USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM documents LEFT JOIN weighed USING (doc_id)
), placed AS (
    SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id) AS place,
           count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS drawn
    FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM placed
"""
