"""Shared SQL of the oracle queries: the corpus tables as common table expressions."""

from __future__ import annotations

from driftloom.functions.stopwords import STOPWORDS
from driftloom.functions.text import LINK, WORD


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOP = quoted(STOPWORDS)


def clean(text: str) -> str:
    """No look-behind in this dialect: the character before a tag is captured."""
    unlinked = f"regexp_replace({text}, '{LINK}', '', 'g')"
    return rf"regexp_replace({unlinked}, '(^|[^a-zA-Z0-9_.-])@[A-Za-z]+[A-Za-z0-9_-]+', '\1', 'g')"


def tokens(text: str, stop: bool = True) -> str:
    words = f"regexp_extract_all(lower({text}), '{WORD}')"
    return f"list_filter({words}, lambda w: w NOT IN ({STOP}))" if stop else words


def with_bigrams(words: str) -> str:
    pairs = f"list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1])"
    return f"list_concat({words}, {pairs})"


def uniform(*parts) -> str:
    """Uniform number in [0, 1) from the md5 of the parts, as in the samplers."""
    return f"(({hashed(*parts)}) / 4294967296.0::DOUBLE)"


def hashed(*parts) -> str:
    text = " || '#' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


DOCS = f"docs AS (SELECT doc_id, source, {clean('text')} AS body FROM documents WHERE lang = 'en')"
TOKENS = f"toks AS (SELECT doc_id, source, {tokens('body')} AS words FROM docs)"
TERMS = f"terms AS (SELECT doc_id, source, unnest({with_bigrams('words')}) AS term FROM toks)"
COUNTS = "counts AS (SELECT doc_id, source, term, count(*)::BIGINT AS n FROM terms GROUP BY ALL)"
STATS = "stats AS (SELECT term, sum(n)::BIGINT AS n, count(*) AS df FROM counts GROUP BY term)"
SLICES = """slices AS (SELECT doc_id, source, (dense_rank() OVER (ORDER BY source) - 1)::INT AS t,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS d FROM docs)"""


def vocab(max_features: int | None = None, min_df: int = 1) -> str:
    limit = "" if max_features is None else f"LIMIT {max_features}"
    return f"""picked AS (SELECT term, n, df FROM stats WHERE df >= {min_df} ORDER BY n DESC, term {limit}),
    vocab AS (SELECT (row_number() OVER (ORDER BY term) - 1)::INT AS term_id, term, n, df,
        ln((1 + (SELECT count(*) FROM docs)) / (1 + df)) + 1 AS idf FROM picked)"""


WEIGHTS = """weights AS (SELECT doc_id, source, term_id, counts.n * idf AS w FROM counts JOIN vocab USING (term)),
    tfidf AS (SELECT doc_id, source, term_id, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM weights)"""
CELLS = "cells AS (SELECT t, term_id AS v, d::INT AS d, x FROM tfidf JOIN slices USING (doc_id))"



def with_corpus(body: str, *more: str, upto: str = "cells", vocabulary: str | None = None) -> str:
    """A query over the corpus tables, which are listed as far as `upto`; all terms are in the vocabulary unless it is given."""
    parts = {
        "docs": DOCS, "toks": TOKENS, "terms": TERMS, "counts": COUNTS, "stats": STATS,
        "vocab": vocabulary or vocab(), "tfidf": WEIGHTS, "slices": SLICES, "cells": CELLS,
    }
    names = list(parts)
    ctes = [parts[n] for n in names[: names.index(upto) + 1]]
    return "WITH " + ",\n".join([*ctes, *more]) + "\n" + body
