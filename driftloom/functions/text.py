"""Text cleaning, tokens, n-grams and emoji as Column expressions.

Space is spelled out in the patterns (`SPACE`), because the engines' `\\s`
differ on non-ASCII space characters.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINK = rf"https?://[^{SPACE}]+"
USER_TAG = r"(?<![a-zA-Z0-9\-_.])@[A-Za-z]+[A-Za-z0-9\-_]+"
WORD = r"[\p{L}\p{N}_]{2,}"

# Social-media tokens, first alternative wins: links, e-mail addresses,
# emoticons, handles, tags, words with inner ' or -, numbers, other words,
# runs of dots, any other visible character.
EMOTICON = r"(?:[<>]?[:;=][-'^o]?[)(\]\[dDpP/\\|}{@*3]|<3)"
SOCIAL = "|".join([
    rf"https?://[^{SPACE}<>]+|www\.[^{SPACE}<>]+",
    r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)*",
    EMOTICON,
    r"@[\p{L}\p{N}_]+",
    r"#[\p{L}\p{N}_]+",
    r"\p{L}[\p{L}'’_-]+\p{L}",
    r"[+-]?\p{N}+(?:[,/.:-]\p{N}+)*[+-]?",
    r"[\p{L}\p{N}_]+",
    r"\.(?:[\x20\x09]*\.)+",
    rf"[^{SPACE}]",
])

_PICTURE = (
    r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}"
    r"\x{231A}\x{231B}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{2934}\x{2935}\x{25AA}\x{25AB}"
    r"\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}"
    r"\x{21A9}\x{21AA}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F004}\x{1F0CF}\x{1F170}\x{1F171}"
    r"\x{1F17E}\x{1F17F}\x{1F18E}\x{1F191}-\x{1F19A}\x{1F201}\x{1F202}\x{1F21A}\x{1F22F}"
    r"\x{1F232}-\x{1F23A}\x{1F250}\x{1F251}]"
)
_STYLED = _PICTURE + r"[\x{FE0F}\x{1F3FB}-\x{1F3FF}]*"
EMOJI = (
    rf"(?:[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}|[0-9#*]\x{{FE0F}}?\x{{20E3}}|{_STYLED}(?:\x{{200D}}{_STYLED})*)"
)


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and hand it to `body` as a variable."""
    return F.transform(F.array(value), body)[0]


def remove_links(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), F.lit(LINK), F.lit(""))


def remove_user_tags(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), F.lit(USER_TAG), F.lit(""))


def clean_text(text: Column | str) -> Column:
    """Links first, then tags."""
    return remove_user_tags(remove_links(text))


def tokenize_words(text: Column | str) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(0))


def tokenize_social(text: Column | str, preserve_case: bool = False) -> Column:
    """Social-media tokens; emoticons keep their case when words lose it."""
    tokens = F.regexp_extract_all(_col(text), F.lit(SOCIAL), F.lit(0))
    if preserve_case:
        return tokens
    emoticon = f"^{EMOTICON}$"
    return F.transform(tokens, lambda w: F.when(w.rlike(emoticon), w).otherwise(F.lower(w)))


def ngrams(tokens: Column | str, max_len: int, delimiter: str = " ", min_len: int = 1) -> Column:
    """All n-grams of min_len..max_len tokens: shorter ones first, in text order."""

    def of_length(n: int, words: Column) -> Column:
        if n == 1:
            return words
        joined = F.transform(
            F.sequence(F.lit(1), F.size(words) - (n - 1)),
            lambda i: F.array_join(F.slice(words, i, n), delimiter),
        )
        return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))

    return let(
        _col(tokens),
        lambda words: F.concat(*[of_length(n, words) for n in range(min_len, max_len + 1)]),
    )


def term_counts_in_row(terms: Column | str) -> Column:
    """Count the terms of one array: array of (term, n), ordered by term.

    Runs of equal terms are found in the sorted array, so a document's counts
    need no shuffle.
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        counted = let(
            starts,
            lambda first: F.transform(
                first,
                lambda i, nth: F.struct(
                    F.get(ordered, i).alias("term"),
                    (F.coalesce(F.get(first, nth + 1), F.size(ordered)) - i).cast("bigint").alias("n"),
                ),
            ),
        )
        return F.when(F.size(ordered) > 0, counted)

    return let(F.sort_array(_col(terms)), runs)


def extract_emojis(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(EMOJI), F.lit(0))


def contains_emoji(text: Column | str) -> Column:
    return _col(text).rlike(EMOJI)
