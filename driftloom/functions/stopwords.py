"""Stop lists and the Column that removes them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The lists must equal those the results are compared with.
ENGLISH = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all
any both each few more most other some such no nor not only own same so than too
very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()
NUMBER_WORDS = "one two three four five six seven eight nine ten".split()
PUNCTUATION = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
DOMAIN = [
    "’", "”", "“", "amp", "https", "covid19ph", "covid", "corona virus",
    "coronavirusupdates", "coronavirusuk", "co", "coronaviruslockdown",
    "covid19pandemic", "coronavid19", "indiafightscorona", "covidiot",
    "coronaalert", "coronavirustruth", "coronavirususa", "covidiots",
    "coronaviruses", "2019ncov", "2019 ncov", "coronaviruswuhan",
    "coronavirusinindia", "corona", "covidー19", "19", "sarscov2", "cov",
    "coronavirius", "coronaviruspandemic", "coronavirusupdate",
    "nomeat_nocoronavirus", "virus", "covid19", "covid2019", "covid19uk",
    "ncov2019", "coronaviruschina", "chinacoronavirus", "coronavirus",
    "coronavirusoutbreak", "coronavirus co", "ncov", "coronaviruschallenge",
    "covid 19", "coronavirusindia", "covid_19", "wuhancoronavirus",
    "coronavirusus", "coronapocalypse", "covid19india", "coronalockdown",
    "coronaoutbreak", "2019",
]
# End of fixed values.

LISTS = {"english": ENGLISH, "number": NUMBER_WORDS, "punctuation": PUNCTUATION, "domain": DOMAIN}
STOPWORDS = sorted(set().union(*LISTS.values()))


def stopword_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Each list as a one-column table `term`."""
    return {
        name: spark.createDataFrame([(w,) for w in words], "term string")
        for name, words in LISTS.items()
    }


def stopword_union(spark: SparkSession, *extra: str) -> DataFrame:
    """Distinct terms of all lists and of the words a job adds."""
    tables = list(stopword_tables(spark).values())
    if extra:
        tables.append(spark.createDataFrame([(w,) for w in extra], "term string"))
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table)
    return merged.distinct()


def remove_stopwords(tokens: Column | str, words: Iterable[str] = STOPWORDS) -> Column:
    """Drop stop words, keeping order and repeats.

    The literal list becomes one hash set, so the cost per token does not
    depend on the length of the list and no token leaves its row.
    """
    words = list(words)
    return F.filter(tokens, lambda token: ~token.isin(words))


def is_stopword(word: Column | str, words: Iterable[str] = STOPWORDS) -> Column:
    column = F.col(word) if isinstance(word, str) else word
    return column.isin(list(words))
