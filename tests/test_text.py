from pyspark.sql import functions as F

from driftloom.functions import dates, stopwords, text
from driftloom.functions.text import let


def value(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], list(row)).select(column.alias("out")).first().out


def test_remove_links(spark):
    for before, after in [
        ("No links here.", "No links here."),
        ("There was a link: https://t.co/FakeLink", "There was a link: "),
        ("a http://x.y/z b https:// c", "a  b https:// c"),
    ]:
        assert value(spark, text.remove_links("t"), t=before) == after


def test_remove_user_tags(spark):
    for before, after in [
        ("@user test text", " test text"), ("email@user.com", "email@user.com"), ("test text", "test text"),
        ("@u1@u2", "@u2"), ("x.@bob", "x.@bob"), ("(@bob)", "()"), ("@a", "@a"),
    ]:
        assert value(spark, text.remove_user_tags("t"), t=before) == after


def test_links_go_before_tags(spark):
    assert value(spark, text.clean_text("t"), t="see https://x.y/@bob @ann!") == "see  !"


def test_tokenize_words(spark):
    assert value(spark, text.tokenize_words("t"), t="A Big-Dog é été x_1 9 don't") == ["big", "dog", "été", "x_1", "don"]


def test_tokenize_social(spark):
    line = "Hi @Bob_1 :-D #Covid19 don't... well-known 3.5 a.b@c.org https://t.co/X! <3"
    assert value(spark, text.tokenize_social("t"), t=line) == [
        "hi", "@bob_1", ":-D", "#covid19", "don't", "...", "well-known", "3.5", "a.b@c.org", "https://t.co/x!", "<3",
    ]


def test_stopwords(spark):
    tokens = ["the", "a", "apple", ".", ",", "coronavirus"]
    assert value(spark, stopwords.remove_stopwords("t"), t=tokens) == ["apple"]
    assert value(spark, stopwords.remove_stopwords("t"), t=["pie", "the", "pie"]) == ["pie", "pie"]
    assert value(spark, stopwords.is_stopword("t"), t="the") and not value(spark, stopwords.is_stopword("t"), t="apple")


def test_stopword_union(spark):
    assert [len(x) for x in stopwords.LISTS.values()] == [179, 10, 32, 56]
    rows = {r.term for r in stopwords.stopword_union(spark, "abc").collect()}
    assert rows == set(stopwords.STOPWORDS) | {"abc"}


def test_ngrams(spark):
    assert value(spark, text.ngrams("t", 2), t=["a", "b", "c"]) == ["a", "b", "c", "a b", "b c"]
    assert value(spark, text.ngrams("t", 3, "_"), t=["a", "b"]) == ["a", "b", "a_b"]
    empty = spark.sql("SELECT CAST(array() AS array<string>) AS t")
    assert empty.select(text.ngrams("t", 2).alias("out")).first().out == []


def test_bigram_may_span_a_removed_word(spark):
    words = stopwords.remove_stopwords(text.tokenize_words("t"))
    assert value(spark, text.ngrams(words, 2), t="cats and dogs") == ["cats", "dogs", "cats dogs"]


def test_term_counts_in_row(spark):
    rows = value(spark, text.term_counts_in_row("t"), t=["b", "a", "b", "c", "b"])
    assert [tuple(r) for r in rows] == [("a", 1), ("b", 3), ("c", 1)]
    empty = spark.sql("SELECT CAST(array() AS array<string>) AS t")
    assert empty.select(F.explode(text.term_counts_in_row("t"))).count() == 0


def test_emojis(spark):
    some, none = "🦠 coronavirus. 🤒😷😷😷", "No emojis here. :( )"
    assert value(spark, text.extract_emojis("t"), t=some) == ["🦠", "🤒", "😷", "😷", "😷"]
    assert value(spark, text.extract_emojis("t"), t=none) == []
    assert value(spark, text.contains_emoji("t"), t=some) is True
    assert value(spark, text.contains_emoji("t"), t=none) is False
    assert value(spark, text.extract_emojis("t"), t="🇫🇷👩🏽‍🔬") == ["🇫🇷", "👩🏽‍🔬"]


def test_let_evaluates_once(spark):
    assert value(spark, let(F.col("t") + 1, lambda x: x * x), t=2) == 9


def test_date_hours(spark):
    for name, found in [
        ("records-id-2020-03-01-00.txt", "2020-03-01-00"), ("records-id-2020-03-01.txt", None),
        ("2020-03-01-00-05", "2020-03-01-00"), ("2020-03-01-00-other_stuff_2020-15-01-00", "2020-03-01-00"),
    ]:
        assert value(spark, dates.extract_date_hour("t"), t=name) == found
    assert str(value(spark, dates.date_hour_to_ts(F.col("t")), t="2020-01-03-00")) == "2020-01-03 00:00:00"
    assert value(spark, dates.date_hour_to_ts(F.col("t")), t="2020-45-23-32") is None
    assert value(spark, dates.year_month("t"), t="2020-01-03-00") == "2020-01"


def test_week_and_day_truncate_toward_zero(spark):
    start = dates.start_of("2020-03-01-00")
    for label, week, day in [
        ("2020-03-04-05", 0, 3), ("2020-03-20-05", 2, 19), ("2020-02-27-00", 0, -3), ("2020-02-27-12", 0, -2),
    ]:
        ts = dates.date_hour_to_ts(F.col("t"))
        assert value(spark, dates.week_index(ts, start), t=label) == week
        assert value(spark, dates.day_index(ts, start), t=label) == day


def test_compact_dates_and_labels(spark):
    assert str(value(spark, dates.parse_compact_date("t"), t=20030219)) == "2003-02-19"
    assert value(spark, dates.date_label("t", "2020-02-01"), t=29) == "03-01"
