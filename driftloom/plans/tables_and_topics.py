"""Queries over joins, aggregations, windows, rankings, sets and tensors."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from driftloom.functions import records
from driftloom.functions.text import tokenize_social, tokenize_words
from driftloom.operators import joins, ranking, sampling, series, tensor, topics, vocabulary
from driftloom.operators.numbering import dense_index, number_rows
from driftloom.operators.vectoriser import TermVectoriser
from driftloom.plans.corpus import Corpus, cells, corpus, dims, english, english_counts, slices
from driftloom.plans.oracle import STOP, clean, tokens, uniform, vocab, with_bigrams, with_corpus
from driftloom.plans.registry import query
from driftloom.plans.sources_and_text import EMOTICON_SQL, MONTHLY, SEED, SOCIAL_SQL
from driftloom.session import read_table, scratch_path

# Topics whose weights SQL can compute as well: the summed TF-IDF of a source.
PROFILE = """profile AS (SELECT (dense_rank() OVER (ORDER BY source) - 1)::INT AS topic, term, w FROM
    (SELECT source, term, round(sum(x), 6) AS w FROM tfidf JOIN vocab USING (term_id) GROUP BY ALL))"""


def top_sql(n: int, table: str = "profile") -> str:
    return f"""top AS (SELECT * FROM (SELECT topic, term, w,
        row_number() OVER (PARTITION BY topic ORDER BY w DESC, term)::INT AS rank FROM {table}) WHERE rank <= {n})"""


SHARES = "shares AS (SELECT *, w / sum(w) OVER (PARTITION BY topic) AS share FROM top)"


def profile(spark, folder):
    """(topic, term, w): weights of the terms in each source."""
    data = corpus(spark, folder)
    sums = data.weights.groupBy("source", "term_id").agg(F.round(F.sum("x"), 6).alias("w"))
    named = joins.join_term_lookup(sums, data.vocabulary)
    return named.join(dense_index(data.docs, "source", "topic"), "source").select("topic", "term", "w")


@query("flagship", with_corpus("""SELECT source, term, round(w, 6) AS weight, rank FROM (SELECT source, term, w,
    row_number() OVER (PARTITION BY source ORDER BY w DESC, term)::INT AS rank FROM
      (SELECT source, term, round(sum(x), 6) AS w FROM tfidf JOIN vocab USING (term_id) GROUP BY ALL))
    WHERE rank <= 10""", upto="tfidf"))
def flagship(spark, folder):
    """Clean text -> n-grams -> vocabulary -> TF-IDF -> ten strongest terms per source."""
    data = corpus(spark, folder)
    sums = data.weights.groupBy("source", "term_id").agg(F.round(F.sum("x"), 6).alias("w"))
    named = joins.join_term_lookup(sums, data.vocabulary).withColumnRenamed("source", "topic")
    top = topics.topic_keywords(named, 10)
    return top.select(F.col("topic").alias("source"), "term", F.col("w").alias("weight"), "rank")


# ---- joins ------------------------------------------------------------------


@query("join_term_lookup", with_corpus(
    "SELECT term, round(sum(x), 6) AS w FROM tfidf JOIN vocab USING (term_id) GROUP BY term", upto="tfidf"))
def join_term_lookup(spark, folder):
    data = corpus(spark, folder)
    sums = data.weights.groupBy("term_id").agg(F.round(F.sum("x"), 6).alias("w"))
    return joins.join_term_lookup(sums, data.vocabulary).select("term", "w")


@query("semi_in_vocabulary", with_corpus(
    "SELECT doc_id, term, n FROM counts WHERE term IN (SELECT term FROM vocab)", upto="vocab"))
def semi_in_vocabulary(spark, folder):
    data = corpus(spark, folder)
    return joins.semi_in_vocabulary(data.counts, data.vocabulary).select("doc_id", "term", "n")


#: Terms that a vocabulary of the most frequent ones has.
TOP_TERMS = 5000


def _df_cut(low: int, high: float) -> str:
    return f"df >= {low} AND df <= {high} * (SELECT count(*) FROM docs)"


@query("cross_param_grid", with_corpus(" UNION ALL ".join(
    f"SELECT {low} AS min_df, {high}::DOUBLE AS max_df, count(*) AS n_terms, sum(n)::BIGINT AS n FROM stats WHERE {_df_cut(low, high)}"
    for low in (1, 2, 5) for high in (0.5, 0.95)), upto="stats"))
def cross_param_grid(spark, folder):
    """Vocabulary size for every combination of the two cuts.

    The grid is listed beside each term, so all combinations share one pass.
    """
    data = corpus(spark, folder)
    grid = joins.param_grid(spark, min_df=[1, 2, 5], max_df=[0.5, 0.95])
    runs = grid.agg(F.collect_list(F.struct("min_df", "max_df"))).scalar()
    stats = vocabulary.term_counts(english_counts(spark, folder)).select("n", "df", F.explode(runs).alias("run"))
    inside = (F.col("df") >= F.col("run.min_df")) & (F.col("df") <= F.col("run.max_df") * data.n_docs)
    return stats.where(inside).groupBy("run").agg(F.count("*").alias("n_terms"), F.sum("n").alias("n")).select(
        "run.min_df", "run.max_df", "n_terms", "n"
    )


@query("zip_by_position", with_corpus("""SELECT a.topic, a.rank, a.term AS term, b.term AS other FROM top a JOIN top b
    ON a.rank = b.rank AND b.topic = (a.topic + 1) % (SELECT max(topic) + 1 FROM top)""", PROFILE, top_sql(10), upto="tfidf"))
def zip_by_position(spark, folder):
    """Keywords of each topic beside those of the next topic."""
    top = topics.topic_keywords(profile(spark, folder), 10)
    place = F.struct("topic", "rank")
    n = top.agg(F.max("topic") + 1).scalar()
    other = F.struct(((F.col("topic") + n - 1) % n).alias("topic"), "rank")
    paired = joins.zip_by_position(
        top.select(place.alias("at"), "term"), top.select(other.alias("at"), F.col("term").alias("other")), "at"
    )
    return paired.select("at.topic", "at.rank", "term", "other")


DAILY = "daily AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS t, value FROM events)"


def _daily(spark, folder):
    events = read_table(spark, folder, "events")
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return events.select("event_id", day.alias("t"), "value", "ts", "event_type")


@query("range_window_slices", f"""WITH {DAILY} SELECT s::INT AS window_start, count(*) AS n, round(sum(value), 4) AS total
    FROM daily JOIN (SELECT unnest(range(0, (SELECT max(t) + 1 FROM daily) - 9, 5)) AS s) w ON t BETWEEN s AND s + 9 GROUP BY s""")
def range_window_slices(spark, folder):
    daily = _daily(spark, folder)
    n_days = (daily.agg(F.max("t")).first()[0] or 0) + 1
    windows = joins.range_window_slices(daily, n_days, length=10, slide=5)
    return windows.groupBy("window_start").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# A trace as an online learner leaves it: the error falls along the time of a trial.
TRACE = """trace AS (SELECT (user_id % 2)::INT AS method, event_type AS trial, event_id AS iter,
    (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0::DOUBLE AS elapsed, value AS error FROM events)"""
RESAMPLED = """ends AS (SELECT method, trial, max(elapsed) AS e FROM trace GROUP BY ALL),
    cuts AS (SELECT method, min(e) AS cut, (SELECT max(e) / 100 FROM ends) AS step FROM ends GROUP BY method),
    seg AS (SELECT *, lead(elapsed) OVER w AS e1, lead(error) OVER w AS y1, row_number() OVER w AS k
        FROM trace WINDOW w AS (PARTITION BY method, trial ORDER BY iter)),
    resampled AS (SELECT method, trial, g::INT AS grid, g * step AS x,
        error + (g * step - elapsed) * ((y1 - error) / (e1 - elapsed)) AS y
        FROM seg JOIN cuts USING (method) JOIN range(101) r(g)
        ON (g * step >= elapsed OR k = 1) AND g * step < e1 AND g * step < cut WHERE e1 IS NOT NULL)"""


def _trace(spark, folder):
    events = read_table(spark, folder, "events")
    since = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")) / 1_000_000
    return events.select(
        (F.col("user_id") % 2).cast("int").alias("method"), F.col("event_type").alias("trial"),
        F.col("event_id").alias("iter"), since.alias("elapsed"), F.col("value").alias("error"),
    )


@query("resample_trace", f"""WITH {TRACE}, {RESAMPLED}
    SELECT method, trial, grid, round(x, 3) AS x, round(y, 6) AS y FROM resampled""")
def resample_trace(spark, folder):
    out = series.resample_trace(_trace(spark, folder))
    return out.select("method", "trial", "grid", F.round("x", 3).alias("x"), F.round("y", 6).alias("y"))


@query("error_band", f"""WITH {TRACE}, {RESAMPLED} SELECT method, grid, round(avg(y), 6) AS mean_error,
    round(stddev_pop(y), 6) AS std_error FROM resampled GROUP BY method, grid""")
def error_band(spark, folder):
    band = series.error_band(series.resample_trace(_trace(spark, folder)))
    return band.select(
        "method", "grid", F.round("mean_error", 6).alias("mean_error"), F.round("std_error", 6).alias("std_error")
    )


# ---- counts and weights -----------------------------------------------------


@query("term_counts", with_corpus("SELECT term, n FROM stats", upto="stats"))
def term_counts(spark, folder):
    return vocabulary.term_counts(english_counts(spark, folder)).select("term", "n")


@query("term_counts_per_file", with_corpus(
    "SELECT source, term, sum(n)::BIGINT AS n, count(*) AS df FROM counts GROUP BY ALL", upto="counts"))
def term_counts_per_file(spark, folder):
    return vocabulary.term_counts(english_counts(spark, folder), ["source"])


SOCIAL_DOCS = f"""social AS (SELECT source, unnest({with_bigrams('words')}) AS term FROM (SELECT source,
    list_filter(list_transform(regexp_extract_all({clean('text')}, '{{social}}'),
      lambda w: CASE WHEN regexp_full_match(w, '{{emoticon}}') THEN w ELSE lower(w) END),
      lambda w: w NOT IN ({STOP})) AS words FROM documents WHERE lang = 'en'))"""


def _social_sql() -> str:
    return SOCIAL_DOCS.replace("{social}", SOCIAL_SQL).replace("{emoticon}", EMOTICON_SQL)


@query("combined_vocabulary", f"""WITH {_social_sql()} SELECT term, count(*) AS n, count(DISTINCT source) AS n_files
    FROM social GROUP BY term""")
def combined_vocabulary(spark, folder):
    """Social-media tokens counted per file, then totalled over the files."""
    terms = vocabulary.document_terms(english(spark, folder), max_len=1, tokenize=tokenize_social)
    per_file = vocabulary.term_counts(vocabulary.counts_in_documents(terms, max_len=2), ["source"])
    return per_file.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("n_files"))


@query("document_frequency", with_corpus(
    f"SELECT term, df FROM stats WHERE {_df_cut(2, 0.7)}", upto="stats"))
def document_frequency(spark, folder):
    stats = vocabulary.term_counts(english_counts(spark, folder))
    return vocabulary.within_df(stats, corpus(spark, folder).n_docs, 2, 0.7).select("term", "df")


@query("select_vocabulary", with_corpus(
    "SELECT term_id, term, n, df, round(idf, 6) AS idf FROM vocab", upto="vocab", vocabulary=vocab(TOP_TERMS, 2)))
def select_vocabulary(spark, folder):
    """The most frequent terms of at least two documents."""
    stats = vocabulary.term_counts(english_counts(spark, folder))
    chosen = vocabulary.select_vocabulary(stats, corpus(spark, folder).n_docs, TOP_TERMS, 2)
    return chosen.withColumn("idf", F.round("idf", 6))


@query("bag_of_words", with_corpus(
    "SELECT source, doc_id, term_id, counts.n FROM counts JOIN vocab USING (term)", upto="vocab"))
def bag_of_words(spark, folder):
    data = corpus(spark, folder)
    return vocabulary.bag_of_words(data.counts, data.vocabulary)


@query("bag_dims", with_corpus(
    "SELECT source, (SELECT count(*) FROM vocab) AS n_terms, count(*) AS n_docs FROM docs GROUP BY source", upto="vocab"))
def bag_dims(spark, folder):
    data = corpus(spark, folder)
    n_terms = data.vocabulary.agg(F.count("*")).scalar()
    return data.docs.groupBy("source").agg(F.count("*").alias("n_docs")).withColumn("n_terms", n_terms)


@query("tfidf", with_corpus("SELECT doc_id, term_id, round(x, 6) AS x FROM tfidf", upto="tfidf"))
def tfidf(spark, folder, data: Corpus | None = None):
    data = data or corpus(spark, folder)
    return data.weights.select("doc_id", "term_id", F.round("x", 6).alias("x"))


@query("vectoriser_pipeline", with_corpus(
    "SELECT doc_id, term_id, round(x, 6) AS x FROM tfidf", upto="tfidf", vocabulary=vocab(TOP_TERMS, 2)))
def vectoriser_pipeline(spark, folder):
    """The weights of a fitted ML pipeline that was saved and loaded."""
    docs = english(spark, folder).select("doc_id", "text")
    path = scratch_path(spark, "pipeline")
    Pipeline(stages=[TermVectoriser(maxFeatures=TOP_TERMS, minDf=2)]).fit(docs).write().save(path)
    rows = PipelineModel.load(path).transform(docs)
    cells = rows.select("doc_id", F.explode("features").alias("c"))
    return cells.select("doc_id", "c.term_id", F.round("c.x", 6).alias("x"))


@query("tfidf_per_slice", with_corpus("""SELECT doc_id, term_id, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS x FROM
    (SELECT doc_id, term_id, n * (ln((1 + n_docs) / (1 + count(*) OVER (PARTITION BY source, term_id))) + 1) AS w FROM
      (SELECT doc_id, source, term_id, counts.n FROM counts JOIN vocab USING (term))
      JOIN (SELECT source, count(*) AS n_docs FROM docs GROUP BY source) USING (source))""", upto="vocab"))
def tfidf_per_slice(spark, folder, data: Corpus | None = None):
    data = data or corpus(spark, folder)
    numbered = data.numbered.withColumnRenamed("source", "slice")
    # The texts' terms are read no more.
    data.give_up("counts")
    per_slice = data.docs.groupBy(F.col("source").alias("slice")).agg(F.count("*").alias("n_docs"))
    weights = vocabulary.unit_weights_per_slice(numbered, per_slice)
    return weights.select("doc_id", "term_id", F.round("x", 6).alias("x"))


@query("gensim_tfidf_option", with_corpus("""SELECT doc_id, term_id, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS x
    FROM (SELECT doc_id, term_id, counts.n * log2((SELECT count(*) FROM docs) / vocab.df) AS w
      FROM counts JOIN vocab USING (term)) WHERE w > 0""", upto="vocab"))
def gensim_tfidf_option(spark, folder):
    data = corpus(spark, folder)
    weights = vocabulary.log2_tfidf(data.counts, data.vocabulary, data.n_docs)
    return weights.select("doc_id", "term_id", F.round("x", 6).alias("x"))


@query("group_size_bounds", """SELECT min(n) AS smallest, max(n) AS largest, count(*) AS n_groups FROM
    (SELECT count(*) AS n FROM orders GROUP BY strftime(o_orderdate, '%Y-%m'))""")
def group_size_bounds(spark, folder):
    months = read_table(spark, folder, "orders").groupBy(F.trunc("o_orderdate", "month")).count()
    return months.agg(
        F.min("count").alias("smallest"), F.max("count").alias("largest"), F.count("*").alias("n_groups")
    )


@query("month_filter_count", """SELECT count(*) AS n FROM orders
    WHERE o_orderdate >= TIMESTAMP '1998-03-01' AND o_orderdate < TIMESTAMP '1998-04-01'""")
def month_filter_count(spark, folder):
    """A range on the stored column reaches the scan; a month label would not."""
    orders = read_table(spark, folder, "orders")
    low, high = (F.lit(d).cast("timestamp_ntz") for d in ("1998-03-01", "1998-04-01"))
    return orders.where((F.col("o_orderdate") >= low) & (F.col("o_orderdate") < high)).agg(F.count("*").alias("n"))


@query("min_docs_over_categories", "SELECT min(n) AS smallest FROM (SELECT count(*) AS n FROM documents GROUP BY source)")
def min_docs_over_categories(spark, folder):
    return read_table(spark, folder, "documents").groupBy("source").count().agg(F.min("count").alias("smallest"))


# Codes SQL can compute as well: a document's weight on three groups of terms.
CODES = """codes AS (SELECT t, (term_id % 3)::INT AS topic, doc_id, sum(x) AS h
    FROM tfidf JOIN slices USING (doc_id) GROUP BY ALL)"""
PREVALENCE = """SELECT {t} AS slice, topic, m / sum(m) OVER (PARTITION BY {t}) AS p FROM
    (SELECT {t}, topic, sum(h) / any_value(n_docs) AS m FROM codes JOIN
      (SELECT {t}, count(*) AS n_docs FROM slices GROUP BY {t}) USING ({t}) GROUP BY {t}, topic)"""


def _codes(spark, folder):
    """(codes(slice, topic, h), documents(slice))."""
    data = corpus(spark, folder)
    index = dense_index(data.docs, "source", "slice")
    topic = (F.col("term_id") % 3).cast("int")
    per_source = data.weights.groupBy("source", topic.alias("topic")).agg(F.sum("x").alias("h"))
    return per_source.join(index, "source"), data.docs.join(index, "source")


@query("topic_prevalence", with_corpus(
    f"SELECT slice, topic, round(p, 6) AS prevalence FROM ({PREVALENCE.format(t='t')})", CODES, upto="slices"))
def topic_prevalence(spark, folder):
    codes, docs = _codes(spark, folder)
    per_slice = docs.groupBy("slice").agg(F.count("*").alias("n_docs"))
    return topics.topic_prevalence(codes, per_slice).select("slice", "topic", F.round("prevalence", 6).alias("prevalence"))


@query("topic_prevalence_by_month", with_corpus("""SELECT bucket, topic, round(m / sum(m) OVER (PARTITION BY bucket), 6) AS prevalence
    FROM (SELECT b AS bucket, topic, sum(h) / any_value(n_docs) AS m FROM
      (SELECT *, CASE WHEN t < 7 THEN 0 WHEN t < 13 THEN 1 ELSE 2 END AS b FROM codes) JOIN
      (SELECT CASE WHEN t < 7 THEN 0 WHEN t < 13 THEN 1 ELSE 2 END AS b, count(*) AS n_docs FROM slices GROUP BY 1)
      USING (b) GROUP BY b, topic)""", CODES, upto="slices"))
def topic_prevalence_by_month(spark, folder):
    codes, docs = _codes(spark, folder)
    bucket = topics.slice_ranges("slice", (7, 13))
    per_bucket = docs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_docs"))
    shares = topics.topic_prevalence(codes.withColumn("bucket", bucket), per_bucket, "bucket")
    return shares.select("bucket", "topic", F.round("prevalence", 6).alias("prevalence"))


TIME_FACTOR = f"""factor AS (SELECT t, k::INT AS topic, (count(*) * (k + 1) + t) * 1.0::DOUBLE AS w
    FROM slices, range(3) r(k) GROUP BY t, k)"""


def _time_factor(spark, folder):
    data = corpus(spark, folder)
    index = dense_index(data.docs, "source", "t")
    sizes = data.docs.groupBy("source").count().join(index, "source")
    u = F.array(*[(F.col("count") * (k + 1) + F.col("t")).cast("double") for k in range(3)])
    return sizes.select("t", u.alias("u"))


@query("normalize_rows_factor", with_corpus(
    "SELECT t, topic, round(w / sum(w) OVER (PARTITION BY t), 6) AS share FROM factor", TIME_FACTOR, upto="slices"))
def normalize_rows_factor(spark, folder):
    return topics.normalize_rows(_time_factor(spark, folder), "t").withColumn("share", F.round("share", 6))


@query("normalize_cols_factor", with_corpus(
    "SELECT t, topic, round(w / sum(w) OVER (PARTITION BY topic), 6) AS share FROM factor", TIME_FACTOR, upto="slices"))
def normalize_cols_factor(spark, folder):
    return topics.normalize_columns(_time_factor(spark, folder), "t", 3).withColumn("share", F.round("share", 6))


# ---- windows ----------------------------------------------------------------

@query("sliding_average", """WITH hourly AS (SELECT event_type, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS h, sum(value) AS v
    FROM events GROUP BY ALL),
    types AS (SELECT DISTINCT event_type FROM events),
    grid AS (SELECT event_type, unnest(range((SELECT min(h) FROM hourly), (SELECT max(h) + 1 FROM hourly))) AS h FROM types),
    dense AS (SELECT event_type, h, coalesce(v, 0) AS v FROM grid LEFT JOIN hourly USING (event_type, h))
    SELECT event_type, h AS hour, round(a, 6) AS average FROM (SELECT event_type, h, avg(v) OVER w AS a, count(*) OVER w AS c
      FROM dense WINDOW w AS (PARTITION BY event_type ORDER BY h ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)) WHERE c = 24""")
def sliding_average(spark, folder):
    events = read_table(spark, folder, "events")
    hour = F.timestamp_diff("HOUR", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    hourly = events.groupBy("event_type", hour.alias("hour")).agg(F.sum("value").alias("v"))
    ends = events.agg(F.min(hour).alias("low"), F.max(hour).alias("high"))
    hours = F.explode(F.sequence(ends.select("low").scalar(), ends.select("high").scalar()))
    grid = events.select("event_type").distinct().withColumn("hour", hours)
    dense = grid.withColumn("hour", F.col("hour").cast("bigint")).join(hourly, ["event_type", "hour"], "left")
    dense = dense.withColumn("v", F.coalesce("v", F.lit(0.0)))
    return series.sliding_average(dense, "event_type", "hour", "v", 24).withColumn("average", F.round("average", 6))


@query("position_in_slice", with_corpus("SELECT doc_id, t, d FROM slices", upto="slices"))
def position_in_slice(spark, folder):
    return slices(corpus(spark, folder)).select("doc_id", "t", "d")


@query("first_last_file_per_day", """SELECT strftime(ts, '%Y-%m-%d') AS day,
    'id-' || min(strftime(ts, '%Y-%m-%d-%H')) || '.gz' AS first_file,
    'id-' || max(strftime(ts, '%Y-%m-%d-%H')) || '.gz' AS last_file FROM events GROUP BY 1""")
def first_last_file_per_day(spark, folder):
    events = read_table(spark, folder, "events")
    name = F.concat(F.lit("id-"), F.date_format("ts", "yyyy-MM-dd-HH"), F.lit(".gz"))
    files = events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), name.alias("file"))
    return ranking.first_last_per_slice(files, "day", "file")


# ---- rankings ---------------------------------------------------------------


@query("top_k_records", """SELECT event_id, value FROM events LEFT JOIN documents ON event_id = doc_id
    WHERE event_type <> 'error' AND coalesce(lang, 'en') = 'en' ORDER BY value DESC, event_id DESC LIMIT 50""")
def top_k_records(spark, folder):
    """Scores of original records, English or without a language."""
    langs = read_table(spark, folder, "documents").select(F.col("doc_id").alias("event_id"), "lang")
    events = read_table(spark, folder, "events").where("event_type <> 'error'")
    kept = events.join(langs, "event_id", "left").where(records.is_english_lenient("lang"))
    return ranking.top_k_records(kept.select("event_id", "value"), 50, "value", "event_id")


RANKED_DAYS = """ranked AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS day, event_id, value, row_number() OVER
    (PARTITION BY ts::DATE ORDER BY value DESC, event_id DESC)::INT AS rank FROM events WHERE event_type <> 'error')"""


def _ranked_days(spark, folder, k):
    events = _daily(spark, folder).where("event_type <> 'error'").select(F.col("t").alias("day"), "event_id", "value")
    return ranking.top_k_per_slice(events, "day", k, "value", "event_id")


@query("top_k_per_day", f"WITH {RANKED_DAYS} SELECT * FROM ranked WHERE rank <= 20")
def top_k_per_day(spark, folder):
    return _ranked_days(spark, folder, 20)


@query("build_corpus_topk", f"""WITH {RANKED_DAYS} SELECT (day - 3)::INT AS t, (rank - 1)::INT AS d, event_id FROM ranked
    WHERE day >= 3 AND rank <= 20""")
def build_corpus_topk(spark, folder):
    return ranking.build_corpus_topk(_ranked_days(spark, folder, 30), "day", 20, 3).select("t", "d", "event_id")


@query("build_corpus_random", f"""WITH {RANKED_DAYS}, drawn AS (SELECT day, event_id, row_number() OVER
      (PARTITION BY day ORDER BY md5(event_id::VARCHAR || '#{SEED}'), event_id) AS draw FROM ranked)
    SELECT (day - 3)::INT AS t, (draw - 1)::INT AS d, event_id FROM drawn WHERE day >= 3 AND draw <= 20""")
def build_corpus_random(spark, folder):
    events = _daily(spark, folder).where("event_type <> 'error'").select(F.col("t").alias("day"), "event_id")
    return ranking.build_corpus_random(events, "day", 20, "event_id", 3, SEED).select("t", "d", "event_id")


@query("topic_keywords", with_corpus("SELECT topic, term, w, rank FROM top", PROFILE, top_sql(20), upto="tfidf"))
def topic_keywords(spark, folder):
    return topics.topic_keywords(profile(spark, folder), 20)


@query("keyword_shares", with_corpus(
    "SELECT topic, term, rank, round(share, 6) AS share FROM shares", PROFILE, top_sql(20), SHARES, upto="tfidf"))
def keyword_shares(spark, folder):
    shares = topics.keyword_shares(profile(spark, folder), 20)
    return shares.select("topic", "term", "rank", F.round("share", 6).alias("share"))


@query("keyword_shades", with_corpus(
    "SELECT topic, term, round(0.4 * share + 0.6, 6) AS shade FROM shares", PROFILE, top_sql(20), SHARES, upto="tfidf"))
def keyword_shades(spark, folder):
    shades = topics.keyword_shades(topics.keyword_shares(profile(spark, folder), 20))
    return shades.select("topic", "term", F.round("shade", 6).alias("shade"))


# The passes are unrolled into numbered operations, each of which rewrites the
# weight list of its topic in a recursive table.
CONDENSED = """lists AS (SELECT topic, list(w ORDER BY rank) AS ws, list(term ORDER BY rank) AS ts FROM top GROUP BY topic),
    ops AS (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY q, b) AS s, q, b, u1, u2 FROM (
      SELECT topic, rank AS q, 0 AS b, 0 AS u1, 0 AS u2 FROM top WHERE NOT regexp_matches(term, '[a-zA-Z]')
      UNION ALL SELECT a.topic, a.rank, p.rank, coalesce(list_position(ts, split_part(p.term, ' ', 1)), 0),
        coalesce(list_position(ts, split_part(p.term, ' ', 2)), 0)
      FROM top a JOIN top p USING (topic) JOIN lists USING (topic)
      WHERE regexp_matches(a.term, '[a-zA-Z]') AND contains(p.term, ' '))),
    run(topic, s, ws) AS (SELECT topic, 0::BIGINT, ws FROM lists UNION ALL
      SELECT r.topic, o.s, list_transform(r.ws, lambda w, i:
        CASE WHEN o.b = 0 THEN CASE WHEN i = o.q THEN 0 ELSE w END
        WHEN i = o.b THEN greatest(w, CASE WHEN r.ws[o.u1] < 2 * w THEN r.ws[o.u1] ELSE 0 END,
          CASE WHEN r.ws[o.u2] < 2 * w THEN r.ws[o.u2] ELSE 0 END)
        WHEN (i = o.u1 OR i = o.u2) AND w < 2 * r.ws[o.b] THEN 0 ELSE w END)
      FROM run r JOIN ops o ON o.topic = r.topic AND o.s = r.s + 1),
    condensed AS (SELECT topic, term, rank, finals.ws[rank] AS w FROM top JOIN
      (SELECT topic, arg_max(ws, s) AS ws FROM run GROUP BY topic) finals USING (topic))"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("condense_keywords", _recursive(with_corpus(
    "SELECT topic, term, rank, round(w, 6) AS w FROM condensed", PROFILE, top_sql(20), CONDENSED, upto="tfidf")))
def condense_keywords(spark, folder):
    out = topics.condense_keywords(profile(spark, folder))
    return out.withColumn("w", F.round("w", 6))


@query("topic_labels", _recursive(with_corpus("""SELECT topic, string_agg(term, ', ' ORDER BY r) || ': ' || topic AS label FROM
    (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY w DESC, term) AS r FROM condensed)
    WHERE r <= 3 GROUP BY topic""", PROFILE, top_sql(20), CONDENSED, upto="tfidf")))
def topic_labels(spark, folder):
    return topics.topic_labels(topics.condense_keywords(profile(spark, folder)))


@query("sample_topic_words", with_corpus(f"""SELECT topic, term, count(*) AS n FROM
      (SELECT d.topic, min_by(c.term, c.rank) AS term FROM
        (SELECT topic, j, {uniform('topic', 'j', SEED)} AS u FROM (SELECT DISTINCT topic FROM top), range(500) r(j)) d
        JOIN (SELECT topic, term, rank, sum(share) OVER (PARTITION BY topic ORDER BY rank) AS hi,
            max(rank) OVER (PARTITION BY topic) AS final FROM shares) c
        ON c.topic = d.topic AND (d.u < c.hi OR c.rank = c.final) GROUP BY d.topic, d.j)
    GROUP BY topic, term""", PROFILE, top_sql(50), SHARES, upto="tfidf"))
def sample_topic_words(spark, folder):
    shares = topics.keyword_shares(profile(spark, folder), 50)
    return sampling.sample_topic_words(shares, 500, SEED)


@query("chronological_sort", f"""SELECT month, o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos
    FROM ({MONTHLY}) JOIN orders USING (o_orderkey) WHERE draw <= 50""")
def chronological_sort(spark, folder):
    orders = read_table(spark, folder, "orders").select(
        "o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyy-MM").alias("month")
    )
    sample = sampling.sample_n_per_group(orders, "month", 50, "o_orderkey", SEED)
    return number_rows(sample, ["o_orderdate", "o_orderkey"]).select("month", "o_orderkey", "pos")


# ---- sets -------------------------------------------------------------------


@query("union_all_files", f"""SELECT origin, count(*) AS n_texts, sum(length(t))::BIGINT AS n_chars FROM
    (SELECT 'documents' AS origin, text AS t FROM documents UNION ALL SELECT 'conversations', text FROM conversations
     UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY origin""")
def union_all_files(spark, folder):
    parts = [
        read_table(spark, folder, name).select(F.lit(name).alias("origin"), "text")
        for name in ("documents", "conversations", "benchmark")
    ]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.groupBy("origin").agg(F.count("*").alias("n_texts"), F.sum(F.length("text")).alias("n_chars"))


@query("vocabulary_equal", with_corpus(f"""SELECT (SELECT count(*) FROM (SELECT term FROM stats EXCEPT SELECT term FROM plain)) AS only_left,
    (SELECT count(*) FROM (SELECT term FROM plain EXCEPT SELECT term FROM stats)) AS only_right""",
    f"plain AS (SELECT DISTINCT unnest({tokens('text', stop=False)}) AS term FROM documents)", upto="stats"))
def vocabulary_equal(spark, folder):
    """English (1, 2)-gram terms against the plain words of all documents."""
    left = english_counts(spark, folder).select("term").distinct()
    words = F.explode(tokenize_words("text")).alias("term")
    right = read_table(spark, folder, "documents").select(words).distinct()
    return tensor.vocabulary_equal(left, right)


@query("matrix_equal", with_corpus("""SELECT count(*) AS n_cells, count_if(round(coalesce(a.x, 0), 6) <> round(coalesce(b.x, 0), 6))::BIGINT AS n_different
    FROM tfidf a FULL JOIN per_slice b USING (doc_id, term_id)""", """per_slice AS (SELECT doc_id, term_id,
      w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM
      (SELECT doc_id, term_id, n * (ln((1 + n_docs) / (1 + count(*) OVER (PARTITION BY source, term_id))) + 1) AS w FROM
      (SELECT doc_id, source, term_id, counts.n FROM counts JOIN vocab USING (term))
      JOIN (SELECT source, count(*) AS n_docs FROM docs GROUP BY source) USING (source)))""", upto="tfidf"))
def matrix_equal(spark, folder):
    """Corpus-wide TF-IDF against the weights taken inside each slice."""
    data = corpus(spark, folder)
    return tensor.matrix_equal(tfidf(spark, folder, data), tfidf_per_slice(spark, folder, data), ["doc_id", "term_id"])


# ---- tensors ----------------------------------------------------------------

NUMBERED = "numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM docs)"


def _numbered(spark, folder):
    return number_rows(corpus(spark, folder).docs.select("doc_id"), ["doc_id"], name="n")


@query("fold_blocks", with_corpus(
    "SELECT doc_id, (n // 31)::INT AS t, (n % 31)::INT AS d FROM numbered", NUMBERED, upto="docs"))
def fold_blocks(spark, folder):
    t, d = tensor.fold_blocks(F.col("n"), 31)
    return _numbered(spark, folder).select("doc_id", t.alias("t"), d.alias("d"))


@query("fold_round_robin", with_corpus(
    "SELECT doc_id, (n % 20 - 3 + 100)::INT AS t, (n // 20)::INT AS d FROM numbered WHERE n % 20 BETWEEN 3 AND 16", NUMBERED, upto="docs"))
def fold_round_robin(spark, folder):
    """Round-robin over 20 slices; slices [3, 17) are kept and moved to 100."""
    t, d = tensor.fold_round_robin(F.col("n"), 20)
    folded = _numbered(spark, folder).select("doc_id", t.alias("t"), d.alias("d"))
    kept = tensor.slice_time(folded, 3, 14)
    return kept.withColumn("t", (F.col("t") + 100).cast("int"))


@query("concat_time", with_corpus("""SELECT t - 12 AS t, v, d, round(x, 6) AS x FROM cells WHERE t >= 12 UNION ALL
    SELECT (t + (SELECT max(t) - 11 FROM slices))::INT, v, d, round(x, 6) FROM cells WHERE t < 12 UNION ALL
    SELECT (t - 12 + (SELECT max(t) + 1 FROM slices))::INT, v, d, round(x, 6) FROM cells WHERE t >= 12"""))
def concat_time(spark, folder):
    """Late slices, early slices, late slices again."""
    data = corpus(spark, folder)
    whole = cells(data).withColumn("x", F.round("x", 6))
    n_late = max(0, data.docs.select("source").distinct().count() - 12)
    late, early = tensor.slice_time(whole, 12, n_late), tensor.slice_time(whole, 0, 12)
    return tensor.concat_time([(late, n_late), (early, 12), (late, n_late)])


@query("matricize", with_corpus(
    "SELECT v, t::BIGINT * (SELECT max(d) + 1 FROM slices) + d AS n, round(x, 6) AS x FROM cells"))
def matricize(spark, folder):
    data = corpus(spark, folder)
    return tensor.matricize(cells(data), dims(data)["d"]).withColumn("x", F.round("x", 6))


@query("unfold_mode", with_corpus("""SELECT v::BIGINT AS "row", t::BIGINT * (SELECT max(d) + 1 FROM slices) + d AS col,
    round(x, 6) AS x FROM cells"""))
def unfold_mode(spark, folder):
    data = corpus(spark, folder)
    return tensor.unfold_mode(cells(data), "v", dims(data)).withColumn("x", F.round("x", 6))


@query("swap_modes", with_corpus("SELECT d AS t, v, t AS d, round(x, 6) AS x FROM cells"))
def swap_modes(spark, folder):
    return tensor.swap_modes(cells(corpus(spark, folder)), "t", "d").withColumn("x", F.round("x", 6))


@query("slice_time", with_corpus("SELECT (t - 4)::INT AS t, v, d, round(x, 6) AS x FROM cells WHERE t BETWEEN 4 AND 13"))
def slice_time(spark, folder):
    return tensor.slice_time(cells(corpus(spark, folder)), 4, 10).withColumn("x", F.round("x", 6))


# Factors of a planted tensor taken from the tables: market segments x part
# sizes x order priorities, each with two components.
PLANTED = """fa AS (SELECT dense_rank() OVER (ORDER BY k) - 1 AS i, a, b FROM (SELECT c_nationkey AS k,
      count(*) / 100.0::DOUBLE AS a, avg(c_acctbal) / 1000 AS b FROM customer GROUP BY 1)),
    fb AS (SELECT dense_rank() OVER (ORDER BY k) - 1 AS j, a, b FROM (SELECT p_size AS k,
      count(*) / 10.0::DOUBLE AS a, avg(p_retailprice) / 1000 AS b FROM part GROUP BY 1)),
    fc AS (SELECT dense_rank() OVER (ORDER BY k) - 1 AS k, a, b FROM (SELECT strftime(o_orderdate, '%Y-%m') AS k,
      count(*) / 100.0::DOUBLE AS a, avg(o_totalprice) / 100000 AS b FROM orders GROUP BY 1)),
    planted AS (SELECT i::INT AS i, j::INT AS j, fc.k::INT AS k, fa.a * fb.a * fc.a + fa.b * fb.b * fc.b AS x FROM fa, fb, fc)"""


def planted_factors(spark, folder):
    def factor(table, key, value, per, unit, axis):
        rows = read_table(spark, folder, table).withColumn("_k", key)
        stats = rows.groupBy("_k").agg(F.count("*").alias("_n"), F.avg(value).alias("_m"))
        u = F.array(F.col("_n") / per, F.col("_m") / unit)
        return stats.join(dense_index(rows, "_k", axis), "_k").select(axis, u.alias("u"))

    factors = {
        "i": factor("customer", F.col("c_nationkey"), "c_acctbal", 100.0, 1000, "i"),
        "j": factor("part", F.col("p_size"), "p_retailprice", 10.0, 1000, "j"),
        "k": factor("orders", F.date_format("o_orderdate", "yyyy-MM"), "o_totalprice", 100.0, 100000, "k"),
    }
    return factors, {axis: table.count() for axis, table in factors.items()}


@query("cp_synthetic_tensor", f"WITH {PLANTED} SELECT i, j, k, round(x, 6) AS x FROM planted")
def cp_synthetic_tensor(spark, folder):
    factors, dims = planted_factors(spark, folder)
    return tensor.cp_synthetic_tensor(spark, factors, dims, 2).withColumn("x", F.round("x", 6))
