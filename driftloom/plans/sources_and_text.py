"""Queries over scans, projections, samplers and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.functions import dates, records, stopwords, text
from driftloom.operators import sampling, series
from driftloom.operators.joins import anti_join
from driftloom.operators.numbering import number_rows
from driftloom.plans.corpus import cells, corpus, dims, english, english_counts
from driftloom.plans.oracle import (
    LINK, STOP, clean, hashed, quoted, tokens, with_bigrams, with_corpus,
)
from driftloom.plans import pipelines
from driftloom.plans.registry import query
from driftloom.session import read_table, scratch_path, spread
from driftloom.sources import scan, store

SEED = 7

# ---- files ------------------------------------------------------------------


def _line_files(spark, folder):
    """Document lines as gzip text, one folder per source."""
    path = scratch_path(spark, "lines")
    docs = read_table(spark, folder, "documents")
    lines = docs.select("source", F.explode(F.split("text", "\n")).alias("value"))
    lines.write.partitionBy("source").option("compression", "gzip").option("lineSep", "\n").text(path)
    return path


def _file_source():
    return F.regexp_extract("file", "source=([^/]+)", 1).alias("source")


@query("scan_gzip_lines", "SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents")
def scan_gzip_lines(spark, folder):
    lines = scan.scan_lines(spark, _line_files(spark, folder))
    return lines.select(_file_source(), F.col("value").alias("line"))


@query("count_lines", """SELECT source, count(*) AS n_lines FROM
    (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY source""")
def count_lines(spark, folder):
    counted = scan.count_lines(scan.scan_lines(spark, _line_files(spark, folder)))
    return counted.groupBy(_file_source()).agg(F.sum("n_lines").alias("n_lines"))


def _event_lines(spark, folder):
    path = scratch_path(spark, "records")
    events = read_table(spark, folder, "events")
    # A third of the records has a place, a third a null one, the rest none.
    plain = F.to_json(F.struct("event_id", "event_type", "value", F.parse_json("props").alias("props")))
    place = F.when(F.col("event_id") % 3 == 0, '"place":"x",').when(F.col("event_id") % 3 == 1, '"place":null,').otherwise("")
    record = F.concat(F.lit("{"), place, F.substring(plain, F.lit(2), F.length(plain)))
    events.select(record.alias("value")).write.option("compression", "gzip").text(path)
    return path


@query("scan_json_records", """SELECT event_id, event_type, value, (props->>'k')::BIGINT AS k,
    event_id % 3 <> 2 AS has_place FROM events""")
def scan_json_records(spark, folder):
    lines = scan.scan_lines(spark, _event_lines(spark, folder))
    schema = "event_id bigint, event_type string, value double, props struct<k: bigint>"
    parsed = scan.scan_json_records(lines.select(F.col("value").alias("line")), schema, column="line")
    return parsed.select(
        "event_id", "event_type", "value", "props.k", records.has_location("line").alias("has_place")
    )


def _hour_files(spark, folder):
    """Distinct hourly file names, as the events would be stored."""
    hour = F.date_format("ts", "yyyy-MM-dd-HH")
    name = F.concat(F.lit("records-id-"), hour, F.lit(".jsonl.gz"))
    return read_table(spark, folder, "events").select(name.alias("file_name")).distinct()


@query("files_in_range", """SELECT strftime(ts, '%Y-%m-%d-%H') AS date_hour, event_id::VARCHAR AS line FROM events
    WHERE strftime(ts, '%Y-%m-%d-%H') BETWEEN '2024-01-03-05' AND '2024-01-20-17'""")
def files_in_range(spark, folder):
    """Lines of the hourly files between two hours; the others are not opened."""
    path = scratch_path(spark, "hours")
    hour = F.date_format("ts", "yyyy-MM-dd-HH").alias("hour")
    lines = read_table(spark, folder, "events").select(hour, F.col("event_id").cast("string").alias("value"))
    lines.repartition("hour").write.partitionBy("hour").text(path)
    found = scan.scan_files_in_range(spark, path, "2024-01-03-05", "2024-01-20-17", by="file_path")
    return found.select(dates.extract_date_hour("file").alias("date_hour"), F.col("value").alias("line"))


@query("scan_headlines_csv", """SELECT strftime(o_orderdate, '%Y%m%d')::INT AS publish_date,
    o_orderstatus || ' "' || o_orderpriority || '", ' || o_orderkey AS headline_text FROM orders""")
def scan_headlines_csv(spark, folder):
    path = scratch_path(spark, "headlines")
    orders = read_table(spark, folder, "orders")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    headline = F.concat("o_orderstatus", F.lit(' "'), "o_orderpriority", F.lit('", '), "o_orderkey")
    good = orders.select(day.alias("publish_date"), headline.alias("headline_text"))
    good.write.options(header=True, escape='"').csv(path + "/good")
    # Every order also leaves a row with a field too many, which the scan drops.
    orders.select(F.concat(day, F.lit(",one,two many")).alias("value")).write.text(path + "/bad")
    return scan.scan_headlines_csv(spark, [path + "/good", path + "/bad"])


CATEGORIES = ["src9", "src0", "src14", "src5"]


@query("scan_by_category", f"""SELECT category, nth, doc_id FROM (
    SELECT list_position([{quoted(CATEGORIES)}], source) - 1 AS category, doc_id,
      row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS nth
    FROM documents WHERE source IN ({quoted(CATEGORIES)})) WHERE nth <= 26""")
def scan_by_category(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "source")
    return scan.scan_by_category(docs, CATEGORIES, 26).select("category", "nth", "doc_id")


TAG = store.run_tag(False, 2)


def _tagged_hours(events):
    return events.select(F.lit(TAG).alias("tag"), F.date_format("ts", "yyyy-MM-dd-HH").alias("date_hour")).distinct()


@query("new_files_only", f"""SELECT DISTINCT '{TAG}' AS tag, strftime(ts, '%Y-%m-%d-%H') AS date_hour FROM events
    WHERE strftime(ts, '%Y-%m-%d-%H') NOT IN
      (SELECT strftime(ts, '%Y-%m-%d-%H') FROM events WHERE value >= 60)""")
def new_files_only(spark, folder):
    events = read_table(spark, folder, "events")
    return store.new_files_only(_tagged_hours(events), _tagged_hours(events.where("value >= 60")))


@query("anti_existing_outputs", f"""SELECT DISTINCT strftime(ts, '%Y-%m-%d-%H') AS date_hour FROM events
    WHERE strftime(ts, '%Y-%m-%d-%H') NOT IN
      (SELECT strftime(ts, '%Y-%m-%d-%H') FROM events WHERE event_type = 'purchase')""")
def anti_existing_outputs(spark, folder):
    events = read_table(spark, folder, "events")
    done = _tagged_hours(events.where("event_type = 'purchase'"))
    return anti_join(_tagged_hours(events), done, ["tag", "date_hour"]).select("date_hour")


@query("run_tag", f"""SELECT DISTINCT strftime(ts, '%Y-%m') AS year_month, 'records-{TAG}-' ||
    strftime(ts, '%Y-%m-%d-%H') || '.jsonl.gz' AS output_name FROM events""")
def run_tag(spark, folder):
    files = _hour_files(spark, folder)
    month = dates.year_month(dates.extract_date_hour("file_name"))
    return files.select(month.alias("year_month"), store.tagged("file_name", TAG).alias("output_name"))


@query("save_tables", with_corpus("SELECT source, term, sum(n)::BIGINT AS n FROM counts GROUP BY ALL", upto="counts"))
def save_tables(spark, folder):
    per_source = english_counts(spark, folder).groupBy("source", "term").agg(F.sum("n").alias("n"))
    path = store.save_tables(per_source, scratch_path(spark, TAG), ["source"])
    return store.load_table(spark, path, "source string, term string, n bigint")


# ---- projections and predicates ---------------------------------------------


@query("project_text", "SELECT doc_id, text AS full_text FROM documents")
def project_text(spark, folder):
    docs = read_table(spark, folder, "documents")
    lines = docs.select("doc_id", F.to_json(F.struct(F.col("text").alias("full_text"), "lang")).alias("line"))
    return lines.select("doc_id", records.record_text("line").alias("full_text"))


@query("keep_keys", "SELECT event_id, value, (props->>'k')::BIGINT AS k FROM events")
def keep_keys(spark, folder):
    events = read_table(spark, folder, "events")
    fields = records.keep_map_keys(F.from_json("props", "map<string, bigint>"), ["k", "absent"])
    kept = records.keep_keys(events, ["event_id", "value", "absent", "props"])
    return kept.select("event_id", "value", fields["k"].alias("k"))


@query("filter_english", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en'")
def filter_english(spark, folder):
    docs = read_table(spark, folder, "documents")
    return docs.where(records.is_english("lang")).select("doc_id", "source", "n_chars")


@query("filter_english_lenient", """SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l USING (doc_id)
    WHERE l.doc_id IS NULL OR d.lang = 'en'""")
def filter_english_lenient(spark, folder):
    """Documents without a label lose their language, so they must pass."""
    docs = read_table(spark, folder, "documents").select("doc_id", "source", "lang")
    labels = read_table(spark, folder, "labels").select("doc_id", F.lit(True).alias("known"))
    known = docs.join(labels, "doc_id", "left").withColumn("lang", F.when(F.col("known"), F.col("lang")))
    return known.where(records.is_english_lenient("lang")).select("doc_id", "source")


def _labelled_records(spark, folder):
    """JSON records that hold `quality` and `toxic` only for labelled documents."""
    docs = read_table(spark, folder, "documents").select("doc_id", "lang")
    labels = read_table(spark, folder, "labels")
    joined = docs.join(labels, "doc_id", "left")
    return joined.select("doc_id", F.to_json(F.struct("doc_id", "lang", "quality", "toxic")).alias("line"))


@query("filter_originals", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def filter_originals(spark, folder):
    lines = _labelled_records(spark, folder)
    return lines.where(~records.is_repost("line", "quality")).select("doc_id")


@query("has_field", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS has_toxic FROM documents")
def has_field(spark, folder):
    return _labelled_records(spark, folder).select("doc_id", records.has_field("line", "toxic").alias("has_toxic"))


@query("generic_filter_map", "SELECT event_id, value * 4 AS value FROM events WHERE event_type = 'click' AND value > 5")
def generic_filter_map(spark, folder):
    steps = (
        records.Steps()
        .add_filter(F.col("event_type") == "click")
        .add_filter(lambda df: df["value"] > 5)
        .add_map(lambda df: df.select("event_id", (F.col("value") * 4).alias("value")))
    )
    return read_table(spark, folder, "events").transform(steps)


@query("record_filter_map", """SELECT event_id, event_type || '!' AS kind, value * 4 AS value FROM events
    WHERE event_type = 'click' AND value > 5 AND value * 4 < 300""")
def record_filter_map(spark, folder):
    """Functions on single records between steps on columns."""
    steps = (
        records.Steps()
        .add_record_filter(lambda r: r["event_type"] == "click")
        .add_filter(F.col("value") > 5)
        .add_record_map(
            lambda r: {"event_id": r["event_id"], "kind": r["event_type"] + "!", "value": r["value"] * 4},
            "event_id bigint, kind string, value double",
        )
        .add_record_filter(lambda r: r["value"] < 300)
    )
    return read_table(spark, folder, "events").select("event_id", "event_type", "value").transform(steps)


@query("filter_alphabetic_terms", with_corpus(
    "SELECT term, n FROM stats WHERE regexp_matches(term, '[a-zA-Z]')", upto="stats"))
def filter_alphabetic_terms(spark, folder):
    totals = english_counts(spark, folder).groupBy("term").agg(F.sum("n").alias("n"))
    return totals.where(records.has_letter("term"))


@query("guard_nonnegative", "SELECT o_orderkey, o_totalprice FROM orders")
def guard_nonnegative(spark, folder):
    orders = read_table(spark, folder, "orders")
    return orders.select("o_orderkey", records.guard_nonnegative("o_totalprice").alias("o_totalprice"))


# ---- sampling ---------------------------------------------------------------


@query("sample_exact_n", f"""SELECT doc_id, source FROM documents
    ORDER BY md5(doc_id::VARCHAR || '#{SEED}'), doc_id LIMIT 100""")
def sample_exact_n(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "source")
    return sampling.sample_exact_n(docs, 100, "doc_id", SEED)


@query("subset_by_position", """SELECT o_orderkey, o_totalprice FROM
    (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders)
    WHERE pos IN (1, 2, 3, 77, 500, 1400)""")
def subset_by_position(spark, folder):
    orders = read_table(spark, folder, "orders")
    positions = spark.createDataFrame([(p,) for p in (1, 2, 3, 77, 500, 1400)], "pos bigint")
    kept = sampling.subset_by_position(orders, positions, ["o_orderdate", "o_orderkey"])
    return kept.select("o_orderkey", "o_totalprice")


MONTHLY = f"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, row_number() OVER (
    PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY md5(o_orderkey::VARCHAR || '#{SEED}'), o_orderkey)::INT AS draw
    FROM orders"""


def _orders_by_month(spark, folder):
    orders = read_table(spark, folder, "orders")
    return orders.select("o_orderkey", "o_totalprice", "o_orderdate", F.date_format("o_orderdate", "yyyy-MM").alias("month"))


@query("sample_n_per_group", f"SELECT * FROM ({MONTHLY}) WHERE draw <= 50")
def sample_n_per_group(spark, folder):
    orders = _orders_by_month(spark, folder).select("o_orderkey", "month")
    return sampling.sample_n_per_group(orders, "month", 50, "o_orderkey", SEED)


NUMBERED_DOCS = "numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)"


def draws_sql(iterations: int, batch: int, population: str, seed: int = SEED) -> str:
    return f"""draws AS (SELECT i AS iter, j AS draw, {hashed('i', 'j', seed)} % ({population}) AS pos
        FROM range(1, {iterations} + 1) a(i), range({batch}) b(j))"""


@query("minibatch_with_replacement", f"""WITH {NUMBERED_DOCS}, {draws_sql(5, 200, 'SELECT count(*) FROM documents')}
    SELECT iter, draw, doc_id FROM draws JOIN numbered USING (pos)""")
def minibatch_with_replacement(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id")
    numbered = number_rows(docs, ["doc_id"])
    drawn = sampling.minibatch_with_replacement(numbered, 5, 200, docs.count(), SEED)
    return drawn.select("iter", "draw", "doc_id")


@query("sample_tensor_docs", with_corpus(
    "SELECT t, v, draw::INT AS d, round(x, 6) AS x FROM cells JOIN draws ON cells.d = draws.pos",
    draws_sql(1, 12, "SELECT max(d) + 1 FROM slices")))
def sample_tensor_docs(spark, folder):
    data = corpus(spark, folder)
    return sampling.sample_tensor_docs(cells(data), dims(data)["d"], 12, SEED).withColumn("x", F.round("x", 6))


@query("sample_time_patches", with_corpus("""SELECT draw::INT AS patch, (t - pos)::INT AS t,
    v::BIGINT * (SELECT max(d) + 1 FROM slices) + d AS vd, round(x, 6) AS x
    FROM cells JOIN draws ON cells.t BETWEEN draws.pos AND draws.pos + 4""",
    draws_sql(1, 3, "SELECT max(t) + 1 - 5 FROM slices")))
def sample_time_patches(spark, folder):
    data = corpus(spark, folder)
    size = dims(data)
    return sampling.sample_time_patches(cells(data), size["t"], 5, 3, SEED, size["d"]).withColumn("x", F.round("x", 6))


# ---- text -------------------------------------------------------------------


@query("remove_links", f"""SELECT page_id, regexp_replace('see ' || url || ' or' || chr(160) || html, '{LINK}', '', 'g')
    AS unlinked FROM pages""")
def remove_links(spark, folder):
    page = F.concat(F.lit("see "), "url", F.lit(" or\u00a0"), "html")
    return read_table(spark, folder, "pages").select("page_id", text.remove_links(page).alias("unlinked"))


TAGGED = "'@' || lang || 'user ' || text || ' x.@' || source || ' (@' || source || ')@a-b'"


@query("remove_user_tags", rf"""SELECT doc_id, regexp_replace({TAGGED},
    '(^|[^a-zA-Z0-9_.-])@[A-Za-z]+[A-Za-z0-9_-]+', '\1', 'g') AS untagged FROM documents""")
def remove_user_tags(spark, folder):
    tagged = F.concat(
        F.lit("@"), "lang", F.lit("user "), "text", F.lit(" x.@"), "source", F.lit(" (@"), "source", F.lit(")@a-b")
    )
    return read_table(spark, folder, "documents").select("doc_id", text.remove_user_tags(tagged).alias("untagged"))


@query("clean_text", f"SELECT doc_id, {clean('text')} AS cleaned FROM documents WHERE lang = 'en'")
def clean_text(spark, folder):
    return english(spark, folder).select("doc_id", text.clean_text("text").alias("cleaned"))


def _joined(words):
    return F.array_join(words, "|")


@query("tokenize_words", f"""SELECT doc_id, len(words) AS n_tokens, array_to_string(words, '|') AS tokens
    FROM (SELECT doc_id, {tokens('text', stop=False)} AS words FROM documents)""")
def tokenize_words(spark, folder):
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    words = docs.select("doc_id", text.tokenize_words("text").alias("words"))
    return words.select("doc_id", F.size("words").cast("bigint").alias("n_tokens"), _joined("words").alias("tokens"))


SOCIAL_SQL = text.SOCIAL.replace("'", "''")
EMOTICON_SQL = text.EMOTICON.replace("'", "''")


@query("tokenize_social", f"""SELECT doc_id, array_to_string(list_transform(
      regexp_extract_all('Hi @' || source || ' :-D #' || lang || ' ' || text, '{SOCIAL_SQL}'),
      lambda w: CASE WHEN regexp_full_match(w, '{EMOTICON_SQL}') THEN w ELSE lower(w) END), '|') AS tokens FROM documents""")
def tokenize_social(spark, folder):
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    post = F.concat(F.lit("Hi @"), "source", F.lit(" :-D #"), "lang", F.lit(" "), "text")
    return docs.select("doc_id", _joined(text.tokenize_social(post)).alias("tokens"))


# ---- record pipelines -------------------------------------------------------

POSTS = f"""posts AS (SELECT source, doc_id, {clean('text')} AS text FROM documents WHERE lang = 'en' AND doc_id % 5 <> 0),
    words AS (SELECT source, doc_id, list_filter(list_transform(regexp_extract_all(text, '{SOCIAL_SQL}'),
        lambda w: CASE WHEN regexp_full_match(w, '{EMOTICON_SQL}') THEN w ELSE lower(w) END), lambda w: w NOT IN ({STOP})) AS words FROM posts),
    terms AS (SELECT source, doc_id, term, count(*) AS n FROM
        (SELECT source, doc_id, unnest({with_bigrams('words')}) AS term FROM words) GROUP BY ALL),
    stats AS (SELECT source, term, sum(n)::BIGINT AS n, count(*) AS df FROM terms GROUP BY ALL)"""


def _record_files(spark, folder):
    """Documents as records of gzip files, a folder per source; every fifth is a repost."""
    path = scratch_path(spark, "posts")
    docs = read_table(spark, folder, "documents")
    plain = F.to_json(F.struct(F.col("text").alias("full_text"), "lang"))
    repost = F.when(F.col("doc_id") % 5 == 0, '"retweeted_status":{"id":1},').otherwise("")
    record = F.concat(F.lit("{"), repost, F.substring(plain, F.lit(2), F.length(plain)))
    docs.select("source", record.alias("value")).write.partitionBy("source").option("compression", "gzip").text(path)
    return path


@query("text_pipeline", f"WITH {POSTS} SELECT source, text FROM posts")
def text_pipeline(spark, folder):
    return pipelines.text_pipeline(spark, _record_files(spark, folder)).select(_file_source(), "text")


@query("vocabulary_per_file", f"WITH {POSTS} SELECT source, term, n, df FROM stats")
def vocabulary_per_file(spark, folder):
    """A source may be several files: its counts are the sums of theirs."""
    found = pipelines.vocabulary_per_file(spark, _record_files(spark, folder))
    return found.groupBy(_file_source(), "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


@query("bags_per_file", f"""WITH {POSTS}, known AS (SELECT term FROM stats GROUP BY term HAVING sum(df) >= 5)
    SELECT source, (SELECT count(*) FROM posts p WHERE p.source = s.source) AS n_docs, term, sum(n)::BIGINT AS n, count(*) AS n_bags
    FROM terms s JOIN known USING (term) GROUP BY source, term""")
def bags_per_file(spark, folder):
    """Bags of terms in at least five posts; every record is a document, equal ones too."""
    path = _record_files(spark, folder)
    known = pipelines.vocabulary_per_file(spark, path).groupBy("term").agg(F.sum("df").alias("df")).where("df >= 5")
    known = number_rows(known.select("term"), ["term"], name="term_id")
    documents, bags = pipelines.bags_per_file(spark, path, known)
    sizes = documents.groupBy(_file_source()).agg(F.countDistinct("doc_id").alias("n_docs"))
    named = bags.join(known, "term_id").groupBy(_file_source(), "term").agg(F.sum("n").alias("n"), F.count("*").alias("n_bags"))
    return named.join(sizes, "source").select("source", "n_docs", "term", "n", "n_bags")


@query("remove_stopwords", with_corpus(
    "SELECT doc_id, len(words) AS n_tokens, array_to_string(words, '|') AS tokens FROM toks", upto="toks"))
def remove_stopwords(spark, folder):
    words = stopwords.remove_stopwords(text.tokenize_words(text.clean_text("text")))
    docs = english(spark, folder).select("doc_id", words.alias("words"))
    return docs.select("doc_id", F.size("words").cast("bigint").alias("n_tokens"), _joined("words").alias("tokens"))


LISTS_SQL = " UNION ".join(f"SELECT unnest([{quoted(words)}]) AS term" for words in stopwords.LISTS.values())


def _plain_tokens(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.explode(text.tokenize_words("text")).alias("term"))


@query("stopword_union", f"""SELECT term, count(used) AS n_used FROM ({LISTS_SQL}) LEFT JOIN
    (SELECT unnest({tokens('text', stop=False)}) AS used FROM documents) ON term = used GROUP BY term""")
def stopword_union(spark, folder):
    """The union with the number of times the documents use each entry."""
    used = _plain_tokens(spark, folder).groupBy("term").agg(F.count("*").alias("n_used"))
    union = stopwords.stopword_union(spark)
    return union.join(used, "term", "left").select("term", F.coalesce("n_used", F.lit(0)).alias("n_used"))


@query("union_distinct", f"""SELECT term FROM (SELECT unnest({tokens('text', stop=False)}) AS term FROM documents)
    UNION SELECT term FROM ({LISTS_SQL})""")
def union_distinct(spark, folder):
    return _plain_tokens(spark, folder).select("term").unionByName(stopwords.stopword_union(spark)).distinct()


@query("anti_stopwords", f"""SELECT term, count(*) AS n FROM
    (SELECT unnest({tokens('text', stop=False)}) AS term FROM documents) WHERE term NOT IN ({STOP}) GROUP BY term""")
def anti_stopwords(spark, folder):
    kept = anti_join(_plain_tokens(spark, folder), stopwords.stopword_union(spark), ["term"])
    return kept.groupBy("term").agg(F.count("*").alias("n"))


def _three_grams(words: str) -> str:
    triples = f"""list_transform(range(1, len({words}) - 1),
        lambda i: {words}[i] || ' ' || {words}[i + 1] || ' ' || {words}[i + 2])"""
    return f"list_concat({with_bigrams(words)}, {triples})"


@query("ngrams", with_corpus(
    f"SELECT doc_id, array_to_string({_three_grams('words')}, '|') AS grams FROM toks", upto="toks"))
def ngrams(spark, folder):
    words = stopwords.remove_stopwords(text.tokenize_words(text.clean_text("text")))
    return english(spark, folder).select("doc_id", _joined(text.ngrams(words, 3)).alias("grams"))


# The tables hold no emoji, so each text gets a tail that depends on its language.
TAILS = {"en": "🦠 coronavirus. 🤒😷😷😷", "fr": "☀️🇫🇷 👩🏽‍🔬", "de": "No emojis here. :( )"}
TAIL_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TAILS.items()) + " ELSE '5️⃣' END"


def _with_tail(spark, folder):
    tail = F.lit("5️⃣")
    for lang, value in TAILS.items():
        tail = F.when(F.col("lang") == lang, value).otherwise(tail)
    docs = read_table(spark, folder, "documents")
    return docs.select("doc_id", F.concat("text", F.lit(" "), tail).alias("post"))


@query("extract_emojis", f"""SELECT doc_id, array_to_string(regexp_extract_all(text || ' ' || {TAIL_SQL}, '{text.EMOJI}'), '|')
    AS emojis FROM documents""")
def extract_emojis(spark, folder):
    return _with_tail(spark, folder).select("doc_id", _joined(text.extract_emojis("post")).alias("emojis"))


@query("contains_emoji", f"SELECT doc_id, regexp_matches(text || ' ' || {TAIL_SQL}, '{text.EMOJI}') AS has_emoji FROM documents")
def contains_emoji(spark, folder):
    return _with_tail(spark, folder).select("doc_id", text.contains_emoji("post").alias("has_emoji"))


# ---- dates ------------------------------------------------------------------


def _event_names(spark, folder):
    events = read_table(spark, folder, "events")
    label = F.date_format("ts", "yyyy-MM-dd-HH")
    name = F.when(F.col("event_type") == "view", F.concat(F.lit("hello-"), F.date_format("ts", "yyyy-MM-dd")))
    return events.select("event_id", "ts", name.otherwise(F.concat(F.lit("id-"), label, F.lit("-05.txt"))).alias("name"))


@query("extract_date_hour", """SELECT event_id, CASE WHEN event_type <> 'view'
    THEN strftime(ts, '%Y-%m-%d-%H') ELSE 'none' END AS date_hour FROM events""")
def extract_date_hour(spark, folder):
    found = dates.extract_date_hour("name")
    return _event_names(spark, folder).select("event_id", F.coalesce(found, F.lit("none")).alias("date_hour"))


@query("date_hour_to_ts", "SELECT event_id, date_trunc('hour', ts) AS hour FROM events")
def date_hour_to_ts(spark, folder):
    events = read_table(spark, folder, "events")
    label = F.date_format("ts", "yyyy-MM-dd-HH")
    return events.select("event_id", dates.date_hour_to_ts(label).alias("hour"))


@query("year_month", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def year_month(spark, folder):
    label = F.date_format("o_orderdate", "yyyy-MM-dd-HH")
    return read_table(spark, folder, "orders").select("o_orderkey", dates.year_month(label).alias("month"))


SINCE = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 05:00:00')) / 1000000.0"


@query("week_index", f"SELECT event_id, trunc({SINCE} / 604800)::INT AS week FROM events")
def week_index(spark, folder):
    week = dates.week_index("ts", dates.start_of("2024-01-10-05"))
    return read_table(spark, folder, "events").select("event_id", week.alias("week"))


@query("day_index", f"SELECT event_id, trunc({SINCE} / 86400)::INT AS day FROM events")
def day_index(spark, folder):
    day = dates.day_index("ts", dates.start_of("2024-01-10-05"))
    return read_table(spark, folder, "events").select("event_id", day.alias("day"))


@query("parse_compact_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS day FROM orders")
def parse_compact_date(spark, folder):
    orders = read_table(spark, folder, "orders")
    number = F.date_format("o_orderdate", "yyyyMMdd").cast("int")
    return orders.select("o_orderkey", F.date_format(dates.parse_compact_date(number), "yyyy/MM/dd").alias("day"))


@query("date_axis", """SELECT event_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS t,
    strftime(ts, '%m-%d') AS label FROM events""")
def date_axis(spark, folder):
    day = dates.day_index("ts", dates.start_of("2024-01-01-00"))
    events = read_table(spark, folder, "events").select("event_id", day.alias("t"))
    return events.withColumn("label", dates.date_label("t", "2024-01-01"))


# ---- numbers ----------------------------------------------------------------


@query("to_proportion", """SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER
    (PARTITION BY strftime(o_orderdate, '%Y-%m')), 9) AS share FROM orders""")
def to_proportion(spark, folder):
    shares = series.to_proportion(_orders_by_month(spark, folder), ["month"], "o_totalprice")
    return shares.select("o_orderkey", F.round("share", 9).alias("share"))


@query("normalise_window", """SELECT event_id, round(value / sum(value) OVER (PARTITION BY event_type), 9) AS share,
    round(value / (SELECT sum(value) FROM events), 9) AS overall FROM events""")
def normalise_window(spark, folder):
    events = read_table(spark, folder, "events").select("event_id", "event_type", "value")
    shares = series.to_proportion(series.to_proportion(events, ["event_type"], "value"), [], "value", "overall")
    return shares.select("event_id", F.round("share", 9).alias("share"), F.round("overall", 9).alias("overall"))


@query("scale_weights", with_corpus("SELECT doc_id, term_id, round(x * 10000, 4) AS x FROM tfidf", upto="tfidf"))
def scale_weights(spark, folder):
    scaled = F.round(F.col("x") * 10000, 4)
    return corpus(spark, folder).weights.select("doc_id", "term_id", scaled.alias("x"))


@query("vector_norms", with_corpus("""SELECT round(sum(x), 6) AS l1, round(sqrt(sum(x * x)), 6) AS l2,
    round(sum(x) / ((SELECT count(*) FROM vocab) * (SELECT count(*) FROM docs)) * 100000, 6) AS mean_size FROM tfidf""", upto="tfidf"))
def vector_norms(spark, folder):
    data = corpus(spark, folder)
    norms = series.vector_norms(data.weights, "x", data.n_terms * data.n_docs)
    return norms.select(
        F.round("l1", 6).alias("l1"), F.round("l2", 6).alias("l2"), F.round(F.col("mean_size") * 100000, 6).alias("mean_size")
    )
