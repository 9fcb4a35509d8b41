"""Registered queries: name -> (Spark job, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from chatloom.functions import bodies, captured, fixed, text
from chatloom.functions.captured import EntryMarks
from chatloom.operators import (
    capture, cleaning, coherence, compare, dedupe, dictionary, epochs, report, retain, sentiment, topics, training, webhook,
)
from chatloom.plans import given, sql
from chatloom.session import materialise, scratch_dir, spread
from chatloom.sources import live as live_sources, sinks
from chatloom.sources import chat_csv
from chatloom.sources.capped import capped_stream
from chatloom.sources.chat_csv import union_labelled
from chatloom.streaming import live, measured, state
from chatloom.streaming.retained import read_retained
from chatloom.streaming.trend import TrendTable, start_trend


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, check: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        CATALOG[name] = Query(build, check)
        return build

    return register


# --- text -------------------------------------------------------------------------


@query("clean_tokens", f"""WITH {sql.DOC_TOKENS}
    SELECT doc_id, len(tokens)::BIGINT AS n_tokens, array_to_string(tokens, ' ') AS cleaned FROM cleaned""")
def clean_tokens(spark, d):
    return given.documents_tokens(spark, d).select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.array_join("tokens", " ").alias("cleaned")
    )


@query("lemma_tokens", f"""WITH {sql.DOC_TOKENS},
    lemmas(surface, lemma) AS (VALUES {", ".join(f"({sql.quote(a)}, {sql.quote(b)})" for a, b in given.SAMPLE_LEMMAS.items())}),
    words AS (SELECT doc_id, unnest(tokens) AS word FROM cleaned)
    SELECT coalesce(lemma, word) AS token, count(*)::BIGINT AS n FROM words LEFT JOIN lemmas ON word = surface GROUP BY 1""")
def lemma_tokens(spark, d):
    docs = cleaning.with_tokens(given.documents_chat(spark, d), key="doc_id", lemmas=given.SAMPLE_LEMMAS)
    return cleaning.exploded(docs).groupBy("token").agg(F.count("*").alias("n"))


@query("text_steps", f"""SELECT doc_id,
      length(regexp_replace(text, {sql.quote(text.URL)}, '', 'g'))::BIGINT AS n_without_urls,
      length(regexp_replace(text, {sql.quote(text.PUNCTUATION)}, '', 'g'))::BIGINT AS n_without_punctuation,
      length(regexp_replace(text, {sql.quote(text.DIGITS)}, '', 'g'))::BIGINT AS n_without_digits,
      length({sql.strip('text')})::BIGINT AS n_stripped,
      starts_with({sql.strip(f"regexp_replace(lower(text), {sql.quote(text.URL)}, '', 'g')")}, '!') AS is_command
    FROM documents""")
def text_steps(spark, d):
    t = F.col("message")
    count = lambda c: F.length(c).cast("bigint")
    return given.documents_chat(spark, d).select(
        "doc_id",
        count(text.remove_urls(t)).alias("n_without_urls"),
        count(text.remove_punctuation(t)).alias("n_without_punctuation"),
        count(text.remove_digits(t)).alias("n_without_digits"),
        count(text.strip(t)).alias("n_stripped"),
        text.is_command(t).alias("is_command"),
    )


@query("bag_of_words", f"""WITH {sql.DOC_TOKENS}
    SELECT doc_id, token, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(tokens) AS token FROM cleaned) GROUP BY ALL""")
def bag_of_words(spark, d):
    return cleaning.bag_of_words(given.documents_tokens(spark, d), "doc_id")


@query("vocabulary", f"""WITH {sql.DOC_TOKENS}
    SELECT token, count(DISTINCT doc_id)::BIGINT AS doc_freq, count(*)::BIGINT AS term_freq
    FROM (SELECT doc_id, unnest(tokens) AS token FROM cleaned) GROUP BY token""")
def vocabulary(spark, d):
    return cleaning.vocabulary(given.documents_tokens(spark, d))


@query("dictionary_index", f"""WITH {sql.DOC_TOKENS}, words AS (SELECT doc_id, unnest(tokens) AS token FROM cleaned)
    SELECT token, row_number() OVER (ORDER BY token) - 1 AS word_id, count(DISTINCT doc_id)::BIGINT AS doc_freq, count(*)::BIGINT AS term_freq
    FROM words GROUP BY token""")
def dictionary_index(spark, d):
    return dictionary.indexed_vocabulary(given.documents_tokens(spark, d)).select("token", "word_id", "doc_freq", "term_freq")


# --- sentiment --------------------------------------------------------------------


@query("sentiment_polarity", f"""WITH {sql.DOC_POLARITY}
    SELECT doc_id, round(sentiment_score, 6) AS sentiment_score, sentiment FROM scored""")
def sentiment_polarity(spark, d):
    return given.documents_scored(spark, d).select(
        "doc_id", F.round("sentiment_score", 6).alias("sentiment_score"), "sentiment"
    )


@query("sentiment_valence", sql.valence_sql("documents", "doc_id", "text"))
def sentiment_valence(spark, d):
    scored = sentiment.with_valence(
        spread(given.documents_chat(spark, d)), given.SAMPLE_VALENCE, key="doc_id", rules=given.SAMPLE_RULES
    )
    return scored.select("doc_id", "sentiment_score", "sentiment")


@query("turn_valence", f"WITH {sql.TURNS}, inner_result AS ({sql.valence_sql('turns', 'msg_key', 'text')}) SELECT * FROM inner_result")
def turn_valence(spark, d):
    scored = sentiment.with_valence(given.conversations_chat(spark, d), given.SAMPLE_VALENCE, rules=given.SAMPLE_RULES)
    return scored.select("msg_key", "sentiment_score", "sentiment")


@query("sentiment_by_method", f"""WITH {sql.DOC_POLARITY}, valued AS ({sql.valence_sql("documents", "doc_id", "text")}),
    named AS (SELECT doc_id, {sql.strip("text")} = '' AS blank FROM documents)
    SELECT 'textblob' AS method, sentiment, count(*)::BIGINT AS n FROM scored GROUP BY ALL
    UNION ALL SELECT 'vader', sentiment, count(*)::BIGINT FROM valued GROUP BY ALL
    UNION ALL SELECT 'bert', CASE WHEN blank THEN 'unknown' WHEN doc_id % 3 = 0 THEN 'negative' WHEN doc_id % 3 = 2 THEN 'positive'
      ELSE 'unknown' END, count(*)::BIGINT FROM named GROUP BY ALL
    UNION ALL SELECT 'custom_kick_bert', CASE WHEN blank THEN 'unknown' WHEN doc_id % 3 = 0 THEN 'negative' WHEN doc_id % 3 = 1 THEN 'neutral'
      ELSE 'positive' END, count(*)::BIGINT FROM named GROUP BY ALL""")
def sentiment_by_method(spark, d):
    """All four methods; a stage that names `LABEL_n` by the document's number stands for a user's fitted model."""
    docs = given.documents_chat(spark, d)
    model = PipelineModel(stages=[SQLTransformer(statement="SELECT *, concat('LABEL_', doc_id % 3) AS predicted_name FROM __THIS__")])
    options = {"textblob": {"lexicon": given.SAMPLE_POLARITY}, "vader": {"lexicon": given.SAMPLE_VALENCE, "rules": given.SAMPLE_RULES},
               "bert": {"model": model}, "custom_kick_bert": {"model": model}}
    parts = [
        sentiment.run_sentiment(docs, method, key="doc_id", **extra).select(F.lit(method).alias("method"), "sentiment")
        for method, extra in options.items()
    ]
    return union_labelled(parts).groupBy("method", "sentiment").agg(F.count("*").alias("n"))


@query("blank_guard", f"""SELECT CASE WHEN {sql.strip("split_part(text, '.', 2)")} = '' THEN 'unknown' ELSE 'neutral' END AS sentiment,
      count(*)::BIGINT AS n FROM conversations GROUP BY 1""")
def blank_guard(spark, d):
    """A model that always says neutral, over texts of which some are blank."""
    model = PipelineModel(stages=[SQLTransformer(statement="SELECT *, 'LABEL_1' AS predicted_name FROM __THIS__")])
    chat = given.conversations_chat(spark, d).withColumn("message", F.split_part(F.col("message"), F.lit("."), F.lit(2)))
    return sentiment.with_model_label(chat, model).groupBy("sentiment").agg(F.count("*").alias("n"))


# --- report -----------------------------------------------------------------------


@query("sentiment_distribution", f"""WITH {sql.DOC_POLARITY}
    SELECT sentiment, count(*)::BIGINT AS n FROM scored GROUP BY sentiment""")
def sentiment_distribution(spark, d):
    return report.distribution(given.documents_scored(spark, d))


@query("overall_mood", f"""WITH {sql.DOC_POLARITY}
    SELECT sentiment FROM scored GROUP BY sentiment ORDER BY count(*) DESC, sentiment LIMIT 1""")
def overall_mood(spark, d):
    return report.overall_label(given.documents_scored(spark, d))


@query("sentiment_trend_minute", f"""WITH {sql.TURNS}, {sql.polarity_cte('turns', 'msg_key', 'text')}
    SELECT strftime(date_trunc('minute', epoch_ms(sec * 1000)), '%Y-%m-%d %H:%M:%S') AS period,
      {", ".join(f"count(*) FILTER (sentiment = '{x}')::BIGINT AS {x}" for x in fixed.LABELS)}
    FROM turns JOIN scored USING (msg_key) GROUP BY 1""")
def sentiment_trend_minute(spark, d):
    chat = given.conversations_chat(spark, d).withColumn("ts", text.parse_time(F.col("timestamp")))
    table = report.trend(sentiment.with_polarity(chat, given.SAMPLE_POLARITY))
    return table.withColumn("period", F.date_format("period", given.TEXT_TIME))


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def _event_trend_sql(period: str) -> str:
    return f"""SELECT strftime(date_trunc('{period}', ts), '%Y-%m-%d %H:%M:%S') AS period,
      {", ".join(f"count(*) FILTER (event_type = '{x}')::BIGINT AS {x}" for x in EVENT_TYPES)} FROM events GROUP BY 1"""


def _event_trend(spark, d, period):
    events = given.table(spark, d, "events")
    table = report.trend(events, label="event_type", labels=EVENT_TYPES, period=period)
    return table.withColumn("period", F.date_format("period", given.TEXT_TIME))


@query("event_trend_minute", _event_trend_sql("minute"))
def event_trend_minute(spark, d):
    return _event_trend(spark, d, "minute")


@query("event_trend_hour", _event_trend_sql("hour"))
def event_trend_hour(spark, d):
    return _event_trend(spark, d, "hour")


@query("event_trend_long", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS period, event_type,
      count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def event_trend_long(spark, d):
    counts = report.trend_counts(given.table(spark, d, "events"), label="event_type", period="1 hour")
    return counts.withColumn("period", F.date_format("period", given.TEXT_TIME))


@query("negative_top_words", f"""WITH {sql.DOC_TOKENS}, {sql.DOC_POLARITY}
    SELECT token, count(*)::BIGINT AS n FROM (
      SELECT unnest(tokens) AS token FROM cleaned JOIN scored USING (doc_id) WHERE sentiment = 'negative')
    GROUP BY token ORDER BY n DESC, token LIMIT 3""")
def negative_top_words(spark, d):
    return report.negative_top_words(cleaning.with_tokens(given.documents_scored(spark, d), key="doc_id"))


@query("suggestions", f"""WITH {sql.DOC_TOKENS}, {sql.DOC_POLARITY}, {sql.language_topics_cte(5)},
    mood AS (SELECT sentiment FROM scored GROUP BY sentiment ORDER BY count(*) DESC, sentiment LIMIT 1),
    lead AS (SELECT topic FROM topics GROUP BY topic, mass ORDER BY mass DESC, topic LIMIT 1),
    neg AS (
      SELECT token, count(*) AS n FROM (
        SELECT unnest(tokens) AS token FROM cleaned JOIN scored USING (doc_id) WHERE sentiment = 'negative')
      GROUP BY token ORDER BY n DESC, token LIMIT 3)
    SELECT 1 AS rank, 'mood' AS kind, CASE sentiment WHEN 'positive' THEN {sql.quote(fixed.MOOD_TEXT['positive'])}
      WHEN 'negative' THEN {sql.quote(fixed.MOOD_TEXT['negative'])} ELSE {sql.quote(fixed.MOOD_TEXT['neutral'])} END AS text FROM mood
    UNION ALL SELECT 2, 'topic_words', {sql.quote(fixed.TOPIC_TEXT[0])} || string_agg(word, ', ' ORDER BY rank) || {sql.quote(fixed.TOPIC_TEXT[1])}
      FROM topics JOIN lead USING (topic)
    UNION ALL SELECT 3, 'negative_words', {sql.quote(fixed.NEGATIVE_TEXT[0])} || string_agg(token, ', ' ORDER BY n DESC, token) || {sql.quote(fixed.NEGATIVE_TEXT[1])}
      FROM neg HAVING count(*) > 0""")
def suggestions(spark, d):
    scored = cleaning.with_tokens(given.documents_scored(spark, d), key="doc_id")
    # Three readers, as in the whole analysis: scored and cleaned once.
    scored = materialise(scored.select("lang", "sentiment", "tokens"), "scored-documents")
    return report.suggestions(scored, given.language_topics(scored, 5))


@query("preview", f"""WITH {sql.TURNS}
    SELECT {sql.TURN_TIME} AS timestamp, role AS username, text AS message FROM turns ORDER BY sec, msg_key LIMIT 5""")
def preview(spark, d):
    return report.preview(given.conversations_chat(spark, d), ("timestamp", "msg_key"))


@query("negative_messages", f"""WITH {sql.TURNS}, {sql.polarity_cte('turns', 'msg_key', 'text')}
    SELECT msg_key, sentiment FROM scored WHERE sentiment = 'negative'""")
def negative_messages(spark, d):
    scored = sentiment.with_polarity(given.conversations_chat(spark, d), given.SAMPLE_POLARITY)
    return report.negative_messages(scored).select("msg_key", "sentiment")


@query("result_rows", f"""WITH {sql.TURNS}, {sql.polarity_cte('turns', 'msg_key', 'text')}
    SELECT {sql.TURN_TIME} AS timestamp, role AS username, text AS message, sentiment FROM turns JOIN scored USING (msg_key)""")
def result_rows(spark, d):
    chat = given.conversations_chat(spark, d).withColumn("ts", text.parse_time(F.col("timestamp")))
    return report.result_rows(sentiment.with_polarity(chat, given.SAMPLE_POLARITY))


# --- topics -----------------------------------------------------------------------


@query("language_topics", f"""WITH {sql.DOC_TOKENS}, {sql.language_topics_cte(5)}
    SELECT topic, rank::BIGINT AS rank, word, printf('%.3f', weight) AS weight FROM topics""")
def language_topics(spark, d):
    return topics.topic_table(given.language_topics(given.documents_tokens(spark, d), 5)).withColumn("rank", F.col("rank").cast("bigint"))


@query("topic_cloud", f"""WITH {sql.DOC_TOKENS}, {sql.language_topics_cte(40)}
    SELECT word, round(sum(round(weight, 3)), 3) AS weight FROM topics GROUP BY word ORDER BY weight DESC, word LIMIT 100""")
def topic_cloud(spark, d):
    return topics.cloud_weights(given.language_topics(given.documents_tokens(spark, d), 40))


@query("coherence_window_counts", f"""WITH {sql.DOC_TOKENS}, {sql.language_topics_cte(20)}, {sql.window_counts_cte()}
    SELECT word_a, word_b, n FROM counts""")
def coherence_window_counts(spark, d):
    tokens = materialise(given.documents_tokens(spark, d).select("lang", "tokens"), "document-tokens")
    return coherence.window_counts(tokens, given.language_topic_words(tokens, fixed.COHERENCE_WORDS))


_NPMI = f"""
    total AS (SELECT n AS t FROM counts WHERE word_a = ''),
    ordered AS (SELECT a.topic, a.word AS w, b.word AS o FROM topics a JOIN topics b USING (topic)),
    shares AS (
      SELECT topic, w, o, coalesce(p.n, 0) / t + {fixed.COHERENCE_EPSILON}::DOUBLE AS both_share, (x.n / t) * (y.n / t) AS apart
      FROM ordered LEFT JOIN counts p ON p.word_a = least(w, o) AND p.word_b = greatest(w, o)
      JOIN counts x ON x.word_a = w AND x.word_b = w JOIN counts y ON y.word_a = o AND y.word_b = o, total),
    npmi AS (SELECT topic, w, o, ln(both_share / apart) / -ln(both_share) AS m FROM shares),
    sums AS (SELECT *, sum(m) OVER (PARTITION BY topic, o) AS s FROM npmi),
    cosines AS (SELECT topic, w, sum(m * s) / (sqrt(sum(m * m)) * sqrt(sum(s * s))) AS c FROM sums GROUP BY topic, w)"""


@query("topic_coherence", f"""WITH {sql.DOC_TOKENS}, {sql.language_topics_cte(20)}, {sql.window_counts_cte()}, {_NPMI}
    SELECT topic, round(avg(c), 6) AS coherence FROM cosines GROUP BY topic""")
def topic_coherence(spark, d):
    tokens = materialise(given.documents_tokens(spark, d).select("lang", "tokens"), "document-tokens")
    per_topic = coherence.topic_coherence(tokens, given.language_topic_words(tokens, fixed.COHERENCE_WORDS))
    return per_topic.select("topic", F.round("coherence", 6).alias("coherence"))


@query("topics_lda")
def topics_lda(spark, d):
    result = topics.model_topics(
        given.documents_tokens(spark, d, in_batches=True), key="doc_id", num_topics=4, with_coherence=False
    )
    return topics.topic_table(result.topics)


@query("topics_lda_coherence")
def topics_lda_coherence(spark, d):
    result = topics.model_topics(given.documents_tokens(spark, d, in_batches=True), key="doc_id", num_topics=4)
    return result.coherence


@query("topics_lda_shape", """SELECT 4::BIGINT AS topics, 20::BIGINT AS words, 0::BIGINT AS out_of_order, 0::BIGINT AS unknown_words
    FROM documents LIMIT 1""")
def topics_lda_shape(spark, d):
    """Every topic has its words in descending weight, all of them from the dictionary."""
    # read by the model and by the check of its words
    tokens = materialise(given.documents_tokens(spark, d, in_batches=True).select("doc_id", "tokens"), "document-tokens")
    result = topics.model_topics(tokens, key="doc_id", num_topics=4, with_coherence=False)
    before = F.lag("weight").over(Window.partitionBy("topic").orderBy("rank"))
    known = cleaning.vocabulary(tokens).select(F.col("token").alias("word"), F.lit(True).alias("known"))
    rows = result.topics.withColumn("before", before).join(known, "word", "left")
    return rows.agg(
        F.count_distinct("topic").alias("topics"), F.count("*").alias("words"),
        F.count_if(F.col("weight") > F.col("before")).alias("out_of_order"), F.count_if(F.col("known").isNull()).alias("unknown_words"),
    )


@query("topic_coherence_total", f"""WITH {sql.DOC_TOKENS}, {sql.language_topics_cte(20)}, {sql.window_counts_cte()}, {_NPMI}
    SELECT round(avg(coherence), 6) AS coherence FROM (SELECT topic, avg(c) AS coherence FROM cosines GROUP BY topic)""")
def topic_coherence_total(spark, d):
    tokens = materialise(given.documents_tokens(spark, d).select("lang", "tokens"), "document-tokens")
    per_topic = coherence.topic_coherence(tokens, given.language_topic_words(tokens, fixed.COHERENCE_WORDS))
    return coherence.total_coherence(per_topic).select(F.round("coherence", 6).alias("coherence"))


@query("topics_lda_cloud")
def topics_lda_cloud(spark, d):
    """Cloud weights of the topic model's own words."""
    result = topics.model_topics(given.documents_tokens(spark, d, in_batches=True), key="doc_id", num_topics=4, num_words=40, with_coherence=False)
    return topics.cloud_weights(result.topics)


# --- comparison -------------------------------------------------------------------


def _pairs(spark, d):
    return given.predicted_labels(spark, d), given.actual_labels(spark, d)


def _pair_counts(spark, d):
    return compare.pair_counts(*_pairs(spark, d))


_HASHED = "ts AS timestamp, who AS username, md5(said) AS message_hash, predicted_label, actual_label"


@query("label_join", f"WITH {sql.MATCHED} SELECT {_HASHED} FROM matched")
def label_join(spark, d):
    pairs = compare.matched_pairs(*_pairs(spark, d))
    return pairs.select("timestamp", "username", F.md5("message_text").alias("message_hash"), "predicted_label", "actual_label")


@query("label_differences", f"WITH {sql.MATCHED} SELECT {_HASHED} FROM matched WHERE {sql.DIFFERS}")
def label_differences(spark, d):
    pairs = compare.differences(compare.matched_pairs(*_pairs(spark, d)))
    return pairs.select("timestamp", "username", F.md5("message_text").alias("message_hash"), "predicted_label", "actual_label")


@query("confusion_counts", f"""WITH {sql.MATCHED} SELECT actual_label, predicted_label, count(*)::BIGINT AS n FROM matched
    WHERE {sql.DIFFERS} AND actual_label IS NOT NULL AND predicted_label IS NOT NULL GROUP BY ALL""")
def confusion_counts(spark, d):
    return compare.confusion_counts(_pair_counts(spark, d))


@query("label_counts", f"""WITH {sql.MATCHED}
    SELECT 'predicted' AS side, predicted_label AS label, count(*)::BIGINT AS n FROM predicted GROUP BY 2
    UNION ALL SELECT 'actual', actual_label, count(*)::BIGINT FROM actual GROUP BY 2
    UNION ALL SELECT 'matched_predicted', predicted_label, count(*)::BIGINT FROM matched GROUP BY 2
    UNION ALL SELECT 'matched_actual', actual_label, count(*)::BIGINT FROM matched GROUP BY 2""")
def label_counts(spark, d):
    predicted, actual = _pairs(spark, d)
    return compare.all_label_counts(predicted, actual, materialise(compare.pair_counts(predicted, actual), "pair-counts"))


@query("overlap_report", f"""WITH {sql.MATCHED}
    SELECT 'predicted_rows' AS measure, count(*)::BIGINT AS n FROM predicted
    UNION ALL SELECT 'actual_rows', count(*)::BIGINT FROM actual
    UNION ALL SELECT 'matched_rows', count(*)::BIGINT FROM matched
    UNION ALL SELECT 'differing_rows', count(*)::BIGINT FROM matched WHERE {sql.DIFFERS}""")
def overlap_report(spark, d):
    predicted, actual = _pairs(spark, d)
    return compare.overlap_report(predicted, actual, compare.pair_counts(predicted, actual))


@query("repeated_keys", f"""WITH {sql.PREDICTED}, keyed AS (SELECT count(*) AS n FROM predicted GROUP BY ts, who, said HAVING count(*) > 1)
    SELECT count(*)::BIGINT AS repeated_keys, coalesce(sum(n), 0)::BIGINT AS rows FROM keyed""")
def repeated_keys(spark, d):
    return compare.duplicate_keys(given.predicted_labels(spark, d))


@query("label_accuracy", f"""WITH {sql.MATCHED}
    SELECT count(*)::BIGINT AS n, round(avg(CASE WHEN predicted_label = actual_label THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy
    FROM matched WHERE predicted_label IS NOT NULL AND actual_label IS NOT NULL""")
def label_accuracy(spark, d):
    return compare.accuracy(_pair_counts(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


# --- retention --------------------------------------------------------------------


def _feed(spark, d):
    return given.events_feed(given.table(spark, d, "events"))


_LAST_N = f"""{sql.FEED},
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts DESC, msg_key DESC) AS r FROM feed)
      WHERE r <= {{n}})"""


@query("last_n_per_channel", f"WITH {_LAST_N.format(n=20)} SELECT channel, msg_key, sentiment FROM kept")
def last_n_per_channel(spark, d):
    return retain.last_n_per(_feed(spark, d), "channel", 20).select("channel", "msg_key", "sentiment")


@query("last_n_summary", f"""WITH {_LAST_N.format(n=fixed.KEEP_STREAM_MESSAGES)}
    SELECT channel, count(*)::BIGINT AS total_messages_stored, round(avg(sentiment_score), 6) AS average_sentiment_score,
      count(*) FILTER (sentiment = 'positive')::BIGINT AS positive_messages,
      count(*) FILTER (sentiment = 'negative')::BIGINT AS negative_messages,
      count(*) FILTER (sentiment = 'neutral')::BIGINT AS neutral_messages,
      string_agg(msg_key::VARCHAR, ',' ORDER BY r DESC) FILTER (r <= 5) AS last_keys
    FROM kept GROUP BY channel""")
def last_n_summary(spark, d):
    kept = retain.last_n_per(_feed(spark, d), "channel")
    return _summary_rows(retain.retained_summary(kept, "channel"))


def _summary_rows(summary: DataFrame) -> DataFrame:
    keys = F.transform("last_messages", lambda m: m["msg_key"].cast("string"))
    return summary.select(
        "channel",
        "total_messages_stored",
        F.round("average_sentiment_score", 6).alias("average_sentiment_score"),
        "positive_messages",
        "negative_messages",
        "neutral_messages",
        F.array_join(keys, ",").alias("last_keys"),
    )


@query("last_rows", f"""WITH {sql.FEED} SELECT msg_key, channel, username FROM feed ORDER BY ts DESC, msg_key DESC LIMIT {fixed.DISPLAY_ROWS}""")
def last_rows(spark, d):
    return retain.last_n(_feed(spark, d)).select("msg_key", "channel", "username")


# --- webhook ----------------------------------------------------------------------


@query("event_admission", f"""WITH {sql.ENVELOPES}
    SELECT msg_key AS turn_key, CASE WHEN conv_id % 4 = 0 THEN 'missing_header:{fixed.H_SIGNATURE}'
        WHEN event_type IS NULL THEN 'event_type:unknown' WHEN event_type <> '{fixed.CHAT_EVENT}' THEN 'event_type:ignore'
        WHEN body_kind <> 'json' THEN 'invalid_json' WHEN role <> 'user' OR text = '' THEN 'empty_content' END AS reason
    FROM classed""")
def event_admission(spark, d):
    return webhook.chat_events(given.conversation_envelopes(spark, d)).select("turn_key", "reason")


@query("accepted_events", f"""WITH {sql.ENVELOPES}
    SELECT msg_key, name AS username, text AS message, {sql.TURN_TIME} AS timestamp FROM classed
    WHERE conv_id % 4 <> 0 AND event_type = '{fixed.CHAT_EVENT}' AND body_kind = 'json' AND role = 'user' AND text <> ''""")
def accepted_events(spark, d):
    events = webhook.accepted(webhook.chat_events(given.conversation_envelopes(spark, d)))
    return events.select("msg_key", "username", "message", "timestamp")


@query("event_routes", f"""WITH {sql.ENVELOPES}
    SELECT CASE WHEN event_type = '{fixed.CHAT_EVENT}' THEN 'process' WHEN event_type IS NOT NULL THEN 'ignore' ELSE 'unknown' END AS route,
      count(*)::BIGINT AS n FROM classed GROUP BY 1""")
def event_routes(spark, d):
    route = webhook.event_route(bodies.header(F.col("headers"), fixed.H_EVENT_TYPE))
    return given.conversation_envelopes(spark, d).groupBy(route.alias("route")).agg(F.count("*").alias("n"))


@query("payload_normalise", f"""WITH {sql.ENVELOPES}
    SELECT msg_key AS turn_key, body_kind, is_test, event_class, sender AS username, said AS message,
      CASE WHEN body_kind = 'json' AND role = 'user' THEN right(msg_key, 6) END AS short_id
    FROM classed WHERE body_kind <> 'invalid' AND said <> ''""")
def payload_normalise(spark, d):
    rows = webhook.normalise_envelopes(given.conversation_envelopes(spark, d)).filter(F.col("reason").isNull())
    given_id = F.when(~F.col("id").startswith("msg_"), text.short_id(F.col("id")))
    return rows.select("turn_key", "body_kind", "is_test", "event_class", "username", "message", given_id.alias("short_id"))


@query("payload_rejects", f"""WITH {sql.ENVELOPES}
    SELECT CASE WHEN body_kind = 'invalid' THEN 'invalid_body' ELSE 'no_message_or_sender' END AS reason, count(*)::BIGINT AS n,
      max(length(CASE WHEN body_kind = 'invalid' THEN left('{{"content": ' || text, {fixed.SNIPPET_LENGTH}) END))::BIGINT AS longest_head
    FROM classed WHERE body_kind = 'invalid' OR said = '' GROUP BY 1""")
def payload_rejects(spark, d):
    rows = webhook.normalise_envelopes(given.conversation_envelopes(spark, d)).filter(F.col("reason").isNotNull())
    head = F.when(F.col("reason") == "invalid_body", F.length("body_head"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.max(head).cast("bigint").alias("longest_head"))


_COUNTERS = f"""WITH {sql.ENVELOPES}
    SELECT count(*)::BIGINT AS total_requests, count(*) FILTER (event_class = 'kick')::BIGINT AS kick_events,
      count(*) FILTER (event_class = 'test')::BIGINT AS test_events, count(*) FILTER (event_class = 'unknown')::BIGINT AS unknown_events,
      strftime(max(received_at), '%Y-%m-%d %H:%M:%S') AS last_request_time FROM classed"""


@query("webhook_counters", _COUNTERS)
def webhook_counters(spark, d):
    counters = webhook.webhook_counters(webhook.normalise_envelopes(given.conversation_envelopes(spark, d)))
    return counters.withColumn("last_request_time", F.date_format("last_request_time", given.TEXT_TIME))


@query("stored_counts", f"""WITH {sql.ENVELOPES}
    SELECT count(*)::BIGINT AS total, count(*) FILTER (is_test)::BIGINT AS test, count(*) FILTER (NOT is_test)::BIGINT AS real
    FROM classed WHERE body_kind <> 'invalid' AND said <> ''""")
def stored_counts(spark, d):
    return webhook.stored_counts(webhook.stored_messages(webhook.normalise_envelopes(given.conversation_envelopes(spark, d))))


@query("real_messages", f"""WITH {sql.ENVELOPES}
    SELECT sender AS username, said AS message FROM classed WHERE body_kind <> 'invalid' AND said <> '' AND NOT is_test""")
def real_messages(spark, d):
    stored = webhook.stored_messages(webhook.normalise_envelopes(given.conversation_envelopes(spark, d)))
    return webhook.retrieval_filter(stored, real_only=True).select("username", "message")


@query("test_flag", """SELECT doc_id, contains(lower(text), 'test') OR contains(lower(text), 'debug_broadcaster') AS is_test FROM documents""")
def test_flag(spark, d):
    docs = given.documents_chat(spark, d)
    body = F.to_json(F.struct(F.struct(F.col("message").alias("text")).alias("data"), "doc_id"))
    fields = docs.select("doc_id", bodies.json_members(body).alias("fields"))
    facts = fields.withColumn("facts", bodies.value_facts(F.col("fields")))
    return facts.select("doc_id", bodies.is_test_body(F.col("fields"), F.col("facts")).alias("is_test"))


@query("form_body_parse", """WITH q AS (SELECT page_id, split_part(url, '?', 2) AS body FROM pages WHERE contains(url, '?')),
    items AS (SELECT page_id, string_split(body, '&') AS xs FROM q),
    valid AS (SELECT * FROM items WHERE len(list_filter(xs, lambda x: length(x) - length(replace(x, '=', '')) <> 1)) = 0),
    flat AS (SELECT page_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM valid)
    SELECT page_id, split_part(x, '=', 1) AS name, arg_max(split_part(x, '=', 2), i) AS value FROM flat GROUP BY 1, 2""")
def form_body_parse(spark, d):
    urls = given.table(spark, d, "pages").filter(F.contains("url", F.lit("?")))
    body = F.split_part(F.col("url"), F.lit("?"), F.lit(2))
    items = urls.select("page_id", F.inline_outer(bodies.form_items(body)))
    return items.filter(F.col("name").isNotNull())


# --- bot, typed events, log sink --------------------------------------------------


@query("bot_messages", f"""WITH {sql.TURNS}
    SELECT {sql.TURN_TIME} AS timestamp, CASE WHEN turn % 3 = 0 THEN '{fixed.UNKNOWN_SENDER}' ELSE role END AS username,
      CASE WHEN conv_id % 9 = 0 THEN NULL ELSE channel END AS channel,
      CASE WHEN conv_id % 9 = 0 THEN 'missing_field:channel' END AS reason
    FROM turns WHERE role <> 'system'""")
def bot_messages(spark, d):
    return webhook.bot_messages(_bot_rows(spark, d)).select("timestamp", "username", "channel", "reason")


def _bot_rows(spark, d):
    chat = given.conversations_chat(spark, d).withColumns(
        {"_conv": F.split_part("msg_key", F.lit("-"), F.lit(1)).cast("bigint"), "_turn": F.split_part("msg_key", F.lit("-"), F.lit(2)).cast("bigint")}
    )
    return chat.select(
        "timestamp",
        F.when(F.col("_turn") % 3 != 0, F.col("username")).alias("username"),
        "message",
        F.when(F.col("_conv") % 9 != 0, F.col("channel")).alias("channel"),
        (F.col("username") == "system").alias("echo"),
    )


@query("typed_event_routes", f"""SELECT CASE event_type WHEN 'view' THEN 'message' WHEN 'click' THEN 'status' WHEN 'error' THEN 'error'
        WHEN 'signup' THEN 'warning' ELSE 'other' END AS route,
      event_type = 'error' AND contains('failed to get page source ' || props, '404') AS is_404, count(*)::BIGINT AS n,
      (count(*) FILTER (event_type = 'error'))::BIGINT AS n_critical FROM events GROUP BY 1, 2""")
def typed_event_routes(spark, d):
    return _route_counts(capture.route_events(_typed_events(spark, d)))


def _typed_events(spark, d):
    kind = F.col("event_type")
    return given.table(spark, d, "events").select(
        F.when(kind == "view", "message").when(kind == "click", "status").when(kind == "error", "error")
        .when(kind == "signup", "warning").otherwise("purchase").alias("type"),
        F.concat(F.lit("Failed to get page source "), "props").alias("data"),
    )


def _route_counts(routed):
    is_404 = (F.col("route") == "error") & F.contains("data", F.lit("404"))
    return routed.groupBy("route", is_404.alias("is_404")).agg(F.count("*").alias("n"), F.count_if("is_critical").alias("n_critical"))


@query("log_rows", f"""WITH {sql.TURNS}
    SELECT {sql.TURN_TIME} AS timestamp, '' AS username, text AS message, 'room_' || (conv_id % 7) AS channel FROM turns""")
def log_rows(spark, d):
    chat = given.conversations_chat(spark, d).withColumnRenamed("message", "content").drop("username")
    return sinks.log_rows(chat)[0]


@query("log_names", f"""WITH {sql.TURNS}
    SELECT '{fixed.LOG_NAME_PREFIX}-room_' || (conv_id % 7) || '-' || strftime(date_trunc('hour', epoch_ms(sec * 1000)), '%Y%m%d-%H%M%S') AS name,
      count(*)::BIGINT AS n FROM turns GROUP BY 1""")
def log_names(spark, d):
    chat = given.conversations_chat(spark, d)
    hour = F.date_trunc("hour", text.parse_time(F.col("timestamp")))
    return chat.groupBy(text.log_name(F.col("channel"), hour).alias("name")).agg(F.count("*").alias("n"))


@query("safe_names", r"""SELECT page_id, CASE WHEN url = '' THEN 'unknown_kick_channel' ELSE regexp_replace(url, '[^\p{L}\p{N}]', '_', 'g') END AS name,
      right(url, 6) AS short_id FROM pages""")
def safe_names(spark, d):
    url = F.col("url")
    return given.table(spark, d, "pages").select("page_id", text.safe_name(url).alias("name"), text.short_id(url).alias("short_id"))


# --- captured pages ---------------------------------------------------------------

# The given pages hold other marks than the chat page: links and paragraphs stand for entries.
LINK_MARKS = EntryMarks(entry='<a href="', content='">', content_end="</a>", user_id='class="', name_end="</h1>", breaker="/the")
PARAGRAPH_MARKS = EntryMarks(entry="<p>", content="<b>", content_end="<br>", user_id="&middot; ", name_end="</p>", breaker="</footer>")


def _entries_sql(m: EntryMarks) -> str:
    q = sql.quote
    tags = lambda x: f"replace(regexp_replace({x}, '<[^>]*(>|\\z)', '', 'g'), '>', '')"
    first = lambda x, mark: f"split_part({x}, {q(mark)}, 1)"
    after = lambda x, mark: f"split_part({x}, {q(mark)}, 2)"
    return f"""
    readable AS (
      SELECT page_id, string_split(html, {q(m.entry)}) AS parts FROM pages
      WHERE NOT contains(html, {q(fixed.ERROR_PAGE_TEXT)}) AND NOT contains(html, {q(fixed.SECURITY_PAGE_TEXT)})
        AND contains(html, {q(m.entry)})),
    entries AS (
      SELECT page_id, unnest(parts[2:]) AS entry, generate_subscripts(parts[2:], 1) - 1 AS entry_pos FROM readable),
    kept AS (
      SELECT *, CASE WHEN contains(entry, {q(m.user_id)}) THEN {first(after('entry', m.user_id), '"')} ELSE '{fixed.NO_USER_ID}' END AS user_id
      FROM entries WHERE NOT contains(entry, {q(m.breaker)})),
    chat AS (
      SELECT page_id, entry_pos, {first('entry', '"')} AS msg_id, user_id,
        CASE WHEN contains(entry, {q(m.content)}) THEN {sql.strip(tags(first(after('entry', m.content), m.content_end)))} ELSE '' END AS content,
        '{fixed.NO_USER_NAME}' AS username
      FROM kept)"""


@query("link_entries", f"WITH {_entries_sql(LINK_MARKS)} SELECT page_id, entry_pos::BIGINT AS entry_pos, msg_id, user_id, content, username FROM chat")
def link_entries(spark, d):
    entries = capture.newest_first(capture.page_entries(given.table(spark, d, "pages"), marks=LINK_MARKS))
    return entries.select("page_id", F.col("entry_pos").cast("bigint").alias("entry_pos"), "msg_id", "user_id", "content", "username")


@query("paragraph_entries", f"WITH {_entries_sql(PARAGRAPH_MARKS)} SELECT page_id, entry_pos::BIGINT AS entry_pos, md5(msg_id) AS msg_hash, user_id, content FROM chat")
def paragraph_entries(spark, d):
    return _paragraph_rows(capture.page_entries(live_sources.read_pages(spark, f"{d}/pages.parquet"), marks=PARAGRAPH_MARKS))


def _paragraph_rows(entries: DataFrame) -> DataFrame:
    return entries.select("page_id", F.col("entry_pos").cast("bigint").alias("entry_pos"), F.md5("msg_id").alias("msg_hash"), "user_id", "content")


@query("stream_pages", CATALOG["paragraph_entries"].sql)
def stream_pages(spark, d):
    """Captured pages as a stream: the entries of each page as it lands."""
    out = scratch_dir(spark, "pages")
    # The bracket makes the path a pattern, so one file and a folder of files both work.
    pages = live_sources.page_stream(spark, f"{d}/pages.parque[t]")
    live.start_append(_paragraph_rows(capture.page_entries(pages, marks=PARAGRAPH_MARKS)), out, scratch_dir(spark, "pages-checkpoint")).awaitTermination()
    return spark.read.parquet(out)


@query("captured_once", f"""WITH {_entries_sql(LINK_MARKS)}
    SELECT msg_id, page_id, entry_pos::BIGINT AS entry_pos, content FROM (
      SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY page_id, entry_pos) AS r FROM chat) WHERE r = 1""")
def captured_once(spark, d):
    entries = capture.page_entries(given.table(spark, d, "pages"), marks=LINK_MARKS)
    once = dedupe.first_per_id(entries, "msg_id", ("page_id", "entry_pos"))
    return once.select("msg_id", "page_id", F.col("entry_pos").cast("bigint").alias("entry_pos"), "content")


@query("tag_strip", r"""SELECT page_id, replace(regexp_replace(html, '<[^>]*(>|\z)', '', 'g'), '>', '') AS plain FROM pages""")
def tag_strip(spark, d):
    return given.table(spark, d, "pages").select("page_id", captured.strip_tags(F.col("html")).alias("plain"))


@query("page_state", f"""SELECT CASE WHEN contains(html, {sql.quote(fixed.ERROR_PAGE_TEXT)}) THEN 'error'
      WHEN contains(html, {sql.quote(fixed.SECURITY_PAGE_TEXT)}) THEN 'security_check' WHEN contains(html, '<a href="/the') THEN 'entries'
      ELSE 'no_entries' END AS page_state, count(*)::BIGINT AS n FROM pages GROUP BY 1""")
def page_state(spark, d):
    states = capture.page_states(given.table(spark, d, "pages"), marks=EntryMarks(entry='<a href="/the'))
    return states.groupBy("page_state").agg(F.count("*").alias("n"))


# --- dedupe and monitor -----------------------------------------------------------


@query("dedupe_text", """SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY text""")
def dedupe_text(spark, d):
    return dedupe.first_ids_of_text(given.documents_chat(spark, d), key="doc_id")


@query("dedupe_rows", """SELECT doc_id, source AS username, lang, md5(text) AS message_hash FROM (
      SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def dedupe_rows(spark, d):
    docs = given.documents_chat(spark, d).withColumn("msg_id", F.sha2("message", 256))
    once = dedupe.first_per_id(docs, "msg_id", ("doc_id",))
    return once.select("doc_id", "username", "lang", F.md5("message").alias("message_hash"))


_NEW = """WITH d AS (SELECT doc_id, sha256(text) AS msg_id, source, contains(lower(text), 'test') AS is_test FROM documents),
    seen AS (SELECT DISTINCT msg_id FROM d WHERE source IN ('src1', 'src2', 'src3')),
    fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY doc_id) AS r FROM d
      WHERE msg_id NOT IN (SELECT msg_id FROM seen)) WHERE r = 1)"""


def _new(spark, d):
    docs = given.documents_chat(spark, d).select(
        "doc_id", F.sha2("message", 256).alias("msg_id"), "username",
        bodies.mentions(F.col("message"), fixed.TEST_INDICATORS).alias("is_test"),
    )
    baseline = docs.filter(F.col("username").isin("src1", "src2", "src3"))
    return dedupe.new_messages(docs, baseline, order=("doc_id",))


@query("new_messages", f"{_NEW} SELECT msg_id, doc_id, source AS username FROM fresh")
def new_messages(spark, d):
    return _new(spark, d).select("msg_id", "doc_id", "username")


@query("monitor_counters", f"""{_NEW}, c AS ({_COUNTERS})
    SELECT 1::BIGINT AS total_checks, count(*)::BIGINT AS new_messages, count(*) FILTER (NOT is_test)::BIGINT AS real_messages,
      count(*) FILTER (is_test)::BIGINT AS test_messages, (SELECT kick_events FROM c) AS kick_events,
      (SELECT kick_events - 10 FROM c) AS kick_event_increase FROM fresh""")
def monitor_counters(spark, d):
    counters = webhook.webhook_counters(webhook.normalise_envelopes(given.conversation_envelopes(spark, d)))
    return dedupe.monitor_counters(_new(spark, d), 1, counters, before=10)


@query("exact_lookup", """SELECT item_id, EXISTS (SELECT 1 FROM documents d WHERE d.text = b.text) AS received
    FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT -doc_id - 1, text FROM documents) b""")
def exact_lookup(spark, d):
    docs = given.documents_chat(spark, d)
    asked = given.table(spark, d, "benchmark").select("item_id", F.col("text").alias("message")).unionByName(
        docs.select((-F.col("doc_id") - 1).alias("item_id"), "message")
    )
    return dedupe.exact_lookup(docs, asked, keep=("item_id",))


@query("received_messages", """SELECT d.doc_id FROM documents d WHERE d.text IN (
      SELECT text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""")
def received_messages(spark, d):
    wanted = given.labelled_documents(spark, d).filter(F.col("label") == "negative").select(F.col("text").alias("message"))
    return dedupe.received_messages(given.documents_chat(spark, d), wanted).select("doc_id")


# --- training ---------------------------------------------------------------------


@query("label_encode", """SELECT source AS label, dense_rank() OVER (ORDER BY source) - 1.0::DOUBLE AS label_id, count(*)::BIGINT AS n
    FROM documents GROUP BY source""")
def label_encode(spark, d):
    encoded, _ = training.encode_labels(given.documents_chat(spark, d).withColumnRenamed("username", "label"))
    return training.class_counts(encoded)


_IS_TEST = "('0x' || substr(md5(text), 1, 7))::BIGINT % 100 < 20"


@query("split_sizes", f"""SELECT count(*)::BIGINT AS total, count(*) FILTER (NOT {_IS_TEST})::BIGINT AS train,
      count(*) FILTER ({_IS_TEST})::BIGINT AS test FROM documents""")
def split_sizes(spark, d):
    return training.split_sizes(given.documents_chat(spark, d), "message")


@query("labelled_union", f"""SELECT label, count(*)::BIGINT AS n FROM (
      SELECT text, {sql.TRUTH} AS label FROM documents JOIN labels USING (doc_id)
      UNION ALL SELECT text, role FROM conversations) GROUP BY label""")
def labelled_union(spark, d):
    parts = [
        given.labelled_documents(spark, d).select("text", "label"),
        given.table(spark, d, "conversations").select("text", F.col("role").alias("label")),
    ]
    return union_labelled(parts).groupBy("label").agg(F.count("*").alias("n"))


@query("classifier_eval")
def classifier_eval(spark, d):
    trained = epochs.train_epochs(given.labelled_documents(spark, d))
    return training.evaluate_predictions(trained.test_predictions)


@query("classifier_epochs")
def classifier_epochs(spark, d):
    """Learning rate, loss and held-out accuracy of every epoch, and which one is kept."""
    return epochs.epoch_table(spark, epochs.train_epochs(given.labelled_documents(spark, d)))


@query("model_labels")
def model_labels(spark, d):
    trained = epochs.train_epochs(given.labelled_documents(spark, d))
    scored = sentiment.run_sentiment(given.documents_chat(spark, d), "custom_kick_bert", model=trained.model)
    return scored.groupBy("sentiment").agg(F.count("*").alias("n"))


@query("two_class_labels")
def two_class_labels(spark, d):
    """Labels of all documents by the two-class model, saved and loaded."""
    fitted = epochs.train_two_class(given.labelled_documents(spark, d))
    path = scratch_dir(spark, "two-class")
    training.save_model(fitted.model, path)
    scored = sentiment.run_sentiment(given.documents_chat(spark, d), "bert", model=training.load_model(path))
    return scored.groupBy("sentiment").agg(F.count("*").alias("n"))


@query("two_class_calibration")
def two_class_calibration(spark, d):
    """How often the model's class is right for what it says, on rows that neither trained nor calibrated it."""
    return epochs.calibration_table(epochs.train_two_class(given.labelled_documents(spark, d)).test)


@query("classifier_candidates")
def classifier_candidates(spark, d):
    return training.candidate_table(spark, training.fit_classifier(given.labelled_documents(spark, d)))


@query("classifier_test_rows", f"""SELECT {sql.TRUTH} AS label, count(*)::BIGINT AS n FROM documents JOIN labels USING (doc_id)
    WHERE {_IS_TEST} GROUP BY 1""")
def classifier_test_rows(spark, d):
    """The rows of the held-out confusion per true label, through the saved and loaded model."""
    trained = epochs.train_epochs(given.labelled_documents(spark, d))
    path = scratch_dir(spark, "classifier")
    training.save_model(trained.model, path)
    _, test = training.split_examples(given.labelled_documents(spark, d))
    scored = training.load_model(path).transform(test).select("label", "predicted_name")
    table = training.held_out_confusion(scored)
    return table.filter(F.col("predicted").isin(*fixed.LABELS)).groupBy("label").agg(F.sum("n").alias("n"))


@query("model_label_sides", f"""SELECT CASE WHEN {sql.strip("text")} = '' THEN 'blank' ELSE 'text' END AS side, count(*)::BIGINT AS n
    FROM documents GROUP BY 1""")
def model_label_sides(spark, d):
    """Blank texts are `unknown`, all others get one of the three names."""
    trained = epochs.train_epochs(given.labelled_documents(spark, d))
    scored = sentiment.run_sentiment(given.documents_chat(spark, d), "custom_kick_bert", model=trained.model)
    return scored.groupBy(F.when(F.col("sentiment") == "unknown", "blank").otherwise("text").alias("side")).agg(F.count("*").alias("n"))


# --- streams ----------------------------------------------------------------------

BATCHES = 3
# Queries that drain a capped folder side by side.
CAPPED_SHARES = 8


def _in_batches(rows: DataFrame, name: str, start) -> None:
    """The rows land in three lots, dealt by a hash so that each holds early and late rows, and the job runs after each.

    A lot is written by the table's own parts; the job goes on from its checkpoint every time. `start` gets the stream.
    """
    spark, folder = rows.sparkSession, scratch_dir(rows.sparkSession, f"{name}-landing")
    lot = F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if not kind.startswith("map")]), F.lit(BATCHES))
    for i in range(BATCHES):
        rows.where(lot == i).write.mode("append").parquet(folder)
        start(live_sources.landing_stream(spark, folder, rows.schema, "parquet", max_files=1_000_000)).awaitTermination()


def _event_stream(spark, d):
    # The bracket makes the path a pattern, so one file and a folder of files both work.
    path = f"{d}/events.parque[t]"
    return live_sources.landing_stream(spark, path, given.table(spark, d, "events").schema, "parquet")


@query("stream_retained", f"WITH {_LAST_N.format(n=20)} SELECT channel, msg_key, sentiment FROM kept")
def stream_retained(spark, d):
    out, checkpoint = scratch_dir(spark, "retained"), scratch_dir(spark, "retained-checkpoint")
    live.start_retained(given.events_feed(_event_stream(spark, d)), out, checkpoint, n=20).awaitTermination()
    return read_retained(spark, out, "channel", 20).select("channel", "msg_key", "sentiment")


@query("stream_buffers", f"WITH {_LAST_N.format(n=20)} SELECT channel, msg_key, sentiment FROM kept")
def stream_buffers(spark, d):
    """The same rows as keyed state of the stream, over three batches and two restarts."""
    out, checkpoint = scratch_dir(spark, "buffers"), scratch_dir(spark, "buffers-checkpoint")
    feed = given.events_feed(given.table(spark, d, "events"))
    _in_batches(feed, "buffers", lambda stream: state.start_buffers(stream, out, checkpoint, n=20))
    return state.read_buffers(spark, out).select("channel", "msg_key", "sentiment")


@query("stream_summary", CATALOG["last_n_summary"].sql)
def stream_summary(spark, d):
    out, checkpoint = scratch_dir(spark, "summary"), scratch_dir(spark, "summary-checkpoint")
    live.start_retained(given.events_feed(_event_stream(spark, d)), out, checkpoint).awaitTermination()
    return _summary_rows(live.rolling_summary(spark, out))


@query("stream_dedupe", "SELECT DISTINCT event_id FROM events")
def stream_dedupe(spark, d):
    """Every event twice, hours apart and out of order, over several files and batches."""
    out, checkpoint = scratch_dir(spark, "once"), scratch_dir(spark, "once-checkpoint")
    events = given.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    twice = events.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "ts", F.col("ts") - F.make_dt_interval(hours=F.col("copy") * 5)
    )
    _in_batches(twice, "once", lambda stream: live.start_once(stream, out, checkpoint, "event_id"))
    return live.read_batches(spark, out).select("event_id")


@query("stream_trend", _event_trend_sql("hour"))
def stream_trend(spark, d):
    """Events in shuffled batches: most of them come after their period has been closed."""
    out, checkpoint = scratch_dir(spark, "trend"), scratch_dir(spark, "trend-checkpoint")
    events = given.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")
    _in_batches(events, "trend", lambda stream: start_trend(stream, out, checkpoint, label="event_type", period="hour", delay="2 hours"))
    rows = TrendTable(spark, out, "hour").counts()
    table = rows.groupBy("period").pivot("label", list(EVENT_TYPES)).agg(F.sum("n")).na.fill(0)
    return table.withColumn("period", F.date_format("period", given.TEXT_TIME))


@query("stream_scored", f"""WITH {sql.ENVELOPES}, said_turns AS (SELECT msg_key, text FROM turns),
    valued AS ({sql.valence_sql("said_turns", "msg_key", "text")})
    SELECT msg_key, reason IS NULL AS accepted, CASE WHEN reason IS NULL THEN sentiment END AS sentiment,
      CASE WHEN reason IS NULL THEN sentiment_score END AS sentiment_score FROM (
        SELECT msg_key, CASE WHEN conv_id % 4 = 0 THEN 'header' WHEN event_type IS NULL OR event_type <> '{fixed.CHAT_EVENT}' THEN 'type'
          WHEN body_kind <> 'json' THEN 'json' WHEN role <> 'user' OR text = '' THEN 'empty' END AS reason FROM classed)
    JOIN valued USING (msg_key)""")
def stream_scored(spark, d):
    out, checkpoint = scratch_dir(spark, "scored"), scratch_dir(spark, "scored-checkpoint")
    score = lambda batch: live.score_events(batch, given.SAMPLE_VALENCE, given.SAMPLE_RULES)
    _in_batches(given.conversation_envelopes(spark, d), "scored", lambda stream: live.start_scored(stream, score, out, checkpoint))
    rows = spark.read.parquet(out)
    accepted = F.col("outcome") == "scored"
    return rows.select(
        F.col("turn_key").alias("msg_key"), accepted.alias("accepted"), F.when(accepted, F.col("sentiment")).alias("sentiment"),
        F.when(accepted, F.col("sentiment_score")).alias("sentiment_score"),
    )


@query("stream_bot", f"""WITH {sql.TURNS}, valued AS ({sql.valence_sql("turns", "msg_key", "text")})
    SELECT {sql.TURN_TIME} AS timestamp, CASE WHEN turn % 3 = 0 THEN '{fixed.UNKNOWN_SENDER}' ELSE role END AS username,
      CASE WHEN conv_id % 9 <> 0 THEN channel END AS channel, conv_id % 9 <> 0 AS accepted, sentiment, sentiment_score
    FROM turns JOIN valued USING (msg_key) WHERE role <> 'system'""")
def stream_bot(spark, d):
    out, checkpoint = scratch_dir(spark, "bot"), scratch_dir(spark, "bot-checkpoint")
    score = lambda batch: live.score_bot_messages(batch, given.SAMPLE_VALENCE, given.SAMPLE_RULES)
    _in_batches(_bot_rows(spark, d), "bot", lambda stream: live.start_scored(stream, score, out, checkpoint))
    rows = spark.read.parquet(out)
    return rows.select("timestamp", "username", "channel", (F.col("outcome") == "scored").alias("accepted"), "sentiment", "sentiment_score")


@query("stream_counters", _COUNTERS)
def stream_counters(spark, d):
    out, checkpoint = scratch_dir(spark, "counters"), scratch_dir(spark, "counters-checkpoint")
    _in_batches(given.conversation_envelopes(spark, d), "counters", lambda stream: live.start_counters(stream, out, checkpoint))
    return live.latest_counters(spark, out).withColumn("last_request_time", F.date_format("last_request_time", given.TEXT_TIME))


@query("stream_counter_increases", f"""WITH {sql.ENVELOPES}
    SELECT {BATCHES}::BIGINT AS checks, count(*) FILTER (event_class = 'kick')::BIGINT AS kick_events FROM classed""")
def stream_counter_increases(spark, d):
    out, checkpoint = scratch_dir(spark, "increases"), scratch_dir(spark, "increases-checkpoint")
    _in_batches(given.conversation_envelopes(spark, d), "increases", lambda stream: live.start_counters(stream, out, checkpoint))
    return live.counters_increase(spark, out).agg(F.count("*").alias("checks"), F.sum("increase").alias("kick_events"))


@query("stream_routes", CATALOG["typed_event_routes"].sql)
def stream_routes(spark, d):
    out, checkpoint = scratch_dir(spark, "routes"), scratch_dir(spark, "routes-checkpoint")
    _in_batches(_typed_events(spark, d), "routes", lambda stream: live.start_routed(stream, out, checkpoint))
    return _route_counts(spark.read.parquet(out))


@query("stream_monitor", """WITH d AS (SELECT sha256(text) AS msg_id, bool_or(contains(lower(text), 'test')) AS is_test FROM documents GROUP BY 1)
    SELECT 3::BIGINT AS checks, count(*)::BIGINT AS new_messages, count(*) FILTER (NOT is_test)::BIGINT AS real_messages,
      count(*) FILTER (is_test)::BIGINT AS test_messages FROM d""")
def stream_monitor(spark, d):
    rows = given.documents_chat(spark, d).select(
        F.sha2("message", 256).alias("msg_id"), F.col("doc_id").alias("ts"),
        bodies.mentions(F.col("message"), fixed.TEST_INDICATORS).alias("is_test"),
    )
    out, checkpoint = scratch_dir(spark, "monitor"), scratch_dir(spark, "monitor-checkpoint")
    _in_batches(rows, "monitor", lambda stream: live.start_monitor(stream, out, checkpoint))
    checks = live.read_batches(spark, f"{out}/checks")
    return checks.agg(
        F.max("total_checks").alias("checks"), F.sum("new_messages").alias("new_messages"), F.sum("real_messages").alias("real_messages"),
        F.sum("test_messages").alias("test_messages"),
    )


@query("stream_capped", f"""SELECT count(*)::BIGINT AS n_rows, count(DISTINCT conv_id * 100000 + turn)::BIGINT AS n_messages, 0::BIGINT AS batches_over_cap,
      ceil(count(*) / {fixed.ITEMS_PER_CYCLE})::BIGINT AS batches FROM conversations""")
def stream_capped(spark, d):
    """All turns from files of any size, at most a hundred a cycle; the cycles run in shares side by side."""
    turns = given.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    landing, out, checkpoint = (scratch_dir(spark, f"capped-{x}") for x in ("landing", "out", "checkpoint"))
    turns.write.json(landing)
    streams = [capped_stream(spark, landing, turns.schema, share=i, shares=CAPPED_SHARES) for i in range(CAPPED_SHARES)]
    live.drain_shares(streams, out, checkpoint)
    rows = live.read_shares(spark, out, CAPPED_SHARES)
    sizes = rows.groupBy("share", "batch").agg(F.count("*").alias("n"))
    counted = sizes.agg(F.count_if(F.col("n") > fixed.ITEMS_PER_CYCLE).alias("batches_over_cap"), F.count("*").alias("batches"))
    whole = rows.agg(F.count("*").alias("n_rows"), F.count_distinct("conv_id", "turn").alias("n_messages"))
    return whole.withColumn("_one", F.lit(1)).join(counted.withColumn("_one", F.lit(1)), "_one").drop("_one")


@query("stream_measured", f"""WITH {sql.ENVELOPES}
    SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (conv_id % 4 = 0 OR event_type IS NULL OR event_type <> '{fixed.CHAT_EVENT}'
      OR body_kind <> 'json' OR role <> 'user' OR text = '')::BIGINT AS rejected FROM classed""")
def stream_measured(spark, d):
    """Events and rejected events, counted while the stream runs."""
    out, checkpoint, name = scratch_dir(spark, "measured"), scratch_dir(spark, "measured-checkpoint"), "events"
    watcher = measured.watch(spark, name)

    def start(stream: DataFrame):
        scored = live.score_events(stream, given.SAMPLE_VALENCE, given.SAMPLE_RULES)
        return live.start_append(measured.measured(scored, name), out, checkpoint)

    try:
        _in_batches(given.conversation_envelopes(spark, d), "measured", start)
        totals = watcher.settled_totals(BATCHES)
    finally:
        spark.streams.removeListener(watcher)
    return spark.createDataFrame([(totals["n_rows"], totals["rejected"])], "n_rows bigint, rejected bigint")


@query("unread_times", f"""WITH {sql.TURNS}
    SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (conv_id % 11 = 0)::BIGINT AS unread_times FROM turns""")
def unread_times(spark, d):
    """Times of a chat log that can't be read, beside those that can."""
    conversation = F.split("msg_key", "-")[0].cast("bigint")
    time = F.when(conversation % 11 == 0, "soon").otherwise(F.col("timestamp"))
    chat = given.conversations_chat(spark, d).select(time.alias("timestamp"), F.col("msg_key").alias("msg_id"), "message")
    return chat_csv.unread_times(chat_csv.read_chat_log(spark, _csv(chat, scratch_dir(spark, "unread-csv")), multi_line=True))


@query("received_stamps", """SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (conv_id % 2 = 0)::BIGINT AS kept_stamps,
    count(*) FILTER (conv_id % 2 <> 0)::BIGINT AS new_stamps FROM conversations""")
def received_stamps(spark, d):
    """Events without a time of receipt are stamped when they are read."""
    turns = given.table(spark, d, "conversations").select("turn", F.when(F.col("conv_id") % 2 == 0, F.timestamp_seconds("turn")).alias("received_at"))
    ago = F.current_timestamp() - F.col("received_at")
    return live_sources.stamped(turns).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("received_at") == F.timestamp_seconds("turn")).alias("kept_stamps"),
        F.count_if(ago < F.make_dt_interval(days=F.lit(1))).alias("new_stamps"),
    )


# --- retention of stored messages and raw events ----------------------------------


@query("stored_retained", f"""WITH {sql.ENVELOPES}
    SELECT msg_key AS turn_key, sender AS username FROM classed WHERE body_kind <> 'invalid' AND said <> ''
    ORDER BY received_at DESC, msg_key DESC LIMIT {fixed.KEEP_WEBHOOK_MESSAGES}""")
def stored_retained(spark, d):
    rows = webhook.normalise_envelopes(given.conversation_envelopes(spark, d)).filter(F.col("reason").isNull())
    return retain.stored_messages_kept(rows, ("received_at", "turn_key")).select("turn_key", "username")


@query("raw_events_retained", f"""WITH {sql.ENVELOPES}
    SELECT msg_key AS turn_key FROM classed ORDER BY received_at DESC, msg_key DESC LIMIT {fixed.KEEP_RAW_EVENTS}""")
def raw_events_retained(spark, d):
    return retain.raw_events_kept(given.conversation_envelopes(spark, d), ("received_at", "turn_key")).select("turn_key")


# --- file round trips -------------------------------------------------------------


def _csv(rows: DataFrame, folder: str) -> str:
    rows.write.option("header", True).option("escape", '"').csv(folder)
    return folder


@query("chat_csv_round_trip", f"""WITH {sql.TURNS}
    SELECT msg_key, {sql.TURN_TIME} AS ts, md5(text) AS message_hash FROM turns""")
def chat_csv_round_trip(spark, d):
    """Written with `content` in place of `message`; read by the schema rule."""
    chat = given.conversations_chat(spark, d).select("timestamp", F.col("msg_key").alias("msg_id"), F.col("message").alias("content"))
    back = chat_csv.read_chat_log(spark, _csv(chat, scratch_dir(spark, "chat-csv")), multi_line=True)
    return back.select("msg_key", F.date_format("ts", given.TEXT_TIME).alias("ts"), F.md5("message").alias("message_hash"))


@query("chat_log_round_trip", f"""WITH {sql.TURNS}
    SELECT {sql.TURN_TIME} AS timestamp, 'room_' || (conv_id % 7) AS channel, md5(text) AS message_hash FROM turns""")
def chat_log_round_trip(spark, d):
    out = scratch_dir(spark, "chat-log")
    sinks.write_chat_log(given.conversations_chat(spark, d), out)
    back = chat_csv.read_csv(spark, out, multi_line=True)
    return back.select("timestamp", "channel", F.md5("message").alias("message_hash"))


@query("labelled_folder", CATALOG["labelled_union"].sql)
def labelled_folder(spark, d):
    """Files of two shapes in one folder."""
    base = scratch_dir(spark, "labelled")
    for rows in (
        given.labelled_documents(spark, d).select(F.col("text").alias("content"), "label"),
        given.table(spark, d, "conversations").select(F.col("text").alias("message"), F.col("role").alias("label")),
    ):
        rows.write.mode("append").option("header", True).option("escape", '"').csv(base)
    return chat_csv.read_labelled(spark, base, multi_line=True).groupBy("label").agg(F.count("*").alias("n"))


@query("comparison_files", CATALOG["overlap_report"].sql)
def comparison_files(spark, d):
    """Predictions and truth written as the exports have them, read by the loaders, compared."""
    predicted, actual = _pairs(spark, d)
    left = predicted.select("timestamp", "username", F.col("message_text").alias("message"), F.col("predicted_label").alias("sentiment"))
    right = actual.select("username", F.col("message_text").alias("content"), "timestamp", F.col("actual_label").alias("label"))
    predicted = chat_csv.load_predicted(spark, _csv(left, scratch_dir(spark, "predicted")), multi_line=True)
    actual = chat_csv.load_actual(spark, _csv(right, scratch_dir(spark, "actual")), multi_line=True)
    return compare.overlap_report(predicted, actual, compare.pair_counts(predicted, actual))


@query("audit_round_trip", f"""WITH {sql.ENVELOPES} SELECT msg_key AS turn_key, strftime(received_at, '%Y-%m-%d') AS day FROM classed""")
def audit_round_trip(spark, d):
    out = scratch_dir(spark, "audit")
    sinks.append_audit(given.conversation_envelopes(spark, d), out)
    return spark.read.parquet(out).select("turn_key", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("cleared_store", "SELECT 0::BIGINT AS rows, 1::BIGINT AS rows_after_append FROM events LIMIT 1")
def cleared_store(spark, d):
    """A partitioned table, cleared, keeps its columns and takes new rows."""
    out = scratch_dir(spark, "store")
    events = given.table(spark, d, "events").select("event_id", "event_type")
    events.write.partitionBy("event_type").parquet(out)
    sinks.clear_stored(spark, out)
    empty = spark.read.schema(events.schema).parquet(out).agg(F.count("*").alias("rows"))
    events.orderBy("event_id").limit(1).write.mode("append").partitionBy("event_type").parquet(out)
    after = spark.read.schema(events.schema).parquet(out).agg(F.count("*").alias("rows_after_append"))
    return empty.select(F.lit(1).alias("one"), F.lit(0).cast("bigint").alias("rows")).join(after.withColumn("one", F.lit(1)), "one").drop("one")


@query("stream_drained_log", f"""WITH {sql.TURNS}
    SELECT {sql.TURN_TIME} AS timestamp, role AS username, 'room_' || (conv_id % 7) AS channel, md5(text) AS message_hash FROM turns""")
def stream_drained_log(spark, d):
    """Every message twice in the stream, drained at the end, once in the log."""
    chat = given.conversations_chat(spark, d).select(
        F.col("msg_key").alias("msg_id"), F.to_timestamp("timestamp", given.TEXT_TIME).alias("ts"), "timestamp", "username", "channel",
        F.col("message").alias("content"),
    )
    landing, log = scratch_dir(spark, "drain-landing"), scratch_dir(spark, "drain-log")
    twice = chat.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    staging, checkpoint = scratch_dir(spark, "drain-stage"), scratch_dir(spark, "drain-checkpoint")
    for copy in (0, 1):  # drained again after more has come: the log holds every message once
        twice.where(F.col("copy") == copy).write.mode("append").parquet(landing)
        live.drain_to_log(live_sources.landing_stream(spark, landing, twice.schema, "parquet"), staging, log, checkpoint)
    back = chat_csv.read_csv(spark, log, multi_line=True)
    return back.select("timestamp", "username", "channel", F.md5("message").alias("message_hash"))


# --- chat pages -------------------------------------------------------------------


@query("chat_page_entries", f"""WITH {sql.TURNS}
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS entry_pos, msg_key AS msg_id, 'u' || conv_id AS user_id,
      role AS username, md5({sql.strip("regexp_replace(text, '[<>]', '', 'g')")}) AS content_hash FROM turns""")
def chat_page_entries(spark, d):
    """Conversations as captured chat pages with the marks of the live page, names included."""
    turns = given.table(spark, d, "conversations")
    uid = F.concat(F.lit("u"), "conv_id")
    entry = F.concat(
        F.lit(fixed.ENTRY_MARK), given.turn_key(), F.lit('"><a '), F.lit(fixed.USER_ID_MARK), uid, F.lit('" id="'), uid, F.lit('" style="x">'),
        F.col("role"), F.lit(fixed.NAME_END), F.lit("</a><p "), F.lit(fixed.CONTENT_MARK), F.lit("<b>"), F.regexp_replace("text", "[<>]", ""),
        F.lit("</b>"), F.lit(fixed.CONTENT_END),
    )
    pages = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", entry.alias("entry")))).alias("entries"))
    pages = pages.select("conv_id", F.concat(F.lit("<body>"), F.array_join("entries.entry", "\n")).alias("html"))
    rows = capture.newest_first(capture.page_entries(pages, page_key="conv_id"), "conv_id")
    return rows.select("conv_id", F.col("entry_pos").cast("bigint").alias("entry_pos"), "msg_id", "user_id", "username", F.md5("content").alias("content_hash"))
