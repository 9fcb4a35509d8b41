"""The given tables read as chat data. Every frame below covers its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from chatloom.functions import fixed
from chatloom.operators.cleaning import exploded, with_tokens
from chatloom.operators.sentiment import ValenceWords, with_polarity
from chatloom.session import materialise, spread

# Sample word tables: frequent words of the given texts stand in for a user's lexicon.
# Weights are multiples of 1/8, so that sums are exact in any order.
SAMPLE_POLARITY = {
    "that": 0.5, "this": 0.75, "from": 1.0, "best": 1.0, "und": 0.5, "les": 0.625, "que": 0.375, "is": 0.25,
    "was": -0.75, "with": -0.5, "are": -0.625, "the": -0.125, "der": -0.25, "des": -0.5, "los": -0.75, "on": -0.375,
}
SAMPLE_VALENCE = {
    "this": 1.5, "from": 2.0, "best": 3.25, "und": 1.25, "les": 1.75, "que": 0.75, "it": 0.5,
    "was": -1.5, "with": -1.25, "are": -2.0, "der": -0.75, "des": -1.25, "los": -1.75, "for": -0.5,
}
SAMPLE_RULES = ValenceWords(
    negations=("no", "not", "un", "of", "von"), boosters_up=("that", "la", "very"), boosters_down=("and", "el"), contrast="by"
)
SAMPLE_LEMMAS = {"that": "this", "rewh": "wh", "thatin": "that", "ononst": "onon", "les": "le", "hehely": "hely"}
LANGUAGES = ("de", "en", "es", "fr")
TEXT_TIME = "yyyy-MM-dd HH:mm:ss"
FIRST_SECOND = 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- documents as messages --------------------------------------------------------


def documents_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(doc_id, username, lang, message)`."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("source").alias("username"), "lang", F.col("text").alias("message"))


def documents_tokens(spark: SparkSession, sf_dir: str, in_batches: bool = False) -> DataFrame:
    return with_tokens(spread(documents_chat(spark, sf_dir)), key="doc_id", in_batches=in_batches)


def documents_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_polarity(spread(documents_chat(spark, sf_dir)), SAMPLE_POLARITY, key="doc_id")


# --- conversations as a chat log --------------------------------------------------


def turn_key() -> Column:
    return F.concat_ws("-", "conv_id", "turn")


def turn_second() -> Column:
    return F.lit(FIRST_SECOND) + F.col("conv_id") * 37 + F.col("turn") * 11


def conversations_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(msg_key, timestamp, username, message, channel)` with text times."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        turn_key().alias("msg_key"),
        F.date_format(F.timestamp_seconds(turn_second()), TEXT_TIME).alias("timestamp"),
        F.col("role").alias("username"),
        F.col("text").alias("message"),
        F.concat(F.lit("room "), (F.col("conv_id") % 7).cast("string")).alias("channel"),
    )


def conversation_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a webhook envelope; role, turn and conversation decide the body shape."""
    turns = spread(table(spark, sf_dir, "conversations"))
    name = F.when(F.col("conv_id") % 10 == 0, F.concat(F.lit("test_"), "role")).otherwise(F.col("role"))
    text = F.col("text")
    full = F.to_json(
        F.struct(
            turn_key().alias("message_id"), text.alias("content"), F.struct(name.alias("username")).alias("sender")
        )
    )
    flat = F.to_json(F.struct(text.alias("text"), name.alias("user")))
    nested = F.to_json(
        F.struct(
            F.lit(None).cast("string").alias("content"),
            text.alias("message"),
            F.struct(F.lit(1).alias("id")).alias("sender"),
            F.struct(name.alias("username")).alias("broadcaster"),
        ),
        {"ignoreNullFields": "false"},
    )
    form = F.concat(F.lit("content="), F.regexp_replace(text, "[&=]", ""), F.lit("&username="), name)
    broken = F.concat(F.lit('{"content": '), text)
    body = (
        F.when(F.col("turn") % 5 == 3, broken)
        .when(F.col("turn") % 5 == 4, form)
        .when(F.col("role") == "user", full)
        .when(F.col("role") == "assistant", flat)
        .otherwise(nested)
    )
    event_type = F.when(F.col("conv_id") % 3 == 0, fixed.CHAT_EVENT).when(F.col("conv_id") % 3 == 1, "channel.followed")
    signature = F.when(F.col("conv_id") % 4 != 0, "sig").otherwise("")
    headers = F.create_map(
        F.lit(fixed.H_EVENT_TYPE), event_type,
        F.lit(fixed.H_SIGNATURE), signature,
        F.lit(fixed.H_MESSAGE_ID), turn_key(),
        F.lit(fixed.H_TIMESTAMP), F.date_format(F.timestamp_seconds(turn_second()), TEXT_TIME),
    )
    return turns.select(
        turn_key().alias("turn_key"),
        headers.alias("headers"),
        body.alias("body"),
        F.timestamp_seconds(turn_second()).alias("received_at"),
    )


# --- events as a live stream ------------------------------------------------------


def events_feed(events: DataFrame) -> DataFrame:
    """Events as scored messages: user = channel, the sign of `value - 10` = label."""
    value = F.col("value")
    label = F.when(value > 12, "positive").when(value < 8, "negative").otherwise("neutral")
    return events.select(
        F.col("user_id").alias("channel"),
        F.col("event_id").alias("msg_key"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("username"),
        F.col("props").alias("message"),
        label.alias("sentiment"),
        value.alias("sentiment_score"),
    )


# --- labels against rule-made predictions -----------------------------------------


def _pair_keys() -> list[Column]:
    return [F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 3 + 1).cast("string")).alias("timestamp")]


def predicted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the polarity score, with stray blanks, mixed case and some nulls."""
    scored = documents_scored(spark, sf_dir)
    label = F.when(F.col("doc_id") % 5 == 0, F.upper("sentiment")).otherwise(F.col("sentiment"))
    return scored.select(
        *_pair_keys(),
        F.concat(F.lit(" "), "lang", F.lit("\t")).alias("username"),
        F.col("message").alias("message_text"),
        F.when(F.col("doc_id") % 97 != 0, label).alias("predicted_label"),
    )


def truth_name() -> Column:
    return F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(doc_id, lang, text, label)`."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    labels = table(spark, sf_dir, "labels").select("doc_id", truth_name().alias("label"))
    return docs.join(labels, "doc_id")


def actual_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_documents(spark, sf_dir)
    return rows.select(
        *_pair_keys(),
        F.col("lang").alias("username"),
        F.concat("text", F.lit("\n")).alias("message_text"),
        F.when(F.col("doc_id") % 41 != 0, F.col("label")).alias("actual_label"),
    )


# --- language keywords as topics --------------------------------------------------


def language_topics(tokens: DataFrame, n: int) -> DataFrame:
    """`(topic, rank, word, weight, mass)`: the `n` most frequent tokens of every language."""
    words = exploded(tokens, "tokens", "lang").withColumnRenamed("token", "word")
    # Two readers: the counts, one row per language and word, are written once.
    counts = materialise(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "language-words")
    # The limit keeps n words per language in every task; the sums are one row per language.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    top = counts.withColumn("rank", rank - 1).filter(F.col("rank") < n)
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    topic = F.array_position(F.array(*[F.lit(x) for x in LANGUAGES]), F.col("lang")) - 1
    return top.join(total, "lang").select(
        topic.cast("int").alias("topic"),
        "rank",
        "word",
        (F.col("n") / F.col("total")).alias("weight"),
        F.col("total").cast("double").alias("mass"),
    )


def language_topic_words(tokens: DataFrame, n: int) -> list[tuple[int, str]]:
    """Languages x n words: bounded by the parameters."""
    return [(r.topic, r.word) for r in language_topics(tokens, n).collect()]
