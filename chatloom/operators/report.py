"""Distribution, trend, keywords and suggestions of labelled messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from chatloom.functions import fixed
from chatloom.operators.cleaning import exploded
from chatloom.session import settled


def preview(df: DataFrame, order: Sequence[str] = ("timestamp",), rows: int = fixed.PREVIEW_ROWS) -> DataFrame:
    """First rows of `timestamp, [username], message`, in a fixed order."""
    columns = [c for c in ("timestamp", "username", "message") if c in df.columns]
    return df.orderBy(*order).limit(rows).select(*columns)


def result_rows(df: DataFrame) -> DataFrame:
    """Preview columns plus the label, those that exist."""
    return df.select(*[c for c in ("timestamp", "username", "message", "sentiment") if c in df.columns])


def distribution(df: DataFrame, label: str = "sentiment") -> DataFrame:
    """`(label, n)`, nulls dropped, biggest first."""
    return (
        df.filter(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), label)
    )


def overall_label(df: DataFrame, label: str = "sentiment") -> DataFrame:
    """Most frequent label; a tie goes to the alphabetically first. One row, always."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(label))


def trend(
    df: DataFrame,
    time: str = "ts",
    label: str = "sentiment",
    labels: Sequence[str] = fixed.LABELS,
    period: str = "minute",
) -> DataFrame:
    """Rows per period and label, one column per label; empty periods are not emitted.

    The label values are given, so no extra job looks for them, and one partial-aggregated pass counts
    them. Rows without a label don't count: a period of such rows alone is not emitted. A label outside the list is an
    error. Rows whose time could not be read are not lost: they are counted under a null period. A label that is
    worked out (a score) is worked out once per row.
    """
    df = settled(df.select(time, label))
    listed = F.col(label).isin(*labels)
    checked = F.when(listed, F.col(label)).otherwise(
        F.raise_error(F.concat(F.lit("a label outside the list: "), F.col(label).cast("string"))).cast("string")
    )
    rows = df.select(F.date_trunc(period, F.col(time)).alias("period"), F.when(F.col(label).isNotNull(), checked).alias("_label"))
    return rows.filter(F.col("_label").isNotNull()).groupBy("period").agg(*(F.count_if(F.col("_label") == x).alias(x) for x in labels))


def trend_counts(df: DataFrame, time: str = "ts", label: str = "sentiment", period: str = "1 minute") -> DataFrame:
    """The same counts in long form; also valid on a stream (update mode)."""
    return (
        df.groupBy(F.window(time, period).alias("w"), label)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("period"), label, "n")
    )


def sort_by_time(df: DataFrame, time: str = "ts", key: str = "msg_key") -> DataFrame:
    """Presentation order only."""
    return df.orderBy(time, key)


def negative_messages(df: DataFrame, label: str = "sentiment") -> DataFrame:
    """The filter stays behind the scoring, which is worked out once."""
    return settled(df).filter(F.col(label) == "negative")


def top_words(df: DataFrame, tokens: str = "tokens", n: int = 3) -> DataFrame:
    """Most frequent tokens; ties alphabetically. A hot token is folded before the shuffle."""
    return (
        exploded(df, tokens)
        .groupBy("token")
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "token")
        .limit(n)
    )


def negative_top_words(df: DataFrame, label: str = "sentiment", tokens: str = "tokens", n: int = 3) -> DataFrame:
    """Top words of the messages labelled negative.

    The label decides inside the projection: as a row filter its whole scoring expression
    would be pushed to the scan and worked out there a second time.
    """
    words = F.when(F.col(label) == "negative", F.col(tokens))
    return top_words(df.select(words.alias(tokens)), tokens, n)


def suggestions(df: DataFrame, topics: DataFrame | None = None, label: str = "sentiment", tokens: str = "tokens") -> DataFrame:
    """`(rank, kind, text)`: overall mood, words of the leading topic, words of negative messages.

    `topics` is `(topic, rank, word, weight[, mass])`; the topic with the largest mass (tie:
    lowest id) speaks, topic 0 when there is no mass column. Both aggregates are bounded.
    """
    mood_key = F.when(F.col(label).isin("positive", "negative"), F.col(label)).otherwise("neutral")
    mood_text = F.lit(fixed.MOOD_TEXT["neutral"])
    for name in ("positive", "negative"):
        mood_text = F.when(mood_key == name, fixed.MOOD_TEXT[name]).otherwise(mood_text)
    mood = overall_label(df, label).select(
        F.lit(1).alias("rank"),
        F.lit("mood").alias("kind"),
        F.when(F.col(label).isNull(), fixed.NO_DATA_TEXT).otherwise(mood_text).alias("text"),
    )
    words = negative_top_words(df, label, tokens).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("token").alias("token")))),
                lambda x: x["token"],
            ),
            ", ",
        ).alias("words")
    )
    negative = words.filter(F.col("words") != "").select(
        F.lit(3).alias("rank"),
        F.lit("negative_words").alias("kind"),
        F.concat(F.lit(fixed.NEGATIVE_TEXT[0]), "words", F.lit(fixed.NEGATIVE_TEXT[1])).alias("text"),
    )
    rows = mood.unionByName(_topic_line(df, topics)).unionByName(negative)
    # At most three rows: fold them, so that an unlabelled input keeps only the fixed line.
    line = F.struct("rank", "kind", "text")
    folded = rows.agg(F.array_sort(F.collect_list(line)).alias("lines"))
    no_data = F.exists("lines", lambda x: x["text"] == fixed.NO_DATA_TEXT)
    shown = F.filter("lines", lambda x: ~no_data | (x["rank"] == 1))
    return folded.select(F.inline(shown))


def _topic_line(df: DataFrame, topics: DataFrame | None) -> DataFrame:
    spark = df.sparkSession
    if topics is None:
        topics = spark.createDataFrame([], "topic int, rank int, word string, weight double")
    mass = F.col("mass") if "mass" in topics.columns else F.lit(0.0)
    lead = (
        topics.groupBy("topic", mass.alias("mass"))
        .agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("words"))
        .agg(F.min_by("words", F.struct(-F.col("mass"), F.col("topic"))).alias("words"))
    )
    line = F.concat(F.lit(fixed.TOPIC_TEXT[0]), F.array_join("words.word", ", "), F.lit(fixed.TOPIC_TEXT[1]))
    return lead.select(
        F.lit(2).alias("rank"),
        F.lit("topic_words").alias("kind"),
        F.when(F.col("words").isNull(), fixed.NO_TOPIC_TEXT).otherwise(line).alias("text"),
    )
