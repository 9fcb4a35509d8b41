"""Last-N retention and summaries of what is retained."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chatloom.functions import fixed

TRIM_SALTS = 64


def last_n_per(
    df: DataFrame,
    group: str,
    n: int = fixed.KEEP_STREAM_MESSAGES,
    order: Sequence[str] = ("ts", "msg_key"),
    salts: int = TRIM_SALTS,
) -> DataFrame:
    """The newest `n` rows of every group by `(ts, id)`.

    Every map task keeps at most `n` rows per group (WindowGroupLimit); a first salted round
    spreads a hot group over `salts` tasks, so that the last task of a group sees at most
    `n * salts` rows however many map tasks there were.
    """
    newest = [F.col(c).desc() for c in order]
    salt = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    trimmed = _top(df.withColumn("_salt", salt), [group, "_salt"], newest, n).drop("_salt")
    return _top(trimmed, [group], newest, n)


def _top(df: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def last_n(df: DataFrame, n: int = fixed.DISPLAY_ROWS, order: Sequence[str] = ("ts", "msg_key")) -> DataFrame:
    """The newest `n` rows overall: per-task heaps, no full sort."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def stored_messages_kept(stored: DataFrame, order: Sequence[str] = ("timestamp", "id")) -> DataFrame:
    """What the webhook store shows: its newest messages."""
    return last_n(stored, fixed.KEEP_WEBHOOK_MESSAGES, order)


def raw_events_kept(envelopes: DataFrame, order: Sequence[str] = ("received_at",)) -> DataFrame:
    """What the raw-event view shows: the newest events, readable or not."""
    return last_n(envelopes, fixed.KEEP_RAW_EVENTS, order)


def retained_summary(retained: DataFrame, group: str, tail: int = fixed.SUMMARY_TAIL) -> DataFrame:
    """Per group: rows kept, mean score, rows per label, the last few messages.

    The input is already bounded to N rows per group, so the collected list is too.
    """
    entry = F.struct("ts", "msg_key", "username", "message", "sentiment", "sentiment_score")
    label = F.col("sentiment")
    return (
        retained.groupBy(group)
        .agg(
            F.count("*").alias("total_messages_stored"),
            F.avg("sentiment_score").alias("average_sentiment_score"),
            F.count_if(label == "positive").alias("positive_messages"),
            F.count_if(label == "negative").alias("negative_messages"),
            F.count_if(label == "neutral").alias("neutral_messages"),
            F.array_sort(F.collect_list(entry)).alias("_rows"),
        )
        .withColumn("last_messages", F.slice("_rows", F.greatest(F.size("_rows") - tail + 1, F.lit(1)), tail))
        .drop("_rows")
    )
