"""Emit-once ids, new-message detection, monitor counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import AtomicType


def first_per_id(df: DataFrame, key: str = "msg_id", order: Sequence[str] = ("ts",)) -> DataFrame:
    """One whole row per id, the earliest in `order`; of equal ones the least of the whole row.

    The rank filter becomes a group limit of one row per id in every map task, so copies of
    a hot id are dropped before the shuffle.
    """
    ties = [f.name for f in df.schema.fields if isinstance(f.dataType, AtomicType) and f.name not in (key, *order)]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order, *ties))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def first_ids_of_text(df: DataFrame, text_col: str = "message", key: str = "msg_key") -> DataFrame:
    """`(text_hash, key, copies)`: the lowest key and the number of copies of every distinct text.

    Only a 64-character digest is shuffled, after partial aggregation.
    """
    return df.groupBy(F.sha2(text_col, 256).alias("text_hash")).agg(
        F.min(key).alias(key), F.count("*").alias("copies")
    )


def new_messages(messages: DataFrame, seen: DataFrame, key: str = "msg_id", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Messages whose id was not seen before, each once; an empty id is never new."""
    named = messages.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    # Fold the copies before the anti-join: a hot id then crosses the shuffle once per task.
    fresh = first_per_id(named, key, order)
    return fresh.join(seen.select(key).distinct(), key, "left_anti")


def monitor_counters(fresh: DataFrame, checks: int, kick_events: DataFrame | None = None, before: int = 0) -> DataFrame:
    """Counters of one check: checks made, new, real, test messages, webhook event increase."""
    counts = fresh.agg(
        F.lit(checks).cast("bigint").alias("total_checks"),
        F.count("*").alias("new_messages"),
        F.count_if(~F.col("is_test")).alias("real_messages"),
        F.count_if("is_test").alias("test_messages"),
    )
    if kick_events is None:
        return counts
    # Both frames are single aggregate rows.
    total = kick_events.agg(F.max("kick_events").alias("kick_events"))
    tagged = counts.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return tagged.withColumn("kick_event_increase", F.greatest(F.col("kick_events") - before, F.lit(0)))


def exact_lookup(
    messages: DataFrame, wanted: DataFrame, text_col: str = "message", keep: Sequence[str] = ("message",)
) -> DataFrame:
    """`(keep…, received)` for every wanted row: was a message with exactly this text stored?

    Both sides are joined by digest; the stored side is folded to distinct digests first.
    """
    found = messages.select(F.sha2(text_col, 256).alias("_h")).distinct().withColumn("received", F.lit(True))
    asked = wanted.select(*keep, F.sha2(text_col, 256).alias("_h"))
    return asked.join(found, "_h", "left").select(*keep, F.coalesce("received", F.lit(False)).alias("received"))


def received_messages(messages: DataFrame, wanted: DataFrame, text_col: str = "message") -> DataFrame:
    """Stored messages whose text is one of the wanted texts; both sides meet on a digest, the wanted ones once each."""
    asked = wanted.select(F.sha2(text_col, 256).alias("_h")).distinct()
    return messages.withColumn("_h", F.sha2(text_col, 256)).join(asked, "_h", "left_semi").drop("_h")
