"""Live jobs: score chat events, keep the newest, count, dedupe, route, monitor."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from chatloom.functions import fixed
from chatloom.functions.text import parse_time
from chatloom.operators import capture, dedupe, retain, webhook
from chatloom.operators.sentiment import ValenceWords, WordWeights, with_valence
from chatloom.sources import sinks
from chatloom.streaming import retained
from chatloom.streaming.finished import finished
from chatloom.streaming.ids import IdMemory, is_named


def start(
    stream: DataFrame,
    on_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str | None = None,
    mode: str = "append",
) -> StreamingQuery:
    """`every` = processing-time trigger; None = drain what is there and stop."""
    writer = stream.writeStream.foreachBatch(on_batch).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


# --- scored chat ------------------------------------------------------------------


def score_events(envelopes: DataFrame, lexicon: WordWeights, rules: ValenceWords = ValenceWords()) -> DataFrame:
    """Signed chat events to scored rows; rejected rows keep their `reason`. Row-local."""
    events = webhook.chat_events(envelopes)
    scored = with_valence(events, lexicon, rules=rules)
    return scored.withColumn("ts", parse_time(F.col("timestamp")))


def score_bot_messages(raw: DataFrame, lexicon: WordWeights, rules: ValenceWords = ValenceWords()) -> DataFrame:
    """Bot messages with channel, same scoring; rejected rows keep their `reason`."""
    named = webhook.bot_messages(raw).withColumn(
        "msg_key", F.sha2(F.to_json(F.struct("timestamp", "username", "message", "channel")), 256)
    )
    return with_valence(named, lexicon, rules=rules).withColumn("ts", parse_time(F.col("timestamp")))


def start_scored(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Write scored and rejected rows, one folder each, in one pass per batch.

    A replayed batch overwrites its own folder. Each batch is scored as a table of its own, so any
    scorer will do, also one that joins a big word table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = score(batch).withColumn("outcome", F.when(F.col("reason").isNull(), "scored").otherwise("rejected"))
        rows.write.mode("overwrite").partitionBy("outcome").parquet(f"{out}/batch={batch_id}")

    return start(stream, write, checkpoint, every)


def start_retained(
    stream: DataFrame, out: str, checkpoint: str, group: str = "channel",
    n: int = fixed.KEEP_STREAM_MESSAGES, every: str | None = None,
) -> StreamingQuery:
    return start(stream, retained.retain_batches(out, group, n), checkpoint, every)


def rolling_summary(spark: SparkSession, out: str, group: str = "channel", n: int = fixed.KEEP_STREAM_MESSAGES) -> DataFrame:
    """Summary of the retained rows, a batch query that can run at any time."""
    return retain.retained_summary(retained.read_retained(spark, out, group, n), group)


# --- counters ---------------------------------------------------------------------


def start_counters(envelopes: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Running webhook counters: one row of state, rewritten per batch under its id."""
    counters = webhook.webhook_counters(webhook.normalise_envelopes(envelopes))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return start(counters, write, checkpoint, every, mode="complete")


def latest_counters(spark: SparkSession, out: str) -> DataFrame:
    folders = finished(spark, out)
    if not folders:
        raise ValueError(f"no finished batch in {out}")
    return spark.read.parquet(folders[max(folders)])


def counters_increase(spark: SparkSession, out: str, column: str = "kick_events") -> DataFrame:
    """`(batch, total, increase)` since the previous check; batch ids have no gaps."""
    folders = list(finished(spark, out).values())
    rows = spark.read.option("basePath", out).parquet(*folders).select(F.col("batch").cast("bigint").alias("batch"), F.col(column).alias("total"))
    before = rows.select((F.col("batch") + 1).alias("batch"), F.col("total").alias("before"))
    increase = F.greatest(F.col("total") - F.coalesce("before", F.lit(0)), F.lit(0))
    return rows.join(before, "batch", "left").select("batch", "total", increase.alias("increase"))


# --- ids, routes, logs ------------------------------------------------------------


def unseen(batch: DataFrame, memory: IdMemory, batch_id: int, order: Sequence[str]) -> DataFrame:
    """The rows of a batch whose id no batch before it let through, each id once.

    What a batch may not see again are the ids of the batches before it, so a replay gives the same rows. Rows whose id is
    null or empty all pass: nothing says that one repeats another.
    """
    named = is_named(memory.key)
    fresh = memory.unseen(dedupe.first_per_id(batch.filter(named), memory.key, order), batch_id)
    return fresh.unionByName(batch.filter(~named))


def write_once(batch: DataFrame, out: str, batch_id: int, key: str, order: Sequence[str]) -> None:
    """Write what of a batch wasn't there before, then remember its ids; a replay overwrites both by the same."""
    spark, folder = batch.sparkSession, f"{out}/batch={batch_id}"
    memory = IdMemory(spark, f"{out}/_ids", key)
    unseen(batch, memory, batch_id, order).write.mode("overwrite").parquet(folder)
    memory.remember(spark.read.schema(batch.schema).parquet(folder), batch_id)


def start_once(
    stream: DataFrame, out: str, checkpoint: str, key: str = "msg_id", order: Sequence[str] = ("ts",), every: str | None = None
) -> StreamingQuery:
    """Each id once, however late it comes; the ids that were let through are kept below `out/_ids` (see `ids.py`)."""

    return start(stream, lambda batch, batch_id: write_once(batch, out, batch_id, key, order), checkpoint, every)


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all finished batches of a job."""
    folders = list(finished(spark, out).values())
    if not folders:
        raise ValueError(f"no finished batch in {out}")
    return spark.read.option("basePath", out).parquet(*folders)


def start_append(stream: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Plain exactly-once parquet sink."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def start_append_batches(stream: DataFrame, out: str, checkpoint: str, every: str = "0 seconds") -> StreamingQuery:
    """A folder per batch, cycle after cycle until it is stopped; a replayed batch overwrites its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return start(stream, write, checkpoint, every)


def drain_shares(streams: Sequence[DataFrame], out: str, checkpoint: str) -> None:
    """The streams side by side until each has read what is there: a folder per stream, and in it one per batch."""
    queries = []
    try:
        for i, stream in enumerate(streams):
            queries.append(start_append_batches(stream, f"{out}/share={i}", f"{checkpoint}/share={i}"))
        for query in queries:
            query.processAllAvailable()
    finally:
        for query in queries:
            query.stop()


def read_shares(spark: SparkSession, out: str, shares: int) -> DataFrame:
    """The rows of all finished batches of all shares, with `share` and `batch`; a share may have had no rows."""
    folders = [folder for i in range(shares) for folder in finished(spark, f"{out}/share={i}").values()]
    if not folders:
        raise ValueError(f"no finished batch in {out}")
    return spark.read.option("basePath", out).parquet(*folders)


def start_routed(events: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Typed capture events, one folder per route, one pass per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        capture.route_events(batch).write.mode("overwrite").partitionBy("route").parquet(f"{out}/batch={batch_id}")

    return start(events, write, checkpoint, every)


def drain_to_log(stream: DataFrame, staging: str, log: str, checkpoint: str, fmt: str = "csv", key: str = "msg_id") -> list[str]:
    """Read what is left, each id once, then write the chat log of this drain.

    The log's folder is named by the checkpoint and written anew, so a drain that runs again leaves every message once.
    """
    start_once(stream, staging, checkpoint, key).awaitTermination()
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    return sinks.write_chat_log(read_batches(stream.sparkSession, staging), f"{log}/drain={name}", fmt, mode="overwrite")


def start_audit(envelopes: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Raw events exactly as received, before any parsing."""
    return start_append(envelopes, out, checkpoint, every)


# --- monitor ----------------------------------------------------------------------


def monitor(messages: DataFrame, baseline: DataFrame, key: str = "id", order: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """One check: what is in `messages` and not in `baseline`, counted."""
    return dedupe.monitor_counters(dedupe.new_messages(messages, baseline, key, order), checks=1)


def start_monitor(
    stream: DataFrame, out: str, checkpoint: str, key: str = "msg_id", order: Sequence[str] = ("ts",), every: str | None = None
) -> StreamingQuery:
    """A check per batch: what is new below `out/new`, and the counters of the check below `out/checks`."""

    def check(batch: DataFrame, batch_id: int) -> None:
        spark, folder = batch.sparkSession, f"{out}/new/batch={batch_id}"
        memory = IdMemory(spark, f"{out}/new/_ids", key)
        unseen(batch.filter(is_named(key)), memory, batch_id, order).write.mode("overwrite").parquet(folder)
        fresh = spark.read.schema(batch.schema).parquet(folder)
        memory.remember(fresh, batch_id)
        counted = dedupe.monitor_counters(fresh, checks=batch_id + 1)
        counted.write.mode("overwrite").parquet(f"{out}/checks/batch={batch_id}")

    return start(stream, check, checkpoint, every)


def run_for(query: StreamingQuery, seconds: int = 300) -> bool:
    """Let a monitoring stream run for a bounded time; True when it ended by itself."""
    ended = query.awaitTermination(seconds)
    if not ended:
        query.stop()
    return bool(ended)
