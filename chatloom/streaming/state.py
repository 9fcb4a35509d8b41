"""The newest rows of each channel as keyed state of the stream itself.

Every task first keeps the newest N rows per channel of its part of a batch, so a channel that holds a third of all rows reaches its
state as a few rows per task. The state of a channel is a list of its newest N rows; what a batch changes is written as the whole
buffer of the channel, and a reader takes the last buffer of each. A channel that stays idle for longer than a given time is
forgotten: its written buffer stays readable, and its next rows begin a new one. Needs Spark's RocksDB state store.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from chatloom.functions import fixed
from chatloom.streaming.finished import finished

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def newest_order(at: Sequence[int]) -> Callable[[tuple], tuple]:
    """Places of the order columns as a key: a missing value is older than all others."""

    def key(row: tuple) -> tuple:
        return tuple((row[i] is not None, row[i]) if row[i] is not None else (False,) for i in at)

    return key


class NewestRows(StatefulProcessor):
    """Keeps the newest `n` rows of a key; gives back the buffer whenever rows arrive."""

    def __init__(self, schema: StructType, order: Sequence[str], n: int, idle_ms: int | None = None):
        self.schema, self.names, self.n, self.idle_ms = schema, schema.names, n, idle_ms
        self.order = [self.names.index(c) for c in order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = [tuple(r) for r in self.rows.get()]
        fresh = (tuple(r[c] for c in self.names) for r in rows)
        newest = heapq.nlargest(self.n, [*held, *heapq.nlargest(self.n, fresh, key=newest_order(self.order))], key=newest_order(self.order))
        self.rows.put(newest)
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        for r in newest:
            yield Row(**dict(zip(self.names, r)))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.rows.clear()
        return iter(())

    def close(self) -> None: ...


def newest_of(rows: pa.Table, group: str, order: Sequence[str], n: int) -> pa.Table:
    """The newest `n` rows of each group; a missing value is older than all others."""
    codes = rows[group].combine_chunks().dictionary_encode(null_encoding="encode").indices
    found = rows.append_column("_code", codes)
    keys = [("_code", "ascending"), *((c, "descending") for c in order)]
    found = found.take(pc.sort_indices(found, sort_keys=keys, null_placement="at_end"))
    code = found["_code"].to_numpy()
    first = np.flatnonzero(np.diff(code, prepend=-1))
    place = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
    return found.drop_columns("_code").filter(pa.array(place < n))


def trimmed(stream: DataFrame, group: str, order: Sequence[str], n: int) -> DataFrame:
    """The newest `n` rows per group of each part of a batch; works on a stream, which allows no ranking."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            best = newest_of(table if best is None else pa.concat_tables([best, table]), group, order, n)
        if best is not None:
            yield from best.combine_chunks().to_batches()

    return stream.mapInArrow(keep, stream.schema)


def start_buffers(
    stream: DataFrame, out: str, checkpoint: str, group: str = "channel", n: int = fixed.KEEP_STREAM_MESSAGES,
    order: Sequence[str] = ("ts", "msg_key"), idle_seconds: float | None = None, every: str | None = None,
) -> StreamingQuery:
    """Keep the newest `n` rows per group; each batch writes the buffers it changed below its id. A null group is a group."""
    keyed = stream.withColumn("_group", F.to_json(F.struct(group), {"ignoreNullFields": "false"}))
    rows = trimmed(keyed, group, order, n)
    # times go through the state as whole microseconds, which no time zone can touch
    times = [f.name for f in stream.schema.fields if isinstance(f.dataType, TimestampType)]
    rows = rows.withColumns({c: F.unix_micros(c) for c in times})
    schema = StructType([StructField(f.name, LongType() if f.name in times else f.dataType, True) for f in stream.schema.fields])
    processor = NewestRows(schema, order, n, None if idle_seconds is None else int(idle_seconds * 1000))
    mode = "None" if idle_seconds is None else "ProcessingTime"
    buffers = rows.groupBy("_group").transformWithState(processor, schema, "Update", mode)
    buffers = buffers.withColumns({c: F.timestamp_micros(c) for c in times})

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = buffers.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    spark = stream.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)  # a query takes the settings of its session when it starts
    try:
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def read_buffers(spark: SparkSession, out: str, group: str = "channel") -> DataFrame:
    """The last buffer of each group."""
    folders = list(finished(spark, out).values())
    if not folders:
        raise ValueError(f"no finished batch in {out}")
    rows = spark.read.option("basePath", out).parquet(*folders)
    last = rows.groupBy(F.col(group).alias("_group")).agg(F.max("batch").alias("_last"))
    return rows.join(last, F.col(group).eqNullSafe(F.col("_group")) & (F.col("batch") == F.col("_last"))).drop("_group", "_last", "batch")
