"""Counts per period and label of a live stream: open periods as a small table, finished ones written for good.

The horizon of a batch is the newest event time of the batches before it less an allowed delay. Rows of periods that end after
the horizon are added to the table of open periods, which each batch writes anew under its id; a period that the batch's own events
leave behind is moved out. A row that comes later than that still counts: it goes to a correction table. So what a batch reads and
writes follows the open periods and its own rows, not the life of the stream, and no event is lost for being late (a watermark of
the engine would drop it). Closed counts and corrections are folded now and then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from chatloom.streaming.finished import finished, read, remove

PERIODS = {"minute": 60, "hour": 3600, "day": 86400}
DELTA, TABLE, LATE, DONE = "delta", "table", "late", "done"
COLUMNS = ("period", "label", "n")
TABLE_SCHEMA = "period timestamp, label string, n bigint, newest timestamp, kind string, batch bigint, state string"


def _end(period: str) -> Column:
    return F.col("period") + F.make_dt_interval(secs=F.lit(PERIODS[period]))


def _sum(rows: DataFrame) -> DataFrame:
    return rows.groupBy("period", "label").agg(F.sum("n").alias("n"))


class TrendTable:
    """The tables below `out`."""

    def __init__(self, spark: SparkSession, out: str, period: str = "hour", delay: str = "10 minutes", fold_every: int = 20):
        if period not in PERIODS:
            raise ValueError(f"unknown period {period!r}; expected one of {', '.join(PERIODS)}")
        self.spark, self.out, self.period, self.delay, self.fold_every = spark, out, period, delay, fold_every

    def _folder(self, kind: str, batch_id: int) -> str:
        return f"{self.out}/kind={kind}/batch={batch_id}"

    def _finished(self, kind: str) -> dict[int, str]:
        return finished(self.spark, f"{self.out}/kind={kind}")

    def _horizon(self, newest: Column) -> Column:
        return newest - F.expr(f"INTERVAL {self.delay}")

    def add(self, batch: DataFrame, batch_id: int, time: str, label: str) -> None:
        """Count a batch. A replay overwrites what it wrote before and reads what it read before."""
        spark = self.spark
        counted = batch.groupBy(F.date_trunc(self.period, F.col(time)).alias("period"), F.col(label).cast("string").alias("label"))
        counted = counted.agg(F.count("*").alias("n"), F.max(time).cast("timestamp").alias("newest"))
        counted.write.mode("overwrite").parquet(self._folder(DELTA, batch_id))
        delta = spark.read.parquet(self._folder(DELTA, batch_id))
        tables = self._finished(TABLE)
        before = max((b for b in tables if b < batch_id), default=None)
        open_, newest = None, F.lit(None).cast("timestamp")
        if before is not None:
            previous = spark.read.parquet(tables[before])
            newest = F.lit(previous.agg(F.max("newest")).first()[0]).cast("timestamp")
            open_ = previous.where("state = 'open'").select(*COLUMNS)
        # an event time that couldn't be read has no period to wait for
        late = F.coalesce(_end(self.period) <= self._horizon(newest), F.col("period").isNull())
        delta.where(late).select(*COLUMNS).write.mode("overwrite").parquet(self._folder(LATE, batch_id))
        fresh = delta.where(~late).select(*COLUMNS)
        rows = _sum(fresh if open_ is None else open_.unionByName(fresh))
        own = delta.agg(F.max("newest")).first()[0]
        newest = F.greatest(newest, F.lit(own).cast("timestamp"))
        closed = F.coalesce(_end(self.period) <= self._horizon(newest), F.lit(False))
        rows = rows.withColumn("newest", newest).withColumn("state", F.when(closed, "closed").otherwise("open"))
        mark = spark.range(1).select(*(F.lit(None).cast(k).alias(c) for c, k in zip(COLUMNS, ("timestamp", "string", "bigint"))), newest.alias("newest"), F.lit("mark").alias("state"))
        rows.unionByName(mark).write.mode("overwrite").partitionBy("state").parquet(self._folder(TABLE, batch_id))
        if batch_id and batch_id % self.fold_every == 0:
            self.fold(batch_id)

    def _pieces(self, until: int | None = None) -> tuple[int, list[DataFrame], int | None]:
        """The last fold, the closed counts and corrections after it, and the batch that holds the open periods."""
        spark, keep = self.spark, lambda b: until is None or b <= until
        folds, tables, lates = self._finished(DONE), self._finished(TABLE), self._finished(LATE)
        fold = max((b for b in folds if keep(b)), default=-1)
        parts = [spark.read.parquet(folds[fold])] if fold >= 0 else []
        later = [f for b, f in tables.items() if b > fold and keep(b)]
        # one read: a table of many folders, whose states are folders
        if later:
            tables_ = spark.read.schema(TABLE_SCHEMA).option("basePath", self.out).parquet(*later)
            parts.append(tables_.where("state = 'closed'").select(*COLUMNS))
        if found := [f for b, f in lates.items() if b > fold and keep(b)]:
            parts.append(read(spark, found))
        return fold, parts, max((b for b in tables if keep(b)), default=None)

    def fold(self, batch_id: int) -> None:
        """Closed counts and corrections up to `batch_id` as one table; what the fold before replaced is removed."""
        if batch_id in self._finished(DONE):
            return
        before, parts, _ = self._pieces(batch_id)
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        _sum(rows).write.mode("overwrite").parquet(self._folder(DONE, batch_id))
        for kind in (DONE, TABLE, LATE, DELTA):
            remove(self.spark, [f for b, f in self._finished(kind).items() if b < before or (kind != DONE and b == before)])

    def open_periods(self) -> DataFrame:
        """The counts that the last batch kept open: what the next one reads."""
        last = self._pieces()[2]
        if last is None:
            raise ValueError(f"no finished batch in {self.out}")
        return self.spark.read.parquet(self._folder(TABLE, last)).where("state = 'open'").select(*COLUMNS)

    def counts(self) -> DataFrame:
        """`(period, label, n)` of every event so far, late ones included."""
        rows = self.open_periods()
        for part in self._pieces()[1]:
            rows = rows.unionByName(part)
        return _sum(rows)

    def corrections(self) -> DataFrame:
        """`(period, label, n)` of late events that haven't been folded."""
        folders = list(self._finished(LATE).values())
        rows = read(self.spark, folders)
        if rows is None:
            raise ValueError(f"no finished batch in {self.out}")
        return _sum(rows)


def start_trend(
    stream: DataFrame, out: str, checkpoint: str, time: str = "ts", label: str = "sentiment", period: str = "minute",
    delay: str = "10 minutes", every: str | None = None, fold_every: int = 20,
) -> StreamingQuery:
    """Count a stream into the tables below `out`; `TrendTable(spark, out, period).counts()` reads them at any time."""
    writer = stream.select(time, label).writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: TrendTable(batch.sparkSession, out, period, delay, fold_every).add(batch, batch_id, time, label)
    )
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
