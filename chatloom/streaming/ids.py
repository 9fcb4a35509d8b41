"""Memory of ids of a stream: ids only, in buckets by hash, folded by level.

Each batch writes the ids it let through as a run of level 0. As soon as FAN_IN runs of a level lie side by side they are merged
into one run of the next level, so after n batches there are at most (FAN_IN - 1) x log(n) runs, and an id is rewritten once per level. A
run has a folder for each bucket; a batch reads only the buckets of its own ids, and only the runs of the batches before it, so a
replayed batch sees what it saw the first time. Inputs of a merge stay for the batch after it, which may still have to be replayed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chatloom.streaming.finished import finished_levels, remove

BUCKETS = 64
FAN_IN = 8


def is_named(key: str) -> Column:
    """Rows without an id, or with an empty one, are no repeats of each other."""
    return F.coalesce(F.col(key).isNotNull() & (F.col(key).cast("string") != ""), F.lit(False))


def runs_before(found: dict[int, set[int]], until: int, fan_in: int) -> list[tuple[int, int]]:
    """`(level, last batch)` of the finished runs that hold batches 0 to `until` - 1, the fewest there are.

    A run of a level ends at a multiple of fan_in ** level; where a merge isn't finished its inputs are taken.
    """
    out, at = [], 0
    while at < until:
        for level in sorted(found, reverse=True):
            size = fan_in**level
            if at % size == 0 and at + size <= until and at + size - 1 in found[level]:
                out.append((level, at + size - 1))
                at += size
                break
        else:
            at += 1  # a batch without a run let nothing through
    return out


@dataclass(frozen=True)
class IdMemory:
    """The ids below `base`, as text. `buckets` and `fan_in` belong to the folder: they stay as they were when it was made."""

    spark: SparkSession
    base: str
    key: str
    buckets: int = BUCKETS
    fan_in: int = FAN_IN

    def _id(self) -> list[Column]:
        text = F.col(self.key).cast("string")
        return [text.alias("_id"), F.pmod(F.xxhash64(text), F.lit(self.buckets)).cast("int").alias("_bucket")]

    def _found(self) -> dict[int, dict[int, str]]:
        return finished_levels(self.spark, self.base)

    def runs(self, until: int) -> list[str]:
        """Folders of the runs of all batches before `until`."""
        found = self._found()
        return [found[level][last] for level, last in runs_before({k: set(v) for k, v in found.items()}, until, self.fan_in)]

    def known(self, until: int, buckets: list[int] | None = None) -> DataFrame | None:
        """`(_id, _bucket)` of all batches before `until`, of some buckets or of all."""
        folders = self.runs(until)
        if not folders:
            return None
        rows = self._read(folders)
        return rows if buckets is None else rows.where(F.col("_bucket").isin(buckets))

    def _read(self, folders: list[str]) -> DataFrame:
        """Runs as one table whose folders say level, batch and bucket."""
        schema = "_id string, level int, batch bigint, _bucket int"
        return self.spark.read.schema(schema).option("basePath", self.base).parquet(*folders).select("_id", "_bucket")

    def unseen(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """The rows whose id no batch before `batch_id` let through; each id is looked up in its own bucket."""
        if not self.runs(batch_id):
            return rows
        keyed = rows.select("*", *self._id())
        # at most `buckets` numbers; the scan below reads the folders of these only
        touched = [r[0] for r in keyed.select("_bucket").distinct().collect()]
        known = self.known(batch_id, touched)
        return keyed.join(known, ["_bucket", "_id"], "left_anti").drop("_bucket", "_id")

    def _write(self, ids: DataFrame, level: int, batch_id: int) -> None:
        dealt = ids.repartition(self.buckets, "_bucket") if level else ids.repartition("_bucket")
        dealt.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.base}/level={level}/batch={batch_id}")

    def remember(self, rows: DataFrame, batch_id: int) -> None:
        """Keep the ids of `rows`, which a finished table holds, as those of `batch_id`; merge what is due.

        Doing it again changes nothing: a run is overwritten by the same ids, a finished merge is left alone.
        """
        self._drop_merged(batch_id)
        ids = rows.where(is_named(self.key)).select(*self._id())
        self._write(ids, 0, batch_id)
        level, size = 1, self.fan_in
        while (batch_id + 1) % size == 0:
            found = self._found()
            if batch_id not in found.get(level, {}):
                step = size // self.fan_in
                inputs = [found[level - 1][b] for b in range(batch_id + 1 - size + step - 1, batch_id + 1, step) if b in found.get(level - 1, {})]
                self._write(self._read(inputs), level, batch_id)
            level, size = level + 1, size * self.fan_in

    def _drop_merged(self, batch_id: int) -> None:
        """Remove the inputs of merges that ended before the batch before this one."""
        found = self._found()
        for level in sorted(found)[1:]:
            size, below = self.fan_in**level, found.get(level - 1, {})
            for last in found[level]:
                if last < batch_id - 1:
                    remove(self.spark, [below[b] for b in below if last - size < b <= last])
