"""Counts taken while a stream runs, without a second pass over its rows.

`measured` lets Spark count rows as they flow by; a listener on the driver adds up what each batch reports. A batch that is replayed
reports again, under the same number, and counts once.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener


def event_measures(reason: str = "reason", at: str = "ts", given: str = "timestamp") -> dict[str, Column]:
    """Rows, rejected rows, and times that were given but couldn't be read."""
    return {
        "n_rows": F.count(F.lit(1)),
        "rejected": F.count_if(F.col(reason).isNotNull()),
        "unread_times": F.count_if(F.col(at).isNull() & F.col(given).isNotNull()),
    }


def measured(df: DataFrame, name: str, measures: Mapping[str, Column] | None = None) -> DataFrame:
    """`df` unchanged; its batches report `measures` under `name`."""
    found = event_measures() if measures is None else measures
    return df.observe(name, *(c.alias(n) for n, c in found.items()))


class Totals(StreamingQueryListener):
    """Sums of the reports called `name`: a few numbers per batch reach the driver, and only the sums and the last batch stay."""

    def __init__(self, name: str):
        self.name, self._lock = name, threading.Lock()
        self._sums: dict[str, int] = {}
        self._last: dict[str, tuple[int, dict[str, int]]] = {}
        self.batches = 0

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        report = event.progress.observedMetrics.get(self.name)
        if report is None:
            return
        found = {k: int(v or 0) for k, v in report.asDict().items()}
        query, batch = str(event.progress.id), event.progress.batchId
        with self._lock:
            before, old = self._last.get(query, (-1, {}))
            if batch < before:
                return
            if batch == before:  # the same batch again
                for k, v in old.items():
                    self._sums[k] -= v
            else:
                self.batches += 1
            for k, v in found.items():
                self._sums[k] = self._sums.get(k, 0) + v
            self._last[query] = batch, found

    def settled_totals(self, batches: int, seconds: float = 30.0) -> dict[str, int]:
        """The sums once `batches` batches have reported: reports come a little after their batch."""
        until = time.monotonic() + seconds
        while self.batches < batches and time.monotonic() < until:
            time.sleep(0.02)
        return self.totals()

    def totals(self) -> dict[str, int]:
        with self._lock:
            return dict(self._sums)


def watch(spark: SparkSession, name: str) -> Totals:
    """A listener for `name`; `spark.streams.removeListener` ends it."""
    found = Totals(name)
    spark.streams.addListener(found)
    return found
