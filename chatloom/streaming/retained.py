"""Last-N table of a stream: small per-batch pieces, folded now and then.

Every micro-batch writes only its own newest N rows per group, into a folder named by the
batch id, so a replayed batch overwrites itself and changes nothing. Readers take the
newest finished fold plus the later finished pieces and list no other folder. The table that is
written per batch therefore grows with the batch, not with the number of groups ever seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatloom.functions import fixed
from chatloom.operators.retain import last_n_per
from chatloom.streaming.finished import finished, read, remove

PIECE, FOLDED = "piece", "folded"


def write_piece(batch: DataFrame, base: str, batch_id: int, group: str, n: int = fixed.KEEP_STREAM_MESSAGES) -> None:
    last_n_per(batch, group, n).write.mode("overwrite").parquet(f"{base}/kind={PIECE}/batch={batch_id}")


def live_folders(spark: SparkSession, base: str, until: int | None = None) -> list[str]:
    """The newest finished fold, and the finished pieces after it (up to batch `until`)."""
    folds, pieces = (finished(spark, f"{base}/kind={kind}") for kind in (FOLDED, PIECE))
    done = max((b for b in folds if until is None or b <= until), default=-1)
    later = [f for b, f in sorted(pieces.items()) if b > done and (until is None or b <= until)]
    return ([folds[done]] if done >= 0 else []) + later


def read_retained(
    spark: SparkSession, base: str, group: str, n: int = fixed.KEEP_STREAM_MESSAGES, until: int | None = None
) -> DataFrame:
    """The retained rows as of the last finished batch."""
    rows = read(spark, live_folders(spark, base, until))
    if rows is None:
        raise ValueError(f"no finished batch in {base}")
    return last_n_per(rows, group, n)


def fold(spark: SparkSession, base: str, batch_id: int, group: str, n: int = fixed.KEEP_STREAM_MESSAGES) -> None:
    """Merge everything up to `batch_id` into one folded piece and remove what the fold before it had replaced.

    The pieces of this fold stay until the next one, for readers that have listed them already. A fold that is finished
    is not made again in a replay.
    """
    folds = finished(spark, f"{base}/kind={FOLDED}")
    if batch_id in folds:
        return
    before = max((b for b in folds if b < batch_id), default=-1)
    merged = read_retained(spark, base, group, n, until=batch_id)
    merged.write.mode("overwrite").parquet(f"{base}/kind={FOLDED}/batch={batch_id}")
    for kind in (FOLDED, PIECE):
        old = finished(spark, f"{base}/kind={kind}")
        remove(spark, [f for b, f in old.items() if b < before or (kind == PIECE and b == before)])


def retain_batches(base: str, group: str, n: int = fixed.KEEP_STREAM_MESSAGES, fold_every: int = 20):
    """A `foreachBatch` function that keeps the last `n` rows per group in `base`."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        write_piece(batch, base, batch_id, group, n)
        if batch_id and batch_id % fold_every == 0:
            fold(batch.sparkSession, base, batch_id, group, n)

    return keep
