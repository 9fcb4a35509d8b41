"""Session settings and the shared scratch folder. Sessions always come from the caller."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession, functions as F

RECOMMENDED_CONF = {
    # Inputs carry no zone; one zone everywhere keeps periods and text times equal.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder the cluster names in `spark.checkpoint.dir`.

    A machine-local folder is only used by a local session that has no such setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="chatloom-")
    return f"{base.rstrip('/')}/chatloom/{name}-{uuid.uuid4().hex}"


def materialise(df, name: str):
    """Write `df` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


INPUT_PARTITIONS = "spark.chatloom.inputPartitions"


def spread(df):
    """The scan as it is, or, where the session asks for it, dealt to that many parts.

    For a single machine and an input of one unsplittable file: `spark.chatloom.inputPartitions`. On a cluster the split
    size is Spark's own setting (`spark.sql.files.maxPartitionBytes`), and this setting stays unset: nothing is shuffled.
    """
    parts = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(parts)) if parts else df


def settled(df):
    """The rows of `df` with every column worked out once.

    A filter or an expression that reads a computed column gets a copy of its definition, and runs it again. The optimiser
    does not move definitions across a generator, so rows pass through one of a single element each.
    """
    return df.select(F.inline(F.array(F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns)))))
