"""Chat-log sink, raw event audit, stored-table reset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chatloom.functions import fixed
from chatloom.functions.text import safe_name


def log_rows(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """`(timestamp, username, message[, channel])` in that order, and the columns that were missing.

    `content` becomes `message`; a missing column is added as empty text.
    """
    if "content" in df.columns:
        df = df.drop("message").withColumnRenamed("content", "message")
    missing = [c for c in fixed.LOG_COLUMNS if c not in df.columns]
    filled = df.withColumns({c: F.lit("") for c in missing}) if missing else df
    channel = [safe_name(F.col("channel")).alias("channel")] if "channel" in df.columns else []
    return filled.select(*fixed.LOG_COLUMNS, *channel), missing


def write_chat_log(df: DataFrame, path: str, fmt: str = "csv", mode: str = "append") -> list[str]:
    """Append the log rows (or write them anew), one folder per channel; nothing is written for an empty frame.

    Returns the columns that had to be added.
    """
    rows, missing = log_rows(df)
    if rows.isEmpty():
        return missing
    writer = rows.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if "channel" in rows.columns:
        writer = writer.partitionBy("channel")
    writer.save(path)
    return missing


def append_audit(envelopes: DataFrame, path: str) -> None:
    """Keep headers and body of every event, readable or not, by arrival day."""
    envelopes.withColumn("day", F.to_date("received_at")).write.mode("append").partitionBy("day").parquet(path)


def clear_stored(spark: SparkSession, path: str) -> None:
    """Replace the stored table by an empty one of the same schema and the same partition columns (explicit call only)."""
    stored = spark.read.parquet(path)
    folders = stored.select(F.regexp_extract_all("_metadata.file_path", F.lit(r"([^/=]+)=[^/]*/"), 1).alias("p")).limit(1).collect()
    layout = [c for c in (folders[0]["p"] if folders else ()) if c in stored.columns]
    empty = spark.createDataFrame([], stored.schema)
    (empty.write.partitionBy(*layout) if layout else empty.write).mode("overwrite").parquet(path)
