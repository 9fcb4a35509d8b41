"""Streaming sources: webhook envelopes, bot messages, captured pages, as landing folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

ENVELOPE_SCHEMA = "headers map<string,string>, body string, received_at timestamp"
BOT_SCHEMA = "timestamp string, username string, message string, channel string, echo boolean"
PAGE_SCHEMA = "page_id bigint, url string, html string"
TYPED_EVENT_SCHEMA = (
    "type string, data string, "
    "message struct<username:string,content:string,msg_id:string,user_id:string,timestamp:string>"
)


def landing_stream(
    spark: SparkSession, path: str, schema: str | StructType, fmt: str = "json", max_files: int = 100
) -> DataFrame:
    """A folder as a stream of at most `max_files` new files per trigger (the rate cap)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


def webhook_stream(spark: SparkSession, path: str, fmt: str = "json", max_files: int = 100) -> DataFrame:
    return landing_stream(spark, path, ENVELOPE_SCHEMA, fmt, max_files)


def bot_stream(spark: SparkSession, path: str, fmt: str = "json", max_files: int = 100) -> DataFrame:
    return landing_stream(spark, path, BOT_SCHEMA, fmt, max_files)


def page_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = 100) -> DataFrame:
    return landing_stream(spark, path, PAGE_SCHEMA, fmt, max_files)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).format(fmt).load(path)


def stamped(df: DataFrame, out: str = "received_at") -> DataFrame:
    """Rows without a time of receipt get the time at which their batch is read: one stamp per batch or query."""
    now = F.current_timestamp()
    return df.withColumn(out, F.coalesce(F.col(out).cast("timestamp"), now) if out in df.columns else now)
