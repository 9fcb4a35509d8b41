"""Chat logs, labelled sets and comparison inputs as CSV."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from chatloom.functions.text import parse_time


def read_csv(
    spark: SparkSession, path: str | Sequence[str], multi_line: bool = False, header: Sequence[str] | None = None
) -> DataFrame:
    """Header CSV, every column STRING. `multi_line` costs splittability, so it is off.

    With the columns of `header` given no job looks for them.
    """
    reader = spark.read if header is None else spark.read.schema(", ".join(f"`{c}` string" for c in header))
    return (
        reader.option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("enforceSchema", header is not None)
        .csv(path if isinstance(path, str) else list(path))
    )


def resolve_chat(df: DataFrame) -> DataFrame:
    """Check and name the columns of a chat log; add `ts` and `msg_key`.

    `timestamp` is required, the text is `message`, else `content` renamed. Fails before any
    job runs. Without a `msg_id` column the key is a row number of this read.
    """
    if "timestamp" not in df.columns:
        raise ValueError(f"a chat log needs a 'timestamp' column, found {df.columns}")
    if "message" not in df.columns:
        if "content" not in df.columns:
            raise ValueError(f"a chat log needs a 'message' or 'content' column, found {df.columns}")
        df = df.withColumnRenamed("content", "message")
    key = F.col("msg_id") if "msg_id" in df.columns else F.monotonically_increasing_id()
    return df.withColumns({"ts": parse_time(F.col("timestamp")), "msg_key": key})


def unread_times(df: DataFrame) -> DataFrame:
    """How many times were given and how many of them could not be read."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("ts").isNull() & F.col("timestamp").isNotNull()).alias("unread_times"),
    )


def read_chat_log(spark: SparkSession, path: str | Sequence[str], multi_line: bool = False) -> DataFrame:
    return resolve_chat(read_csv(spark, path, multi_line))


def labelled_columns(columns: Sequence[str]) -> str | None:
    """Text column of a labelled file: `content` first, then `message`; None = skip the file."""
    if "label" not in columns:
        return None
    return next((c for c in ("content", "message") if c in columns), None)


def read_labelled(spark: SparkSession, folder: str, multi_line: bool = False) -> DataFrame:
    """All `*.csv` of a folder as `(text, label)`, no dedupe.

    One job reads the first line of every file and groups the files by it, then each header shape is one scan. Files of
    another shape and empty files are skipped.
    """
    lines = spark.read.option("pathGlobFilter", "*.csv").text(folder).select("value", F.col("_metadata.file_path").alias("path"),
                                                                         F.col("_metadata.file_block_start").alias("at"))
    # The first line of a file is the first row of its first block; a task reads a block in order.
    first = lines.filter(F.col("at") == 0).withColumn("n", F.monotonically_increasing_id()).groupBy("path").agg(
        F.min_by("value", "n").alias("header")
    )
    shapes = first.groupBy("header").agg(F.collect_list("path").alias("paths")).collect()
    parts = []
    for shape in sorted(shapes, key=lambda r: r["header"]):
        rows = read_csv(spark, shape["paths"], multi_line, header=_header(shape["header"]))
        name = labelled_columns(rows.columns)
        if name:
            parts.append(rows.select(F.col(name).alias("text"), "label"))
    if not parts:
        raise ValueError(f"no labelled csv file in {folder}")
    return union_labelled(parts)


def _header(line: str) -> list[str]:
    """Column names of a header line, without a byte-order mark."""
    return next(csv.reader([line.removeprefix("\ufeff")]))


def union_labelled(parts: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _require(df: DataFrame, wanted: Sequence[str], what: str) -> None:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {missing}, found {df.columns}")


def prepare_predicted(df: DataFrame) -> DataFrame:
    """`timestamp, username, message_text, predicted_label`; a leading index column is ignored."""
    wanted = ("timestamp", "username", "message", "sentiment")
    _require(df, wanted, "the predictions table")
    return df.select(*wanted).withColumnsRenamed({"message": "message_text", "sentiment": "predicted_label"})


def prepare_actual(df: DataFrame) -> DataFrame:
    """`timestamp, username, message_text, actual_label`."""
    wanted = ("timestamp", "username", "content", "label")
    _require(df, wanted, "the truth table")
    return df.select(*wanted).withColumnsRenamed({"content": "message_text", "label": "actual_label"})


def load_predicted(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return prepare_predicted(read_csv(spark, path, multi_line))


def load_actual(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return prepare_actual(read_csv(spark, path, multi_line))
