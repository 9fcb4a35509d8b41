"""Batch folders of a streaming job: only finished ones are read, old ones are removed.

Spark's writer closes a folder with an empty `_SUCCESS` file; a folder that is still being written, or written again in a
replay, has none and doesn't count. Folders are listed through Hadoop's file system, so any shared store will do.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NAME = re.compile(r"batch=(\d+)$")


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def finished(spark: SparkSession, base: str) -> dict[int, str]:
    """`batch id -> folder` of the finished batches below `base`."""
    files, path = _files(spark, base)
    found = files.globStatus(path(f"{base}/batch=*/_SUCCESS")) or []
    folders = [status.getPath().getParent().toString() for status in found]
    return {int(NAME.search(f)[1]): f for f in folders}


def finished_levels(spark: SparkSession, base: str) -> dict[int, dict[int, str]]:
    """`level -> batch id -> folder` of the finished batches below the level folders of `base`; one listing."""
    files, path = _files(spark, base)
    out: dict[int, dict[int, str]] = {0: {}}
    for status in files.globStatus(path(f"{base}/level=*/batch=*/_SUCCESS")) or []:
        folder = status.getPath().getParent()
        level = int(folder.getParent().getName().removeprefix("level="))
        out.setdefault(level, {})[int(NAME.search(folder.toString())[1])] = folder.toString()
    return out


def read(spark: SparkSession, folders: list[str]) -> DataFrame | None:
    return spark.read.parquet(*folders) if folders else None


def remove(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        files, path = _files(spark, folder)
        files.delete(path(folder), True)
