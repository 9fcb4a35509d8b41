"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Text held by one Python step at a time; a longer text makes a step of its own.
STEP_CHARS = 2_000_000
STEP_BYTES = 2_000_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; plain ASCII texts take the quick way."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text in joins: equal texts share results, and ids may be null or repeated."""
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), text).alias("_k2")]


KEY = ["_k1", "_k2"]


def pinned(df: DataFrame, *kept: str | Column, **made: Column) -> DataFrame:
    """`kept` and the columns `made`, each worked out once per row.

    The optimiser copies a column's definition into a lambda that reads it, where it would run once per element;
    it does not move definitions across a generator.
    """
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(n) for n, c in made.items())))))


def steps(texts: Sequence[str | None], limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` characters, or of one row."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose values in `column` have at most `limit` bytes, or one row."""
    values = batch.column(column)
    if not (pa.types.is_string(values.type) or pa.types.is_binary(values.type)):
        yield batch
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


BATCH_ROWS = 1_000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let at most `rows` rows travel to Python at a time in this session, unless it asks for fewer.

    Whole documents are long rows: Spark's 10,000 of them are tens of megabytes on both sides of each task.
    """
    if not 0 < int(spark.conf.get(ARROW_ROWS, "10000")) <= rows:
        spark.conf.set(ARROW_ROWS, rows)


def hand_back() -> None:
    """Give freed memory back to the system: a worker process outlives its task and the stages of a pipeline."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
        if trim is not None:
            trim(0)


def with_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[tuple[str, str]],
    make: Callable,
    step_bytes: int = STEP_BYTES,
    after: Callable[[], None] | None = None,
) -> DataFrame:
    """Add columns worked out in Arrow; the rows stay where they are.

    `make()` is called once per task and gives a function from the input arrays to the new arrays. It is given at most
    `step_bytes` of the first input at a time, or one row, so that its memory does not follow the size of a batch. `after`
    is called when a task ends.
    """
    types = [T._parse_datatype_string(kind) for _, kind in fields]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, k) for (n, _), k in zip(fields, types))])
    names = [f.name for f in schema.fields]
    at = [df.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, at[0], step_bytes):
                made = work(*(part.column(i) for i in at))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=names)
        del work
        if after is not None:
            after()
        hand_back()

    return df.mapInArrow(run, schema)


def quoted(names: Sequence[str]) -> list[Column]:
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name
