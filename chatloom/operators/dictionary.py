"""Dictionary of a corpus: every token with a dense number, without a token on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from chatloom.operators.cleaning import vocabulary
from chatloom.session import materialise

ROW_BITS = 33  # of monotonically_increasing_id: the row below, the partition above


def numbered(df: DataFrame, order: str, out: str) -> DataFrame:
    """`df` with a dense number from 0 in the order of the distinct values of `order`, as a written table.

    The rows are put in order by range, each part counts its own, and a part's first number is the sum of the counts of the parts
    before it. Only one row for each part comes together.
    """
    placed = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_place", F.monotonically_increasing_id())
    placed = materialise(placed, "numbered-parts")
    part = F.shiftright("_place", ROW_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    row = F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    found = placed.join(F.broadcast(first), part == F.col("_part"))
    return materialise(found.withColumn(out, F.col("_first") + row).drop("_place", "_part", "_first"), "numbered")


def indexed_vocabulary(df: DataFrame, tokens: str = "tokens", limit: int | None = None) -> DataFrame:
    """`(token, doc_freq, term_freq, word_id)`: every token of the corpus, numbered from 0 in alphabetical order.

    A caller who must bound the dictionary gives a `limit`; a bigger one is then an error: no word is left out silently.
    """
    return bounded(numbered(vocabulary(df, tokens), "token", "word_id"), limit)


def bounded(dictionary: DataFrame, limit: int | None) -> DataFrame:
    if limit is not None and (n := dictionary.count()) > limit:
        raise ValueError(f"the dictionary has {n} words, more than the limit of {limit}")
    return dictionary
