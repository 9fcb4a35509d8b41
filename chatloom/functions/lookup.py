"""Word-table lookups for arrays of words.

A small table (size checked) travels with the plan as a literal and is read in place:
no explode, no shuffle, the row stays whole. A bigger table takes the join route:
explode, salted hash join (a hot word is spread over many tasks), regroup per message.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from chatloom.session import materialise

LITERAL_ENTRIES = 50_000
JOIN_SALTS = 32


def single_entries(table: DataFrame) -> DataFrame:
    """`(_word, _value)`, each word once: of a word listed several times the greatest value counts, null words never match."""
    entries = table.toDF("_word", "_value").filter(F.col("_word").isNotNull())
    return entries.groupBy("_word").agg(F.max("_value").alias("_value"))


def bounded_entries(table: DataFrame, limit: int = LITERAL_ENTRIES) -> dict | None:
    """The two-column `table` as a dict, or None when it has more than `limit` words."""
    rows = single_entries(table).limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return {row[0]: row[1] for row in rows}


def literal_lookup(entries: Mapping[str, object], value_type: str) -> Callable[[Column], Column]:
    """`word -> value` (null when unknown) over a literal hash table.

    A map literal is searched entry by entry, so the entries are spread over an array
    of small maps indexed by the checksum of the word.
    """
    slots = max(1, 2 * len(entries))
    table: list[dict] = [{} for _ in range(slots)]
    for word, value in entries.items():
        table[zlib.crc32(word.encode()) % slots][word] = value
    # Constant folding turns this into one literal before any row is read.
    literal = F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), f"array<map<string,{value_type}>>")

    def lookup(word: Column) -> Column:
        slot = F.pmod(F.crc32(word), F.lit(slots)).cast("int")
        return F.try_element_at(F.get(literal, slot), word)

    return lookup


def attach_values(
    df: DataFrame,
    key: str,
    words: str,
    out: str,
    table: Mapping[str, object] | DataFrame,
    value_type: str,
    fold: Callable[[Column], Column] = lambda w: w,
    limit: int = LITERAL_ENTRIES,
) -> DataFrame:
    """Add array column `out`: for each word of `words` its value in `table`, else null.

    `table` is a dict or a frame `(word, value)`. Both routes give the same values in the same
    places: rows are told apart by a row id of their own, so a repeated or null `key` does no harm.
    """
    entries = table if isinstance(table, Mapping) else bounded_entries(table, limit)
    if entries is not None and len(entries) <= limit:
        lookup = literal_lookup(entries, value_type)
        return df.withColumn(out, F.transform(words, lambda w: lookup(fold(w))))
    if isinstance(table, Mapping):
        table = df.sparkSession.createDataFrame(list(table.items()), f"word string, value {value_type}")
    return _attach_by_join(df, key, words, out, table, value_type, fold)


def _attach_by_join(
    df: DataFrame,
    key: str,
    words: str,
    out: str,
    table: DataFrame,
    value_type: str,
    fold: Callable[[Column], Column],
) -> DataFrame:
    entries = single_entries(table).select(
        "_word", "_value", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))).alias("_salt")
    )
    # Written once, so that both readers see the same row ids.
    rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "lookup-rows")
    tokens = rows.select("_row", F.posexplode_outer(words).alias("_pos", "_token")).select(
        "_row",
        "_pos",
        fold(F.col("_token")).alias("_word"),
        F.pmod(F.xxhash64("_row", "_pos"), F.lit(JOIN_SALTS)).cast("int").alias("_salt"),
    ).filter(F.col("_word").isNotNull())
    # Known words alone cross the join; one message is one group, so no group is unbounded.
    hits = tokens.join(entries, ["_word", "_salt"]).groupBy("_row").agg(
        F.map_from_entries(F.collect_list(F.struct("_pos", "_value"))).alias("_hits")
    )
    found = F.transform(words, lambda w, i: F.try_element_at("_hits", i))
    none = F.transform(words, lambda w: F.lit(None).cast(value_type))
    return (
        rows.join(hits, "_row", "left")
        .withColumn(out, F.when(F.col("_hits").isNull(), none).otherwise(found))
        .drop("_hits", "_row")
    )
