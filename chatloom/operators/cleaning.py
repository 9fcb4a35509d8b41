"""Cleaned tokens of messages, vocabulary and bag of words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from chatloom.functions import batches, fixed, lookup, text

# Tokens that are counted together.
COUNTED = 1_000_000


def combined_stop_words(extra: Iterable[str] = fixed.CHAT_STOP_WORDS) -> frozenset[str]:
    """English and Turkish lists of Spark ML plus the chat words (a set union)."""
    return frozenset(fixed.ENGLISH_STOP_WORDS) | frozenset(fixed.TURKISH_STOP_WORDS) | frozenset(extra)


def with_tokens(
    df: DataFrame,
    text_col: str = "message",
    key: str = "msg_key",
    out: str = "tokens",
    stop_words: Iterable[str] | DataFrame | None = None,
    lemmas: Mapping[str, str] | DataFrame | None = None,
    min_length: int = fixed.MIN_WORD_LENGTH,
    in_batches: bool = False,
) -> DataFrame:
    """Add the cleaned tokens of `text_col`.

    Row-local: no shuffle unless a word table is too big for a literal. The lemma
    lookup comes last and its results are not checked again. `in_batches` cleans many texts at once in Arrow, by the same rules,
    unless the stop words are too many for a literal: several times faster for long texts.
    """
    # A column of its own: the split reads it more than once.
    plain = df.withColumn("_plain", text.plain_text(F.col(text_col)))
    if isinstance(stop_words, DataFrame):
        words = lookup.bounded_entries(stop_words.select("word", F.lit(True).alias("stop")))
        if words is None:
            found = plain.withColumn(out, text.split_words(F.col("_plain"))).drop("_plain")
            stops = stop_words.select("word", F.lit(True).alias("stop")).distinct()
            found = lookup.attach_values(found, key, out, "_stop", stops, "boolean")
            kept = F.filter(
                F.arrays_zip(F.col(out).alias("word"), F.col("_stop").alias("stop")),
                lambda z: z["stop"].isNull() & (F.length(z["word"]) >= max(min_length, 1)),
            )
            found = found.withColumn(out, F.transform(kept, lambda z: z["word"])).drop("_stop")
            return _with_lemmas(found, key, out, lemmas)
        stop_words = words
    stop_words = combined_stop_words() if stop_words is None else stop_words
    if in_batches:
        return _with_lemmas(df.withColumn(out, batches.clean_words(F.col(text_col), stop_words, min_length)), key, out, lemmas)
    cleaned = plain.withColumn(out, text.clean_words(F.col("_plain"), stop_words, min_length)).drop("_plain")
    return _with_lemmas(cleaned, key, out, lemmas)


def _with_lemmas(df: DataFrame, key: str, out: str, lemmas: Mapping[str, str] | DataFrame | None) -> DataFrame:
    if lemmas is None:
        return df
    return (
        lookup.attach_values(df, key, out, "_lemma", lemmas, "string")
        .withColumn(
            out,
            F.transform(
                F.arrays_zip(F.col(out).alias("word"), F.col("_lemma").alias("lemma")),
                lambda z: F.coalesce(z["lemma"], z["word"]),
            ),
        )
        .drop("_lemma")
    )


def exploded(df: DataFrame, tokens: str = "tokens", *keep: str) -> DataFrame:
    """`(keep…, token)`, one row per token.

    The outer form on purpose: for the inner one Spark infers a filter `size(tokens) > 0` and
    pushes it to the scan, where the whole cleaning would run a second time.
    """
    rows = df.select(*keep, F.explode_outer(tokens).alias("token"))
    return rows.filter(F.col("token").isNotNull())


def bag_of_words(df: DataFrame, key: str = "msg_key", tokens: str = "tokens") -> DataFrame:
    """`(key, token, n)`; the partial aggregate already folds a message, as its tokens lie together."""
    return exploded(df, tokens, key).groupBy(key, "token").agg(F.count("*").alias("n"))


def vocabulary(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """`(token, doc_freq, term_freq)` over all messages.

    Both counts are taken for many messages at once in Arrow, so they need one shuffle, by token, after partial aggregation.
    """
    counted = df.select(tokens).mapInArrow(_token_counts, "token string, doc_freq long, term_freq long")
    return counted.groupBy("token").agg(F.sum("doc_freq").alias("doc_freq"), F.sum("term_freq").alias("term_freq"))


def _token_counts(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each distinct token of a run of messages, the messages with it and its times."""
    for batch in batches_:
        lists = batch.column(0)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(lists):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + COUNTED, "right")))
            part, at = lists.slice(at, to - at), to
            flat, message = pc.list_flatten(part), pc.list_parent_indices(part).to_numpy()
            given = pc.is_valid(flat).to_numpy(zero_copy_only=False)
            found = flat.filter(pa.array(given)).dictionary_encode()
            size, token = len(found.dictionary), found.indices.to_numpy()
            cell = np.sort(message[given].astype(np.int64) * max(size, 1) + token)
            once = cell[np.flatnonzero(np.diff(cell, prepend=-1))] % max(size, 1)
            counts = [pa.array(np.bincount(x, minlength=size)) for x in (once, token)]
            yield pa.RecordBatch.from_arrays([found.dictionary, *counts], names=["token", "doc_freq", "term_freq"])
