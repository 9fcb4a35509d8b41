"""C_v topic coherence (Röder, Both and Hinneburg, 2015) without building the windows.

A window of 110 tokens slides by one, so a word at position p is inside the windows that
start in [p-109, p]. The number of windows with a word is the length of the union of those
ranges; the number with two words is `n(a) + n(b) - n(a or b)`. Both come from the hit
positions of one message, in numpy for many messages at once. What crosses the shuffle is one
partial sum per word pair and task.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from chatloom.functions import fixed

TOTAL = ""  # tokens are never empty, so this name is free for the number of all windows
BLOCK_TOKENS = 500_000  # of messages that are counted together


def window_counts(
    docs: DataFrame,
    topic_words: Iterable[tuple[int, str]],
    tokens: str = "tokens",
    window: int = fixed.COHERENCE_WINDOW,
) -> DataFrame:
    """`(word_a, word_b, n)` with `word_a <= word_b`: windows holding both words.

    A word with itself gives its own count, the empty word the number of all windows. Only
    pairs that share a topic are counted.
    """
    partners = _partners(topic_words)
    words = sorted(partners)
    place = {w: i for i, w in enumerate(words)}
    pairs = [(place[w], place[other]) for w in words for other in sorted(partners[w])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n_all = pa.array(words, pa.string()), 0
        alone, both = np.zeros(len(words), np.int64), np.zeros(len(pairs), np.int64)
        for batch in batches:
            for lists in _blocks(batch.column(0)):
                n_windows, doc, at, word = _hits(lists, known, window)
                n_all += int(n_windows.sum())
                _count(n_windows, doc, at, word, window, pairs, alone, both)
        found = [(TOTAL, TOTAL, n_all), *((w, w, n) for w, n in zip(words, alone.tolist()))]
        found += [(words[i], words[j], n) for (i, j), n in zip(pairs, both.tolist())]
        found = [f for f in found if f[2] > 0]
        columns = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["word_a", "word_b", "n"])

    counted = docs.select(tokens).mapInArrow(run, "word_a string, word_b string, n bigint")
    return counted.groupBy("word_a", "word_b").agg(F.sum("n").cast("bigint").alias("n"))


def _blocks(lists: pa.Array) -> Iterator[pa.Array]:
    """Runs of messages of at most BLOCK_TOKENS tokens, or of one message."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(lists):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + BLOCK_TOKENS, "right")))
        yield lists.slice(at, to - at)
        at = to


def _hits(lists: pa.Array, known: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of windows of each message, and message, position and word of each hit, in that order.

    A message without tokens has no window.
    """
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    n_windows = np.where(sizes > 0, np.maximum(sizes - window + 1, 1), 0)
    word = pc.fill_null(pc.index_in(pc.list_flatten(lists), value_set=known, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
    hit = np.flatnonzero(word >= 0)
    doc = np.searchsorted(np.cumsum(sizes), hit, "right")
    return n_windows, doc, hit - (np.cumsum(sizes) - sizes)[doc], word[hit]


def _count(
    n_windows: np.ndarray, doc: np.ndarray, at: np.ndarray, word: np.ndarray, window: int, pairs: list[tuple[int, int]],
    alone: np.ndarray, both: np.ndarray,
) -> None:
    """Add the windows with each word to `alone` and those with both words of each pair to `both`."""
    # hits by word, in their order; and which messages have the word
    order, ends = np.argsort(word, kind="stable"), np.cumsum(np.bincount(word, minlength=len(alone)))
    of = np.split(order, ends[:-1]) if len(alone) else []
    new, has = np.zeros(len(doc), np.int64), np.zeros((len(alone), len(n_windows)), bool)
    for i, mine in enumerate(of):
        new[mine] = _covered(doc[mine], at[mine], n_windows, window)
        alone[i] += new[mine].sum()
        has[i, doc[mine]] = True
    for k, (i, j) in enumerate(pairs):
        shared = has[i] & has[j]
        if not shared.any():
            continue
        a, b = of[i][shared[doc[of[i]]]], of[j][shared[doc[of[j]]]]
        either = np.sort(np.concatenate([a, b]))
        both[k] += new[a].sum() + new[b].sum() - _covered(doc[either], at[either], n_windows, window).sum()


def _partners(topic_words: Iterable[tuple[int, str]]) -> dict[str, set[str]]:
    """word -> later words (alphabetically) that share a topic with it."""
    by_topic: dict[int, set[str]] = {}
    for topic, word in topic_words:
        by_topic.setdefault(topic, set()).add(word)
    partners: dict[str, set[str]] = {}
    for words in by_topic.values():
        for word in words:
            partners.setdefault(word, set()).update(w for w in words if w > word)
    return partners


def _covered(doc: np.ndarray, at: np.ndarray, n_windows: np.ndarray, window: int) -> np.ndarray:
    """For each of the sorted hits, the number of its message's window starts that see it and no earlier one."""
    high = np.minimum(at, n_windows[doc] - 1)
    before = np.full(len(doc), -1)
    before[1:] = np.where(doc[1:] == doc[:-1], high[:-1], -1)
    return np.maximum(high - np.maximum(at - window + 1, before + 1).clip(0) + 1, 0)


def topic_coherence(
    docs: DataFrame,
    topic_words: Iterable[tuple[int, str]],
    tokens: str = "tokens",
    window: int = fixed.COHERENCE_WINDOW,
    epsilon: float = fixed.COHERENCE_EPSILON,
) -> DataFrame:
    """`(topic, coherence)`; everything after the window counts is topics x words x words rows."""
    topic_words = sorted(set(topic_words))
    # The count table is bounded by the topic words, so it is folded into one row with one map
    # and the word pairs of the topics are read from the plan: no join.
    counts = window_counts(docs, topic_words, tokens, window).agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "word_a", "word_b"), "n"))).alias("counts")
    )
    pairs = [
        {"topic": topic, "word": a, "other": b}
        for topic, a in topic_words
        for other_topic, b in topic_words
        if topic == other_topic
    ]
    literal = F.from_json(F.lit(json.dumps(pairs, ensure_ascii=False)), "array<struct<topic:int,word:string,other:string>>")
    rows = counts.select("counts", F.inline(literal))

    def share(a: Column, b: Column) -> Column:
        n = F.try_element_at("counts", F.concat_ws(" ", F.least(a, b), F.greatest(a, b)))
        total = F.try_element_at("counts", F.concat_ws(" ", F.lit(TOTAL), F.lit(TOTAL)))
        return F.coalesce(n, F.lit(0)) / total

    both = share(F.col("word"), F.col("other")) + epsilon
    apart = share(F.col("word"), F.col("word")) * share(F.col("other"), F.col("other"))
    scored = rows.select("topic", "word", "other", F.when(apart > 0, F.ln(both / apart) / -F.ln(both)).otherwise(0.0).alias("npmi"))
    # One group per topic word: at most 20 rows.
    summed = scored.withColumn("total", F.sum("npmi").over(Window.partitionBy("topic", "other")))
    cosine = F.sum(F.col("npmi") * F.col("total")) / (F.sqrt(F.sum(F.col("npmi") ** 2)) * F.sqrt(F.sum(F.col("total") ** 2)))
    return summed.groupBy("topic", "word").agg(cosine.alias("cosine")).groupBy("topic").agg(F.avg("cosine").alias("coherence"))


def total_coherence(per_topic: DataFrame) -> DataFrame:
    return per_topic.agg(F.avg("coherence").alias("coherence"))
