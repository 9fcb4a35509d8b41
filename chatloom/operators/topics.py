"""Topic model, topic tables and word-cloud weights."""

from __future__ import annotations

import math
from dataclasses import dataclass
from time import monotonic

from pyspark.sql import DataFrame, functions as F

from chatloom.functions import fixed
from chatloom.functions.text import weight_text
from chatloom.operators import lda
from chatloom.operators.coherence import topic_coherence, total_coherence
from chatloom.session import materialise

TOPICS_SCHEMA = "topic int, rank int, word string, weight double, mass double"


@dataclass
class TopicResult:
    model: lda.TopicModel | None
    vocabulary: DataFrame | None
    topics: DataFrame
    coherence: DataFrame | None
    seconds: float


def update_plan(n_docs: int, passes: int, chunk: int | None) -> tuple[float, int]:
    """`(share of documents per update, number of updates)` for `passes` passes over the corpus.

    Every update reads all chunks of the corpus, however few documents it samples. Without a `chunk` an update takes
    them all, so `passes` updates are `passes` passes: the default, as a mini-batch of `fixed.TOPIC_CHUNK` documents would
    cost a read of its own. With a chunk an update takes about that many documents, and there are as many updates as the
    passes need.
    """
    if chunk is None:
        return 1.0, passes
    rate = min(1.0, chunk / max(n_docs, 1))
    return rate, math.ceil(passes / rate)


def model_topics(
    df: DataFrame,
    tokens: str = "tokens",
    key: str = "msg_key",
    num_topics: int = fixed.TOPIC_COUNT,
    num_words: int = fixed.TOPIC_WORDS,
    passes: int = fixed.TOPIC_PASSES,
    seed: int = fixed.TOPIC_SEED,
    chunk: int | None = None,
    vocabulary_limit: int | None = None,
    with_coherence: bool = True,
) -> TopicResult:
    """Topics of non-empty token lists by variational updates; see `lda.py`.

    The tokens are read once, into chunks in the shared folder, and the updates read those. No token reaches the driver but
    the top words of each topic, and results repeat for the same seed under any layout. `model.weights` has a row
    for each word, `vocabulary` its number and counts.
    """
    start = monotonic()
    spark = df.sparkSession
    docs = df.select(key, tokens)
    if with_coherence:  # read twice more
        docs = materialise(docs.where(F.size(tokens) > 0), "topic-tokens")
    corpus = lda.chunked_corpus(docs, tokens, key, vocabulary_limit)
    try:
        if corpus.n_docs == 0:
            empty = spark.createDataFrame([], TOPICS_SCHEMA)
            return TopicResult(None, None, empty, None, monotonic() - start)
        rate, updates = update_plan(corpus.n_docs, passes, chunk)
        model, mass = lda.fit(corpus, num_topics, passes, seed, rate, updates)
    finally:
        corpus.drop()
    ranked = [tuple(r) for r in model.top_words(max(num_words, fixed.COHERENCE_WORDS)).collect()]
    words = sorted(w for w in ranked if w[1] < num_words)
    topics = spark.createDataFrame([(*w, float(mass[w[0]])) for w in words], TOPICS_SCHEMA)
    coherence = None
    if with_coherence:
        top = [(topic, word) for topic, rank, word, _ in ranked if rank < fixed.COHERENCE_WORDS]
        coherence = topic_coherence(docs, top, tokens)
    return TopicResult(model, corpus.dictionary, topics, coherence, monotonic() - start)


def topic_table(topics: DataFrame) -> DataFrame:
    """Display form: the weight as text with three decimals."""
    return topics.select("topic", "rank", "word", weight_text(F.col("weight")).alias("weight"))


def cloud_weights(topics: DataFrame, n: int = fixed.CLOUD_WORDS) -> DataFrame:
    """`(word, weight)`: sum of the three-decimal weights of a word over all topics, top `n`."""
    return (
        topics.groupBy("word")
        .agg(F.round(F.sum(F.round("weight", 3)), 3).alias("weight"))
        .orderBy(F.col("weight").desc(), "word")
        .limit(n)
    )


def coherence_score(result: TopicResult) -> DataFrame | None:
    return None if result.coherence is None else total_coherence(result.coherence)
